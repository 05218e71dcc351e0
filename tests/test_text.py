"""Spans, windows, chunks and search against plain Python models."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.functions.stemming import stem_words
from almanac.operators import search, text

LEX = text.lexicon_pattern(["solar"], ["green*"])
PY = re.compile(r"\bsolar\b|\bgreen\w*\b", re.IGNORECASE)


def frame(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id long, text string")


def model_hits(body):
    return [(m.group(0).lower(), m.start(), m.end()) for m in PY.finditer(body)]


def model_spans(body, gap=15):
    out = []
    for word, s, e in model_hits(body):
        if out and s - out[-1][2] <= gap:
            out[-1] = (out[-1][0] + ", " + word, out[-1][1], e)
        else:
            out.append((word, s, e))
    return out


def model_windows(body, pad):
    spans, out = model_spans(body), []
    for i, (_, s, e) in enumerate(spans):
        left = min(pad, (s - spans[i - 1][2]) // 2) if i else pad
        right = min(pad, (spans[i + 1][1] - e) // 2) if i < len(spans) - 1 else pad
        out.append(body[max(0, s - left) : e + right])
    return out


def check_spans(spark, bodies, pad=7):
    df = frame(spark, bodies)
    hits, spans, merged, windows = {}, {}, {}, {}
    for r in text.keyword_hits(df, "id", "text", LEX).collect():
        hits.setdefault(r.id, []).append((r.start, r.end, r.keyword))
    for r in text.keyword_spans(df, "id", "text", LEX).collect():
        spans.setdefault(r.id, []).append((r.start, r.end, r.keywords))
    for r in text.merge_hits(text.keyword_hits(df, "id", "text", LEX), "id").collect():
        merged.setdefault(r.id, []).append((r.start, r.end, r.keywords))
    for r in text.context_windows(df, "id", "text", LEX, pad=pad).collect():
        windows.setdefault(r.id, []).append((r.pos, r.chunk_text))
    for i, body in enumerate(bodies):
        assert sorted(hits.get(i, [])) == [(s, e, w) for w, s, e in model_hits(body)]
        want = [(s, e, w) for w, s, e in model_spans(body)]
        assert sorted(spans.get(i, [])) == want
        assert sorted(merged.get(i, [])) == want
        assert [w for _, w in sorted(windows.get(i, []))] == model_windows(body, pad)


def test_merge_gap_boundary(spark):
    near, far = "solar" + "." * 15 + "greenish", "solar" + "." * 16 + "green"
    check_spans(spark, [near, far, "", "no hit", "SOLAR solar", "xsolar Greens", "éé solar \U0001f600 green", "solaré green_x"])
    counts = frame(spark, [near, far]).select(text.span_count(F.col("text"), LEX).alias("n")).collect()
    assert [r.n for r in counts] == [1, 2]


def test_odd_gap_is_halved_down(spark):
    body = "solar" + "x" * 0 + " " + "a" * 19 + " " + "green"
    got = [r.chunk_text for r in text.context_windows(frame(spark, [body]), "id", "text", LEX, pad=500, gap=5).orderBy("pos").collect()]
    assert got == [body[:15], body[16:]]


pieces = st.sampled_from(["solar", "green", "greenhouse", " ", "\n", "x", "é", ".", "abc def ", "long filler text here "])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(pieces, max_size=40).map("".join), min_size=10, max_size=30), st.integers(0, 30))
def test_spans_property(spark, bodies, pad):
    check_spans(spark, bodies, pad)


def model_chunks(body, size):
    out, start = [], 0
    while start < len(body):
        end = min(start + size, len(body))
        if end < len(body):
            ws = body.rfind(" ", start, end)
            end = ws if ws > start else end
        if body[start:end].strip():
            out.append(body[start:end].strip())
        start = end
    return out


def test_fixed_chunks(spark):
    bodies = ["a" * 1200, "   lead " + "b" * 600, "c" * 500, " " + "d" * 700, " \n ", "", "word " * 300, "é " * 400]
    got = {}
    for r in text.fixed_chunks(frame(spark, bodies), "id", "text").collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.chunk_text))
    for i, body in enumerate(bodies):
        assert [c for _, c in sorted(got.get(i, []))] == model_chunks(body, 500)
        assert re.sub(r"\s", "", "".join(c for _, c in sorted(got.get(i, [])))) == re.sub(r"\s", "", body)


def test_budgeted_text_takes_best_pages_first(spark):
    rows = [("a", i, "x" * n, s) for i, (n, s) in enumerate([(5000, 1), (3000, 9), (10, 5), (4000, 1)])] + [("b", 9, "y", 0)]
    df = spark.createDataFrame(rows, "grp string, id long, text string, score int")
    got = {r.grp: (r.agg_text.split("\n\n---\n\n"), r.pages_used) for r in text.budgeted_text(df, "grp", "id", "text", F.col("score")).collect()}
    assert [len(p) for p in got["a"][0]] == [3000, 10, 2990] and got["a"][1] == 3
    assert got["b"] == (["y"], 1)


@pytest.mark.parametrize("fold", [40, 10_000])
def test_budget_of_a_crowded_group(spark, monkeypatch, fold):
    """A third of all pages in one group, tiny pages, ties, null keys and scores: the plain sorted loop's text."""
    import random

    monkeypatch.setattr(text, "FOLD_ROWS", fold)
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b", "hot", "hot"]), rng.choice([None, 2**60 + i, i]), rng.choice("xyzé") * rng.randint(0, 9), rng.choice([None, 1, 2])) for i in range(900)]
    rows += [("tiny", i, "t", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "grp string, id long, text string, score int").repartition(7)
    got = {r.grp: (r.agg_text, r.pages_used) for r in text.budgeted_text(df, "grp", "id", "text", F.col("score"), 6, 100, "|").collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g and r[2]), key=lambda r: (-(r[3] or 0), r[1] is not None, r[1] or 0))
        used, pieces = 0, []
        for r in mine:
            if used < 100:
                pieces.append(r[2][:6][: 100 - used])
                used += len(r[2][:6])
        if g is not None and g != "hot" and g != "a" and g != "b":
            assert got[g] == ("|".join(pieces), len(pieces))
        else:  # rows of null id and one score come in any order
            assert got[g][1] == len(got[g][0].split("|")) and len(got[g][0].replace("|", "")) == min(100, used)
    unique = df.where("id IS NOT NULL")
    got = {r.grp: r.agg_text for r in text.budgeted_text(unique, "grp", "id", "text", F.col("score"), 6, 100, "|").collect()}
    for g in {r[0] for r in rows if r[1] is not None}:
        mine = sorted((r for r in rows if r[0] == g and r[2] and r[1] is not None), key=lambda r: (-(r[3] or 0), r[1]))
        used, pieces = 0, []
        for r in mine:
            if used < 100:
                pieces.append(r[2][:6][: 100 - used])
                used += len(r[2][:6])
        assert got[g] == "|".join(pieces)


def test_full_text_terms(spark):
    df = frame(spark, ["The running dogs", "a dog ran", "nothing"])
    index = search.stemmed_index(df, "id", "text")
    assert sorted(r.id for r in search.with_any(index, "id", ["dog"]).collect()) == [0, 1]
    assert [r.id for r in search.with_all(index, "id", ["dog", "run"]).collect()] == [0]
    assert sorted(map(tuple, index.where("id = 0").collect())) == [("dog", 0), ("run", 0)]


def test_stems(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "hopping": "hop", "hoping": "hope", "relational": "relat", "generously": "generous",
        "sustainability": "sustain", "recycling": "recycl", "energies": "energi", "happy": "happi", "say": "say", "gas": "gas",
        "skies": "sky", "news": "news", "innings": "inning", "succeeded": "succeed", "by": "by", "youth": "youth", "boyish": "boyish", "flying": "fli",
        "this": "this", "kiwis": "kiwi", "gaps": "gap", "cries": "cri", "bed": "bed", "shed": "shed", "proceedings": "proceed", "knightly": "knight",
        "analogies": "analog", "communism": "communism", "arsenal": "arsenal", "controlled": "control", "rationalization": "ration", "": "",
        "adjustable": "adjust", "adoption": "adopt", "formative": "format", "hopeful": "hope", "goodness": "good", "electrical": "electr", "über": "über",
    }
    words = spark.createDataFrame([(w,) for w in pairs], "word string")
    got = {r.word: r.stem for r in stem_words(words).collect()}
    assert got == pairs


def test_pending_retries_errors(spark):
    want = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "id long, i int")
    done = spark.createDataFrame([(1, 0, None), (1, 1, "busy"), (2, 0, "")], "id long, i int, error string")
    assert [(r.id, r.i) for r in text.pending_work(want, done, ["id", "i"]).collect()] == [(1, 1)]


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p = v[:3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    phrases = spark.createDataFrame([(n, x.tolist()) for n, x in zip("abc", p)], "name string, w array<double>")
    got = {r.id: (r.phrase, r.score) for r in search.best_phrase(df, "v", phrases, "name", "w").collect()}
    sims = v @ p.T
    for i in range(30):
        assert got[i][0] == "abc"[sims[i].argmax()] and abs(got[i][1] - sims[i].max()) < 1e-12
    q = search.mean_query_vector(phrases, "w")
    assert np.allclose(q, p.mean(axis=0) / np.linalg.norm(p.mean(axis=0)))
    one = {r.id: r.s for r in df.select("id", search.query_similarity(F.col("v"), q).alias("s")).collect()}
    assert max(abs(one[i] - float(v[i] @ q)) for i in range(30)) < 1e-12
    m = search.mean_vector(df, "v").first()[0]
    want = v.mean(axis=0)
    assert np.allclose(m, want / np.linalg.norm(want))


@pytest.mark.parametrize("sent", [search.SENT_BYTES, 0])
def test_ten_thousand_phrases(spark, monkeypatch, sent):
    """Phrases that are sent and phrases that meet the rows block by block give the best of all, ties by name."""
    import numpy as np

    monkeypatch.setattr(search, "SENT_BYTES", sent)
    monkeypatch.setattr(search, "ROW_BLOCK", 70)
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v, p = unit(rng.normal(size=(200, 6))), unit(rng.normal(size=(10_000, 6)))
    p[7_000:7_200] = v  # these score one, and so do their doubles of later names
    p[9_000:9_200] = v
    names = [f"n{i:05d}" for i in range(10_000)]
    df = spark.createDataFrame([(i % 150, x.tolist(), "e") for i, x in enumerate(v)], "id long, v array<double>, extra string")
    phrases = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, p)] + [(None, p[0].tolist()), ("none", None)], "name string, w array<double>")
    got = search.best_phrase(df, "v", phrases.repartition(5), "name", "w")
    assert got.columns == ["id", "extra", "score", "phrase"]
    found = sorted((r.id, r.phrase, round(r.score, 9)) for r in got.collect())
    sims = v @ p.T
    near = np.abs(sims - sims.max(axis=1, keepdims=True)) < 1e-12
    assert [f[0] for f in found] == sorted(i % 150 for i in range(200)) and all(f[2] == 1.0 for f in found)
    assert {f[1] for f in found} <= {names[j] for j in np.flatnonzero(near.any(axis=0))}
    scores = search.phrase_scores(df.where("id < 3"), "id", "v", phrases, "name", "w", 0.9)
    want = [(i % 150, names[j]) for i in range(200) if i % 150 < 3 for j in np.flatnonzero(sims[i] >= 0.9)]
    assert sorted((r.id, r.phrase) for r in scores.collect()) == sorted(want)
    none = search.best_phrase(df, "v", phrases.where("false"), "name", "w")
    assert none.count() == 0

"""The pipeline on a small fixture, each stage against plain Python on what its predecessor kept."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex

import corpus_pipeline
from almanac.llm import language, mixing, quality_rules, simhash
from almanac.session import materialise
from test_operators import kept_by_similarity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, told string, size string"
VOCABULARY = {
    "en": "the of and to in that was his with as he for had is at on by it from but which not her were all she one out".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
}


def fixture():
    rng = random.Random(11)
    rows = []

    def add(text, lang="en", source="a", doc_id=True):
        rows.append((len(rows) if doc_id else None, text, lang, source, len(text or ""), "d", "t", "s"))

    for i in range(160):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(VOCABULARY[lang]) + rng.choice(["", "er", "en", "ing", "s"]) for _ in range(rng.randint(12, 60))]
        add("\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)), lang if i % 5 else None, "abc"[i % 3])
    for i in range(40):  # junk that the labels call bad
        add(" ".join(f"{w}###" for w in rng.choices(VOCABULARY["en"], k=20)), "en", "b")
    for i in range(0, 60, 3):  # near copies and copies
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "changed"
        add(" ".join(words), "en", "c")
        add(rows[i + 1][1], "de", "a")
    rows.extend([rows[4], rows[4]])  # repeated rows
    for text in (None, "", " \n", "12 345 ...", "short text", "the " * 40, "漢字 und Ünïcode ÇA ist das nicht der Fall " * 3):
        add(text, None, None)
    add(rows[5][1] + " and more of it", "en", None, doc_id=False)
    add("the house of the man was in the street and all the people of the town were out for the day", None, "c", doc_id=False)
    labels = [(i, int(i < 160), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (5, None, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, labels = fixture()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def check_language(spark, docs, kept):
    model = language.learn(docs, corpus_pipeline.VOCABULARY)
    vocabulary = language.pieces(corpus_pipeline.VOCABULARY)

    def score(word, row):
        total = np.zeros(len(word) + 1)
        total[0] = 1
        for j in range(1, len(word) + 1):
            for i in range(j):
                piece = vocabulary.get(word[i:j], len(vocabulary) if j - i == 1 else None)
                total[j] += 0 if piece is None else total[i] * np.exp(model.logp[row, piece])
        return math.log(total[-1])

    want = Counter()
    for r in docs.collect():
        words = Counter(w for w in regex.split(r"[^\p{L}\p{M}]+", (r["text"] or "").lower()) if any(map(str.isalpha, w)))
        if words:
            sums = np.array([model.priors[x] + sum(n * score(w, x) for w, n in words.items()) for x in range(len(model.languages))])
            if 1 / np.exp(sums - sums.max()).sum() >= 0.5:
                want[tuple(r)] += 1
    assert bag(kept) == want and 0 < sum(want.values()) < docs.count()


def counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return words, len(covered)


def check_quality(spark, docs, kept, labels):
    judged = quality_rules.with_statistics(docs.select("doc_id", "text")).drop("text")
    rules = quality_rules.learn_from_labels(judged, labels).rules
    assert rules  # the junk is learned
    known = {}
    for r in quality_rules.with_statistics(docs.select("text")).collect():
        words, repeated = counts(r["text"])
        assert (r["n_words"], r["n_repeat_words"]) == (len(words), repeated)
        failed = len(words) < 10 or 100 * repeated > 20 * len(words)
        chars = sum(map(len, words))
        assert r["word_chars"] == chars
        per = lambda a, b: a / b if b else 0.0
        x = {
            "mean_word": per(chars, len(words)), "symbol_share": per(r["n_symbols"], chars), "dup_line_share": per(r["n_dup_lines"], r["n_lines"]),
            "repeat_share": per(repeated, len(words)), "mark_share": per(r["n_marks"], chars), "upper_share": per(r["n_upper"], chars),
            "line_words": per(len(words), r["n_lines"]),
        }
        holds = any(all((x[c.feature] > c.cut) == c.above for c in rule.literals) for rule in rules)
        known[r["text"]] = not failed and not holds
    assert bag(kept) == Counter({row: n for row, n in bag(docs).items() if known[row[1]]})
    assert not any("###" in r["text"] for r in kept.collect())


def check_dedup(docs, kept):
    rows = docs.collect()
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    ids = kept_by_similarity(texts)
    got = Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert set(got) == ids and set(got.values()) == {1}  # repeated rows and equal ids too
    nameless = [r for r in rows if r["doc_id"] is None]
    linked = kept_by_similarity(texts | {10**6 + i: r["text"] for i, r in enumerate(nameless)})  # null ids come last in a group
    assert sum(r["doc_id"] is None for r in kept.collect()) == sum(10**6 + i in linked for i in range(len(nameless)))


def check_mix(spark, docs, mixed):
    rows = docs.collect()
    size = lambda text: len(WORDS.findall(text or ""))
    have = Counter()
    for r in rows:
        have[r["source"]] += size(r["text"])
    names = sorted(have, key=lambda s: (s is None, s or ""))
    left, targets, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(have.values())
    while left:
        unit = (total - sum(targets.values())) / sum(left.values())
        over = [s for s, w in left.items() if w * unit > 2 * have[s] + 1e-9]
        targets |= {s: 2.0 * have[s] for s in over} if over else {s: w * unit for s, w in left.items()}
        left = {s: w for s, w in left.items() if over and s not in over}
    before, after = bag(docs), bag(mixed)
    assert set(after) <= set(before) and all(after[r] <= 2 * n for r, n in before.items())
    took = Counter()
    for r, n in after.items():
        took[r[3]] += n * size(r[1])
    largest = max(size(r["text"]) for r in rows)
    assert all(abs(took[s] - targets[s]) <= largest for s in names)
    report = mixing.mix_report(docs).collect()
    assert {r["source"]: r["target"] for r in report} == pytest.approx(targets)


def check_bpe(docs, encoded):
    import tiktoken

    with open(corpus_pipeline.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r["text"] or "").encode())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encoded.collect()) == want


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "simhash_near_dedup", "mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, folder), f"test_{name}")
        if name != "byte_bpe":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        check = {"language_id": lambda d, o: check_language(spark, d, o), "quality_rules": lambda d, o: check_quality(spark, d, o, labels)}
        check |= {"simhash_near_dedup": check_dedup, "mixing": lambda d, o: check_mix(spark, d, o), "byte_bpe": check_bpe}
        check[name](docs, out)
        docs = out


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), "test_stage")
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == docs.columns and bag(got) == bag(docs) and docs.count() > 50


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_whole_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert set(bag(simhash.drop_near_copies(docs))) <= set(bag(docs))

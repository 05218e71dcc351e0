"""The training-data operators against brute force, libraries and SQL, with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import oracle
from almanac.llm import bpe, chat, language, license_scan, mixing, prefix_forest, quality_rules, sharding, simhash, wavelet
from almanac.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, draw string, kept string"
LONG = " ".join(f"wort{i % 977} über" for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "one", "The same text twice.", "The same text twice.", "a b c d e f g h i j a b c d e f g h i j",
    "line one here\nline one here\n\nother line", "Ünïcode ÇA 漢字  nbsp  x", "<|endoftext|> don't 12,5 $$$ !!", LONG, "...,, 'S",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, ("a", "b", None)[i % 3], 0, "s", "d", "k") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", "en", "a", 0, "s", "d", "k"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORDS.findall(text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert oracle.compare(spark, SF, QUERIES[name], ORACLES[name]) is None


def test_sharding_growth(spark, docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 8)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in rows} == {
        (r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in docs.collect()
    }
    assert sharding.shard_documents(empty).count() == 0


def test_weighted_tree_follows_weights(spark):
    leaves = [sharding.Leaf(0, 0, 0, 3.0), sharding.Leaf(0, 1, 1, 1.0), sharding.Leaf(1, 0, 2, 4.0), sharding.Leaf(1, 1, 3, 0.0)]
    ids = spark.range(8000)
    counts = {r["shard"]: r["count"] for r in sharding.assign(ids, "id", leaves).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 2}
    assert all(abs(counts[s] / 1000 - w) < 0.25 for s, w in ((0, 3), (1, 1), (2, 4)))


def test_statistics(spark, docs, empty):
    judged = quality_rules.judge_documents(docs, spark.createDataFrame([], "doc_id bigint, quality int, text string")).collect()
    assert len(judged) == docs.count()
    want = Counter()
    for r in docs.collect():
        t, w = r["text"] or "", words(r["text"])
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t)
        want[(r["doc_id"], len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed)] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(tuple(r[n] for n in names) for r in judged) == want
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, quality int")
    assert quality_rules.judge_documents(empty, labels).count() == 0


def test_rules_are_learned_and_keep_clean_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        plain = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(w + "###" if i % 4 == 0 else w for w in plain)))
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)], "doc_id bigint, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(made, labels).collect()}
    assert all(kept[i] == (i % 4 > 0) for i in range(400))
    assert {r["doc_id"] for r in quality_rules.keep_documents(made, labels).collect()} == {i for i in range(400) if i % 4}


def fingerprint(text, n=4):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, distance=4):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: fingerprint(t) for i, t in rows.items()}
    want = {i: (format(fps[i], "016x"), c) for i, c in classes(fps).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, SF).collect()} == want


def test_simhash_awkward_rows(spark, docs, empty):
    found = simhash.near_groups(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[5] == 4
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("The same text twice.") == 1 and sum(not words(t) for t in texts) == 1
    copies = docs.union(docs)
    assert simhash.drop_near_copies(copies).count() == kept.count()


def shingles(text, words=5):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def similar(a, b):
    few, many = sorted((len(a), len(b)))
    return a == b or 5 * few >= 4 * many and 5 * len(a & b) >= 4 * len(a | b)


def kept_by_similarity(texts):
    """Smallest ids of the groups that a similarity of 0.8 links, all pairs compared."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {}
    for i in sorted(sets):
        linked = {root[j] for j in root if similar(sets[i], sets[j])}
        root[i] = min(linked, default=i)
        root = {j: root[i] if r in linked else r for j, r in root.items()}
    return set(root.values())


@pytest.mark.parametrize("load", [1_000, simhash.LOAD])
def test_near_copies_by_similarity(spark, load):
    rng = random.Random(3)
    texts = {}
    for length in (7, 12, 30, 80, 200, 400):
        for _ in range(8):
            tokens = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(length)]
            for edits in (0, 0.01, 0.02, 0.04, 0.08):
                copy = [f"new{rng.random()}" if rng.random() < edits else t for t in tokens]
                texts[len(texts)] = " ".join(copy + ["more"] * rng.randrange(3))
    # few bits differ where one passage repeats, whatever else is in the text
    texts |= {len(texts) + i: " ".join(["the", "same", "line"] * 300 + [f"own{i}{j}" for j in range(20)]) for i in range(4)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"] for r in simhash.drop_near_copies(frame, load=load).collect()} == kept_by_similarity(texts)


def test_near_copies_of_the_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(frame.collect())
    assert {r["doc_id"] for r in simhash.drop_near_copies(frame).collect()} == kept_by_similarity(texts)


def test_near_copies_come_from_fingerprints(spark):
    """Classes up to four bits apart are linked by their fingerprints alone, copies of a fingerprint as well, five bits not."""
    assert simhash.set_fingerprint(np.array([0b111, 0b011, 0b001], np.uint64)) == 0b011 and simhash.set_fingerprint(np.empty(0, np.uint64)) == 0
    base = 0x0123456789ABCDEF
    fps = {10: base, 20: base ^ 0b1111, 30: base ^ (0b11111 << 40), 40: base, 50: ~base}
    frame = spark.createDataFrame(list(fps.items()), "cls bigint, fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.fingerprint_edges(frame)).collect()}
    assert roots == {20: 10, 40: 10}
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)))], "doc_id bigint, text string")
    made = simhash.with_sketch(docs, ["doc_id"], 5).first()
    assert made["fp"] == simhash.set_fingerprint(simhash.shingle_set(docs.first()["text"]))


def test_sketch_reaches_the_similarity():
    rng = np.random.default_rng(5)
    missed = 0
    for size in (9, 90, 900):  # 8 of 10, 80 of 100, 800 of 1000 are shared
        for _ in range(700):
            a = rng.integers(0, 1 << 64, size, np.uint64)
            b = np.r_[a[: (8 * size) // 9], rng.integers(0, 1 << 64, size // 9, np.uint64)]
            (ka, sa), (kb, sb) = simhash.sketch(np.unique(a)), simhash.sketch(np.unique(b))
            agree = sum(x == y for x, y in zip(sa, sb, strict=True))
            missed += not set(ka) & set(kb) or agree < simhash.AGREE
    assert missed <= 2


@pytest.mark.parametrize("chunk", [3, 4096])
def test_pigeonhole_finds_every_link(spark, chunk):
    rng = random.Random(1)
    fps = {}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            fps[x] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.bucket_edges(frame, 4, len(fps), chunk)).collect()}
    groups = {}
    for x, c in classes(fps).items():
        groups.setdefault(c, set()).add(signed(x))
    got = {}
    for x in fps:
        got.setdefault(roots.get(signed(x), signed(x)), set()).add(signed(x))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_chain(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    edges = [(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:], strict=False)]
    rows = simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r["root"] for r in rows} == {0} and len({r["node"] for r in rows}) == 299


def test_mixing(spark, docs, empty):
    report = mixing.mix_report(docs).collect()
    assert len(report) == docs.count()
    assert sum(r["target"] for r in {r["source"]: r for r in report}.values()) == pytest.approx(1.5 * sum(r["size"] for r in report))
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in report)
    assert sorted(map(str, report)) == sorted(map(str, mixing.mix_report(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["takes"] for r in report)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_targets_stop_and_share_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    size, weight, left = {"a": 10, "b": 100, "c": 1000, None: 5}, {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * 1115
    want, free = {}, set(size)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    want |= {s: weight[s] * level for s in free}
    assert got == pytest.approx(want)


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 50, 3000), rng.integers(0, 70_000, 2000), np.array([2]), np.zeros(700, np.int64)):
        ids = ids.astype(np.uint32)
        matrix, _, _ = wavelet.unpack(wavelet.pack(wavelet.WaveletMatrix.build(ids), [1], np.array([len(ids)])))
        assert (matrix.ids() == ids).all()
        for at in rng.integers(0, len(ids), 20).tolist():
            t = int(ids[at])
            assert matrix.access(at) == t and matrix.rank(t, at) == int((ids[:at] == t).sum())
            assert matrix.count(t, at // 2, at) == int((ids[at // 2 : at] == t).sum())
        t = int(ids[0])
        assert matrix.occurrences(t) == np.flatnonzero(ids == t).tolist()
        assert matrix.count(99_999) == 0
        cuts = np.sort(rng.integers(0, len(ids) + 1, 30))
        assert matrix.counts(t, cuts[:-1], cuts[1:]).tolist() == [int((ids[a:b] == t).sum()) for a, b in zip(cuts[:-1], cuts[1:])]


@pytest.mark.parametrize("size", [wavelet.CHUNK_BITS - 1, wavelet.CHUNK_BITS, 3 * wavelet.CHUNK_BITS + 700])
def test_a_query_inflates_a_few_chunks(size):
    """Rank, access and select read one or two chunks a plane, whatever the size of the file."""
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 40_000, size).astype(np.uint32)
    ids[rng.integers(0, size, size // 50)] = 7
    blob = wavelet.pack(wavelet.WaveletMatrix.build(ids), [None, 5], np.array([1, size - 1]))
    there = np.flatnonzero(ids == 7)
    for ask, want in (
        (lambda m: m.access(size // 2), int(ids[size // 2])), (lambda m: m.rank(7, size), len(there)),
        (lambda m: m.count(7, size // 3, size // 2), int((ids[size // 3 : size // 2] == 7).sum())),
        (lambda m: m.select(7, len(there) // 2), int(there[len(there) // 2])), (lambda m: m.select(7, 0), int(there[0])),
        (lambda m: m.select(7, len(there) - 1), int(there[-1])),
    ):
        matrix, doc_ids, lengths = wavelet.unpack(blob)
        assert ask(matrix) == want and max(p.inflated for p in matrix.planes) <= 4
    assert doc_ids == [None, 5] and lengths.tolist() == [1, size - 1] and (matrix.ids() == ids).all()
    for at in (0, 1, size - 1, *rng.integers(0, size, 20).tolist()):
        assert matrix.access(at) == ids[at]
    nothing, _, _ = wavelet.unpack(wavelet.pack(wavelet.WaveletMatrix.build(ids[:0]), [], np.zeros(0, np.int64)))
    assert nothing.ids().tolist() == [] and nothing.count(7) == 0


def test_wavelet_documents(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = docs.unionByName(docs.limit(3).withColumn("doc_id", docs["doc_id"] + 70).withColumn("text", F.lit("so<|startoftext|>a <|endoftext|><|ENDOFTEXT|> b, c")))
    for shard_tokens in (1, wavelet.SHARD_TOKENS):
        got = wavelet.read_documents(wavelet.encode_documents(docs, path, shard_tokens=shard_tokens)).collect()
        rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode())))
        want, start = [], 0
        for r in rows:
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
            w for w in want if w[0] is not None
        )
        assert {r["start"] for r in got} == {w[1] for w in want}
        assert all(r["n_ends"] == 1 for r in got)
    assert wavelet.read_documents(wavelet.encode_documents(empty, path)).count() == 0


def test_bpe_matches_the_library(spark, docs, empty):
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), digest(np.array(ids, "<u4").tobytes()), digest((r["text"] or "").encode()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == [c for c in docs.columns if c != "text"] + ["ids"]
    decoded = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect()
    assert Counter(bytes(r["decoded"]).decode() for r in decoded) == Counter(r["text"] or "" for r in docs.collect())
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    long_match = "ab" * 150  # more contractions than one query makes
    assert np.frombuffer(own.encode([long_match])[0], "<u4").tolist() == library.encode_ordinary(long_match)


def test_language_forward_sums_all_segmentations():
    vocabulary = language.pieces(RANKS)
    rng = np.random.default_rng(0)
    model = language.Model(RANKS, ["x", "y"], np.zeros(2), np.log(rng.random((2, len(vocabulary) + 1)) / 100))
    longest = sorted(vocabulary, key=len)[-3:]
    assert min(map(len, longest)) > 12
    tested = ["then", "über", "a", "漢字", "thetionth", "understandings", *longest, "x".join(longest)]

    def brute(word, row):
        total = np.zeros(len(word) + 1)
        total[0] = 1
        for j in range(1, len(word) + 1):
            for i in range(j):
                piece = vocabulary.get(word[i:j], len(vocabulary) if j - i == 1 else None)
                if piece is not None:
                    total[j] += total[i] * np.exp(model.logp[row, piece])
        return np.log(total[-1])

    assert model.score(tested) == pytest.approx(np.array([[brute(w, 0), brute(w, 1)] for w in tested]))


def test_a_rare_language_is_learned(spark):
    """A hundred rows among a hundred thousand: all of them are learned from, and its texts are told from the others."""
    assert language.quotas({"a": 10, "b": 1_000, "c": 90_000}, 600) == {"a": 10, "b": 295, "c": 295}
    assert language.quotas({"a": 10, "b": 20}, 600) == {"a": 10, "b": 20} and language.quotas({}, 5) == {}
    common = spark.range(100_000).selectExpr("id as doc_id", "'en' as lang", "concat('the house and the street of number ', id % 97) as text")
    rare = spark.range(100).selectExpr("id + 200000 as doc_id", "'fi' as lang", "concat('talo ja katu sekä kylä numero ', id % 97) as text")
    sizes = {"en": 100_000, "fi": 100}
    drawn = language.training_rows(common.unionByName(rare), sizes, 2_000).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in drawn}["fi"] == 100 and abs({r["lang"]: r["count"] for r in drawn}["en"] - 1_900) < 200
    model = language.learn(common.unionByName(rare), RANKS, 2_000)
    assert model.languages == ["en", "fi"] and np.exp(model.priors).sum() == pytest.approx(1)
    assert np.exp(model.priors)[1] < 0.002
    texts = spark.createDataFrame([(1, "kylä ja talo"), (2, "the house")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(texts, model, ["doc_id"]).collect()} == {1: "fi", 2: "en"}


def test_predictions_equal_brute_force(spark, docs):
    """Language and posterior of every text by a plain forward sum over the learned probabilities."""
    model = language.learn(docs, RANKS)
    vocabulary = language.pieces(RANKS)

    def word_score(word, row):
        total = np.zeros(len(word) + 1)
        total[0] = 1
        for j in range(1, len(word) + 1):
            for i in range(j):
                piece = vocabulary.get(word[i:j], len(vocabulary) if j - i == 1 else None)
                total[j] += 0 if piece is None else total[i] * np.exp(model.logp[row, piece])
        return np.log(total[-1])

    found = {(r["doc_id"], r["text"]): r for r in language.predict(docs, model, ["doc_id", "text"]).collect()}
    for (_, text), r in found.items():
        words = [w for w in regex.split(r"[^\p{L}\p{M}]+", (text or "").lower()) if any(map(str.isalpha, w))]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        uses = Counter(words)
        known = [model.priors[x] + sum(n * word_score(w, x) for w, n in uses.items()) for x in range(len(model.languages))]
        odds = np.exp(np.array(known) - max(known))
        assert r["lang_pred"] == model.languages[int(odds.argmax())] and r["score"] == pytest.approx(odds.max() / odds.sum())


def test_language_held_out(spark, docs, empty):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, RANKS).collect()}
    assert len(found) == 13 and found[0] == found[1] == found[2] == "und" and found[3] == "en"
    assert language.identify(empty, RANKS).count() == 0
    unlabelled = docs.withColumn("lang", docs["draw"].substr(9, 1)).where("lang <> ''")
    assert language.identify(unlabelled, RANKS).count() == 0
    kept = language.keep_identified(docs, RANKS)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:900] = x[700]  # copies are all measured
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)]
    odd = [(5000, None, ""), (5100, [0.0] * 16, ""), (5200, [float("nan")] + [1.0] * 15, ""), (5300, [None] + [1.0] * 15, "")]
    schema = "vec_id bigint, embedding array<float>, rank string"
    vectors = spark.createDataFrame(rows + odd, schema)
    got = {}
    for r in prefix_forest.search(vectors, vectors.where("vec_id % 100 = 0"), block_rows=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 100))
    hit = 0
    for q, near in got.items():
        distance = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        distance[q] = np.inf
        best = np.lexsort((np.arange(1500), distance))[:10]
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 11)) and all(s == distance[v] for _, v, s in near)
        hit += len(set(best.tolist()) & {v for _, v, _ in near})
    assert hit >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[700]] == list(range(701, 711))
    few = spark.createDataFrame(rows[:4], schema)
    assert prefix_forest.search(few, few.where("vec_id = 0")).count() == 3
    nothing = spark.createDataFrame([], schema)
    assert prefix_forest.search(nothing, nothing).count() == 0


def test_chat_events_fold(spark):
    log = [
        (1, "a", 1, "message", "user", "hi"), (1, "b", 2, "message", "assistant", "He"), (1, "b", 4, "delta", None, "lo"),
        (1, "a", 5, "edit", None, "hello"), (1, "b", 6, "regenerate", None, None), (1, "b", 8, "delta", None, " you"),
        (1, "b", 7, "delta", None, "Hey"), (1, "c", 9, "delta", "tool", None), (None, "z", 1, "message", None, "x"),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, message string, seq bigint, kind string, role string, text string")
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold_events(events).collect()}
    assert got == {(1, "a"): ("user", "hello"), (1, "b"): ("assistant", "Hey you"), (1, "c"): ("tool", ""), (None, "z"): ("", "x")}


def test_chat_escapes_read_back(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "\\", "\\l|", "<|im_end|>\n", "a\\<|b\\\\", "<<SYS>>\n[INST]", "<\\|", "|x", "é漢\\n", "<" * 3 + "|" + "x" * 9000]
    rows = [(c, t, role, text) for c in (1, None) for t, text in enumerate(nasty) for role in ("user\n<|", "assistant")]
    rows += [(1, 3, "user", None), (1, 3, None, "x"), (2, None, "assistant", None), (1, 3, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    shown = chat.render(chat.fold_events(chat.row_events(frame)))
    read = shown.withColumn("turns", chat.read_back(shown["formatted"])).withColumn("loss", chat.read_loss(shown["formatted"], shown["loss_spans"]))
    for r in read.collect():
        own = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in own]
        assert r["loss"] == "".join(text for _, role, text in own if role == "assistant")
        inside = r["formatted"].replace(chat.OPEN, "").replace(chat.CLOSE, "")
        assert not any(control in inside for control, _ in chat.CONTROLS)
    assert chat.render(chat.fold_events(chat.row_events(frame.limit(0)))).count() == 0


def test_license_inheritance(spark):
    rows = [
        ("a/LICENSE", 1, "Released under the MIT License."), ("a/b/c/x", 2, "code"), ("a/b/LICENSE", 3, "text\nLicensed under the Apache License, Version 2.0."),
        ("a/y", 4, None), ("z/x", 5, ""), (None, 6, "no licence to speak of, strange words only"), ("ab/x", 7, "code"), ("a/b/c/x", 2, "code"),
    ]
    frame = spark.createDataFrame(rows, "path string, rank bigint, text string")
    got = Counter((r["path"], r["license"], r["origin"], r["from_dir"]) for r in license_scan.scan(frame).collect())
    assert got == Counter({
        ("a/LICENSE", "MIT", "own", None): 1, ("a/b/c/x", "Apache-2.0", "inherited", "a/b"): 2, ("a/b/LICENSE", "Apache-2.0", "own", None): 1,
        ("a/y", "MIT", "inherited", "a"): 1, ("z/x", None, "none", None): 1, ("", None, "none", None): 1, ("ab/x", None, "none", None): 1,
    })
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_license_statements_without_a_cue(spark):
    rows = [(f"t{i}/x", i, f"some code\n{t}\nmore code") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    wrapped = "Permission is\nhereby granted, free\nof charge, to any person\nobtaining a\ncopy of this software"
    rows += [("r/x", 50, "prose\nAll rights reserved."), ("w/x", 51, f"code\n\n{wrapped}\n\ncode"), ("n/x", 52, "The rights of any person to this copy.")]
    rows += [(f"p{i}/x", 60 + i, f"Line {i} of the prose is to any person as it was.\nNo copy {i}.") for i in range(200)]
    frame = spark.createDataFrame(rows, "path string, rank bigint, text string")
    got = {r["path"]: (r["license"], r["score"]) for r in license_scan.scan(frame).collect()}
    for i, (name, _) in enumerate(license_scan.TEMPLATES):
        assert got[f"t{i}/x"] == (name, 1.0)
    assert got["r/x"][0] == "proprietary" and got["w/x"] == ("MIT", 1.0)
    assert all(got[f"p{i}/x"][0] is None for i in range(200))


def test_license_files_and_awkward_texts(spark):
    """Whole licence files wrapped anywhere, very long lines, extra columns; the query finds statements without a cue."""
    bodies = [(name, text) for name, text in license_scan.TEMPLATES if len(text) > 200]
    assert len(bodies) >= 10
    rng = random.Random(2)
    rows = []
    for i, (_, text) in enumerate(bodies):
        wrapped = "".join(("\n" if c == " " and rng.random() < 0.15 else c) for c in text)
        rows.append((f"b{i}/LICENSE", i, f"Copyright (c) 2020 somebody\n\n{wrapped}\n", "s", "l"))
    rows += [("long/x", 90, "word " * 200_000 + bodies[0][1][:30], "s", "l"), ("crlf/x", 91, "a\r\n\r\nAll rights reserved.\r\n", "s", "l")]
    rows += [("quote/x", 92, "it's \"quoted\" \\ $1", None, None), ("null/x", 93, None, "s", "l")]
    frame = spark.createDataFrame(rows, "path string, rank bigint, text string, score string, lines string")
    found = license_scan.scan(frame.select("path", "rank", "text")).collect()
    got = {r["path"]: (r["license"], r["score"]) for r in found}
    for i, (name, _) in enumerate(bodies):
        assert got[f"b{i}/LICENSE"][0] == name and got[f"b{i}/LICENSE"][1] > 0.95
    assert got["crlf/x"][0] == "proprietary" and got["long/x"][0] is got["quote/x"][0] is got["null/x"][0] is None
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '(^|\\n)All rights reserved[.](\\n|$)'")
    alone = {r["doc_id"] for r in docs.collect()}
    told = {r["doc_id"]: r["license"] for r in QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01").collect() if r["origin"] == "own"}
    assert len(alone) >= 7 and all(told[i] is not None for i in alone)


def test_any_word():
    words = {"a", "an", "and", "any", "b2", "the"}
    found = re.compile(license_scan.any_word(words))
    assert [m for m in found.findall("an and anyone any2 a b2 the2 the, b 2a")] == ["an", "and", "a", "b2", "the"]
    assert not re.search(license_scan.any_word(set()), "a b")


def test_portions_and_recent():
    from almanac.llm.cache import Recent, portions

    assert [len(p) for p in portions(pa.array(["aa", None, "bbb", "c"]), 3)] == [2, 1, 1]
    made = []
    recent = Recent(3)
    for wanted in ({"a", "b"}, {"b", "c"}, {"a", "d"}, {"e"}):
        known = recent.know(wanted, lambda new: [made.append(w) or w * 2 for w in new])
        assert all(known[w] == w * 2 for w in wanted)
    assert sorted(made) == ["a", "b", "c", "d", "e"]

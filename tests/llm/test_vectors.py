"""Part codes and whitening against brute force, with awkward rows."""

import math

import numpy as np
import pytest

from almanac.llm import member_lloyd, vectors, whitening
from almanac.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
ROWS = "vec_id bigint, embedding array<double>, label int, error string, x string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "e", "x", "c") for r in rows], ROWS)


def sample(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((5, dim))
    return (middles[rng.integers(0, 5, n)] + rng.standard_normal((n, dim)) * 0.3) * 0.2


def awkward(spark, dim=16):
    x = sample(120, dim)
    rows = [(i, v.tolist(), (i % 3) or None) for i, v in enumerate(x)]
    rows += [rows[5], (5, x[7].tolist(), 9), (None, x[8].tolist(), None), (None, x[8].tolist(), 1)]
    rows += [(900 + i, x[9].tolist(), 2) for i in range(60)]  # a third of all rows is one vector
    rows += [(-1, None, 1), (-2, [NAN] * dim, 1), (-3, [INF] + [0.0] * (dim - 1), 1), (-4, [None] + [0.0] * (dim - 1), 1)]
    rows += [(-5, [], 1), (-6, [1.0, 2.0], 1), (-7, [0.0] * dim, None)]
    return frame(spark, rows)


def usable(df):
    rows = [r for r in df.collect() if r["embedding"] is not None and len(r["embedding"]) > 2]
    return [r for r in rows if all(v is not None and math.isfinite(v) for v in r["embedding"])]


def lloyd(rows, scale=4096):
    """Plain loops over Python integers."""
    rows = sorted(rows, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["embedding"]))
    x = [[math.floor(scale * v) for v in r["embedding"]] for r in rows]
    dim = len(x[0])
    cuts = [(p * dim // 8, (p + 1) * dim // 8) for p in range(8)]
    books = [[v[a:b] for v in x[:16]] for a, b in cuts]

    def place(part, book):
        return min((sum((s - t) ** 2 for s, t in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(6):
        for p, (a, b) in enumerate(cuts):
            members = {}
            for v in x:
                members.setdefault(place(v[a:b], books[p])[1], []).append(v[a:b])
            for e, held in members.items():
                books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    found = [[place(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)] for v in x]
    return [(r["vec_id"], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), r["label"]) for r, f in zip(rows, found)], books


@pytest.mark.parametrize("partitions", [1, 7])
def test_codes_of_awkward_rows(spark, partitions):
    df = awkward(spark)
    want, books = lloyd(usable(df))
    per_label = {}
    for _, _, error, label in want:
        per_label[label] = per_label.get(label, 0) + error
    got = member_lloyd.compress(df.repartition(partitions)).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    expected = [(i, c, e, per_label[label]) for i, c, e, label in want]
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got], key=key) == sorted(expected, key=key)
    assert {r["codebooks_sha256"] for r in got} == {member_lloyd.digest([np.array(b) for b in books])}


def test_codes_of_few_and_huge_values(spark):
    few = frame(spark, [(i, [float(i), -1.5, 0.25], i) for i in range(3)])  # shorter than the parts, fewer than the entries
    want, _ = lloyd(usable(few))
    got = member_lloyd.compress(few).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == [(i, c, e) for i, c, e, _ in want]
    huge = frame(spark, [(i, [(-1.0) ** i * 2.0**80 * i] * 8, 0) for i in range(20)])
    want, books = lloyd(usable(huge))
    got = member_lloyd.compress(huge).collect()
    assert sorted((r["vec_id"], r["code"]) for r in got) == [(i, c) for i, c, _, _ in want]
    assert {r["codebooks_sha256"] for r in got} == {member_lloyd.digest([np.array(b, object) for b in books])}
    empty = frame(spark, [])
    assert member_lloyd.compress(empty).columns == member_lloyd.compress(few).columns
    assert member_lloyd.compress(empty).count() == 0
    assert member_lloyd.compress(frame(spark, [(1, None, 1)])).count() == 0


def test_members_that_stay_do_not_move(spark):
    """The union of those that stay and those that come keeps the partitioning, and no part is lost."""
    kept, dim = vectors.whole(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(sample(500))]))
    books = member_lloyd.first_books(kept, dim)
    members = member_lloyd._scatter(kept, dim, books, 8, 6).persist()
    books = member_lloyd._updated(members, books, 8)
    after = member_lloyd._migrate(members, books, 8, 6).persist()
    assert members.getNumPartitions() == after.getNumPartitions() == 6
    assert "PartitionerAwareUnionRDD" in after.toDebugString().decode()
    assert after.map(lambda b: len(b[1])).sum() == 500 * 8
    at_home = after.mapPartitionsWithIndex(lambda i, blocks: [cell % 6 == i for cell, _ in blocks]).collect()
    assert all(at_home)
    for cell, x in after.collect():  # every member lies with its nearest entry
        position, entry = divmod(cell // 8, 16)
        assert (member_lloyd.nearest(x, books[position])[0] == entry).all()
    members.unpersist()
    after.unpersist()


def covariance(rows):
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r["embedding"]] for r in rows], object)
    fit = np.array(sorted({tuple(v) for v in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((fit * n - s) / n).astype(float)
    return x, n, s, centred, centred.T @ centred / n


@pytest.mark.parametrize("awkward_rows", [True, False])
def test_whitening(spark, awkward_rows):
    df = awkward(spark, 24) if awkward_rows else spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = usable(df)
    x, n, s, centred, v = covariance(rows)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(rows) and {r["component"] for r in got} == set(range(1, 17))
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    for r in got:
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(v)) - 1) < 1e-9
    want = {}
    for r, row in zip(rows, x):
        deviation = int(sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)))
        white = np.abs(((row * n - s) / n).astype(float) @ basis[:, :16] / np.sqrt(values[:16]))
        want.setdefault((r["vec_id"], deviation), []).append(white)
    for r in got:
        near = want[(r["vec_id"], r["deviation"])]
        assert min(abs(abs(r["whitened"]) - w[r["component"] - 1]) for w in near) < 1e-7


def test_whitening_without_spread(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [NAN], 1)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [], 1)])).count() == 0
    # a constant, a copied and a free column: one direction each of spread
    rng = np.random.default_rng(3)
    flat = [(i, [1.0, float(a), float(a), float(b)], 1) for i, (a, b) in enumerate(rng.standard_normal((200, 2)) * 5)]
    got = whitening.whiten(frame(spark, flat)).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert max(r["identity_error"] for r in got) < 1e-6
    with pytest.raises(Exception, match="or larger"):
        whitening.whiten(frame(spark, [(1, [1e200], 1), (2, [0.0], 1)])).count()


def test_deviation_beyond_a_long(spark):
    rows = frame(spark, [(i, [float(i) * 2**30, 1.0], 1) for i in range(4)])
    assert {r["deviation"] for r in whitening.whiten(rows).collect()} == {None}


def test_factor_of_nearly_dependent_columns(spark):
    """Condition far beyond what a Cholesky factor of the covariance would bear: the composed factor still has orthogonal rows."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**26), 2**26, (3_000, 1))
    x = np.concatenate([base, base + rng.integers(-1, 2, (3_000, 1)), rng.integers(-5, 6, (3_000, 1))], axis=1)
    df = spark.createDataFrame([(i, [float(v) / 64 for v in row], 0) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    kept, dim = vectors.whole(df)
    fit = whitening.quantised(kept).select("x").distinct()
    middle = whitening.centre(fit, dim)
    sizes = np.linalg.svd(whitening.triangular(fit, dim, middle))[1]
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert want[0] / want[-1] > 1e7
    assert np.allclose(sizes, want, rtol=1e-6)


def test_queries_give_the_contract(spark):
    columns = {"vec_id", "code", "error", "label_error", "codebooks_sha256"}
    assert columns == set(QUERIES["op11_member_lloyd"](spark, SF).columns)

"""Statistics against textbook values, brute force and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.functions import dist
from almanac.operators import aggregates, elections, evaluation, modelling, ranks
from almanac.operators import statistics as st


def test_tail_probabilities():
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-12)
    assert dist.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.t_two_sided(0.0, 5) == 1.0
    assert dist.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_two_by_two_known_table(spark):
    cells = spark.createDataFrame([(852, 1017, 282, 398)], "a long, b long, c long, d long")
    r = st.two_by_two_statistics(cells).first()
    assert round(r.chi2, 3) == 3.419 and round(r.phi, 4) == 0.0366
    assert round(r.odds_ratio, 3) == 1.182 and round(r.or_low, 2) == 0.99 and round(r.or_high, 3) == 1.411
    assert r.phi**2 * 2549 == pytest.approx(r.chi2)


def test_friedman_textbook(spark):
    rows = [(i, *map(float, v)) for i, v in enumerate([(7, 9, 8), (6, 5, 7), (9, 7, 6), (8, 5, 6)])]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    r = st.friedman(df, ["a", "b", "c"]).first()
    ranks_ = np.array([[1, 3, 2], [2, 1, 3], [3, 2, 1], [3, 1, 2]]).sum(axis=0)
    assert r.chi2 == pytest.approx(12 / (4 * 3 * 4) * (ranks_**2).sum() - 3 * 4 * 4)
    zeros = df.unionByName(spark.createDataFrame([(9, 0.0, 0.0, 0.0)], df.schema))
    assert st.friedman(zeros, ["a", "b", "c"]).first().chi2 == pytest.approx(r.chi2)  # an all-equal row adds only ties


def brute_rank(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def data(spark, n=120, seed=5):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("abc"), float(rnd.randrange(8)), float(rnd.randrange(6))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, g string, v double, w double")


def test_kruskal_and_u_test_by_hand(spark):
    rows, df = data(spark)
    v = [r[2] for r in rows]
    r = dict(zip([x[0] for x in rows], brute_rank(v)))
    n = len(rows)
    ties = sum(v.count(x) ** 3 - v.count(x) for x in set(v))
    s = 0
    for g in "abc":
        rs = [r[x[0]] for x in rows if x[1] == g]
        s += sum(rs) ** 2 / len(rs)
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert st.kruskal(df, "g", "v").first().H == pytest.approx(h)
    a, b = [x[2] for x in rows if x[1] == "a"], [x[2] for x in rows if x[1] == "b"]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    got = st.mann_whitney(df, "g", "v", "a", "b").first()
    assert got.U == u and got.rank_biserial == pytest.approx(1 - 2 * u / (len(a) * len(b)))
    single = df.unionByName(spark.createDataFrame([(999, "z", 3.0, 0.0)], df.schema))
    assert st.kruskal(single, "g", "v").first().n_groups == 3  # a group of one drops out


def test_wilcoxon_by_hand_and_all_zero(spark):
    rows, df = data(spark)
    d = [a - b for _, _, a, b in rows if a != b]
    r = brute_rank([abs(x) for x in d])
    plus, minus = sum(q for q, x in zip(r, d) if x > 0), sum(q for q, x in zip(r, d) if x < 0)
    got = st.wilcoxon(df, "v", "w").first()
    assert got.stat == min(plus, minus) and got.n == len(d)
    same = st.wilcoxon(df, "v", "v").first()
    assert (same.stat, same.p) == (0.0, 1.0)


def test_adjustments_are_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.002, 0.5, 0.04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id int, p double")
    got = {r.id: r.p_adj for r in st.adjust(df, "p").collect()}
    order = sorted(range(6), key=lambda i: p[i])
    want, low = {}, 1.0
    for rank in range(6, 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * 6 / rank)
        want[i] = low
    assert all(got[i] == pytest.approx(want[i]) for i in range(6))
    assert {r.id: r.p_adj for r in st.adjust(df, "p", "bonferroni").collect()}[4] == 1.0


def test_percentiles_and_later_minimum_in_slices(spark, monkeypatch):
    rows, df = data(spark)
    monkeypatch.setattr(ranks, "order_bounds", lambda *a, **k: [2.0, 4.0])
    got = ranks.percentiles(df, "v", {"a": 0.25, "b": 0.9}, ["g"]).collect()
    for r in got:
        v = [x[2] for x in rows if x[1] == r.g]
        assert (r.a, r.b) == (pytest.approx(np.percentile(v, 25)), pytest.approx(np.percentile(v, 90)))


def test_outlier_rules(spark):
    n = [0, 0, 1, 2, 3, 2, 1, 0, 400]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "id int, n long")
    z = np.log1p(n)
    want = (z - z.mean()) / z.std()
    got = {r.id: r.zscore for r in aggregates.find_outliers(df).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in range(len(n)))


def test_mardia_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(2.0, size=(60, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    c = x - x.mean(axis=0)
    m = c @ np.linalg.inv(np.cov(x.T, bias=True)) @ c.T
    got = st.mardia(df, ["a", "b"]).first()
    assert got.skewness == pytest.approx((m**3).mean()) and got.kurtosis == pytest.approx((np.diag(m) ** 2).mean())


def test_bootstrap_interval_brackets_mean(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.poisson(3, size=400).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = st.bootstrap_interval(df, "v", reps=2000).first()
    half = 1.96 * v.std() / math.sqrt(len(v))
    assert r.ci_lo == pytest.approx(v.mean() - half, abs=0.04) and r.ci_hi == pytest.approx(v.mean() + half, abs=0.04)
    monkeypatch.setattr(st, "order_bounds", lambda *a, **k: [1.0, 3.0])
    sliced = st.bootstrap_interval(df, "v", reps=2000).first()
    assert sliced.ci_lo == pytest.approx(r.ci_lo, abs=0.04)


def test_lees_l_equals_matrices(spark):
    rng = np.random.default_rng(4)
    n, k = 40, 3
    x, y = rng.normal(size=n), rng.normal(size=n)
    w = np.zeros((n, n))
    edges = []
    for i in range(n):
        for j in rng.choice([q for q in range(n) if q != i], k, replace=False):
            w[i, j] = 1 / k
            edges.append((i, int(j), 1 / k))
    zx, zy = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    values = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    e = spark.createDataFrame(edges, "id long, neighbour long, weight double")
    got = st.lees_l(values, e, "x", "y").first()
    lee = zx @ (w.T @ w) @ zy / (np.ones(n) @ (w.T @ w) @ np.ones(n))
    assert got.lees_l == pytest.approx(lee) and got.morans_i_x == pytest.approx(zx @ w @ zx / (zx @ zx))
    local = sum(r.local_l for r in st.local_lees_l(values, e, "x", "y").collect())
    assert local == pytest.approx(n * lee)
    p = st.permutation_test(values, e, "x", "y", perms=300).first()
    assert p.lees_l == pytest.approx(lee) and abs(p.perm_mean) < 0.05 and 0 < p.p_two_sided <= 1
    assert p.p_one_sided * 301 == pytest.approx(round(p.p_one_sided * 301))



def test_density_clusters_equal_brute_force(spark):
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(90)]
    pts += [(100 + i, 10.0, 10.0) for i in range(20)]
    eps, least = 5.0, 4
    near = {p[0]: [q[0] for q in pts if math.dist(p[1:], q[1:]) <= eps] for p in pts}
    core = {i for i, v in near.items() if len(v) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in label:
                    label[j] = i
                    stack += [q for q in near[j] if q in core]
    want = {i: label[i] if i in core else min((label[q] for q in near[i] if q in core), default=-1) for i in near}
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r.cluster for r in modelling.density_clusters(df, "id", "x", "y", eps, least, 64.0).collect()}
    assert got == want


def test_roc_auc_groups_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (1, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert modelling.roc_auc(df, "y", "s").first().auc == pytest.approx(want)


def test_best_threshold_is_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.2)], "y int, s double")
    r = modelling.best_threshold(modelling.threshold_sweep(df, "y", "s")).first()
    assert r.f1 == 1.0 and r.threshold == pytest.approx(min(t for t in np.linspace(0.01, 0.99, 200) if t > 0.2))


def test_kappa_cases(spark):
    kappa = lambda rows: evaluation.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert kappa([("x", "x"), ("y", "y")]).kappa == 1.0
    assert kappa([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]).kappa == pytest.approx(0.0)
    assert kappa([("x", "x"), ("x", "x")]).kappa == 1.0  # one empty class
    three = spark.createDataFrame([("x", "x", "x"), ("x", "y", "x"), ("y", "y", "y"), ("x", "?", "x")], "a string, b string, c string")
    r = evaluation.fleiss_kappa(three, ["a", "b", "c"], ["x", "y"]).first()
    p_bar, p_e = (1 + 1 / 3 + 1) / 3, (5 / 9) ** 2 + (4 / 9) ** 2
    assert r.n == 3 and r.kappa == pytest.approx((p_bar - p_e) / (1 - p_e))


def test_winner_null_order_and_ties(spark):
    rows = [("d1", "a", 5), ("d1", "b", 5), ("d2", "a", None), ("d2", "b", 9), ("d3", "a", 1)]
    df = spark.createDataFrame(rows, "race string, c string, v long")
    got = lambda **kw: sorted((r.race, r.c) for r in elections.winners(df, ["race"], "v", **kw).collect())
    assert got() == [("d1", "a"), ("d1", "b"), ("d2", "a"), ("d3", "a")]
    assert got(reject_nulls=True, ties="one", ids=["c"]) == [("d1", "a"), ("d2", "b"), ("d3", "a")]


def test_uncontested_race_drops_out(spark):
    df = spark.createDataFrame([("d1", "D", 3), ("d1", "R", 1), ("d2", "D", 9)], "d string, p string, v long")
    got = elections.two_party_share(df, ["d"], "p", "v", "D", "R").collect()
    assert [(r.d, r.share, r.winner) for r in got] == [("d1", 0.75, "D")]
    side = df.select(elections.party_side(F.lit(" Democratic-NPL ")).alias("s")).first().s
    assert side == "Dem"

"""Projection and boosted trees against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import aggregates, modelling


def test_projection_by_variance_is_returned_and_centred(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ np.diag([5.0, 3.0, 1.0, 0.2, 0.1, 0.05]) + 7.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    train, test, keep = modelling.pca_by_variance(df.where("id < 150"), df.where("id >= 150"), "v", 0.95)
    mean = x[:150].mean(axis=0)
    _, s, vt = np.linalg.svd(x[:150] - mean, full_matrices=False)
    share = np.cumsum(s**2) / (s**2).sum()
    assert keep == int(np.searchsorted(share, 0.95)) + 1
    for frame, rows in ((train, x[:150]), (test, x[150:])):
        got = np.array([r["v"] for r in frame.orderBy("id").collect()])
        want = (rows - mean) @ vt[:keep].T
        assert got.shape == want.shape and np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    fitted = np.array([r["v"] for r in train.collect()])
    assert np.abs(fitted.mean(axis=0)).max() < 1e-8


def test_boosted_trees_stop_early_and_rank(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] * x[:, 1] > 0.4) | (x[:, 2] > 1.4)).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    train, test = df.where("id < 350"), df.where("id >= 350")
    scored, trees = modelling.boosted_trees(train, test, "v", "y", "id", rounds=30, depth=3, step=0.3, patience=4)
    assert 3 <= trees <= 30 and scored.count() == 150
    few, two = modelling.boosted_trees(train, test, "v", "y", "id", rounds=2, depth=3, step=0.3, patience=4)
    assert two <= 2 and few.columns == ["id", "y", "score"]
    auc = modelling.roc_auc(scored, "y", "score").select("auc").first()["auc"]
    assert auc > 0.75


def test_listed_values_are_one_array_per_key(spark):
    df = spark.range(2_500).select(F.when(F.col("id") < 2_400, "big").otherwise("small").alias("k"), (F.col("id") % 1_800).alias("v"))
    got = {r["k"]: r["items"] for r in aggregates.listed_values(df, "k", "v").collect()}
    assert got["big"] == list(range(1_800)) and len(got["small"]) == 100
    parts = aggregates.listed_values(df, "k", "v", 500).collect()
    assert sorted(v for r in parts if r["k"] == "big" for v in r["items"]) == list(range(1_800)) and len(parts) == 5


@pytest.mark.parametrize("metres, tier", [(25_000.0, "close"), (50_000.0, "medium"), (50_000.1, "far")])
def test_all_tiers_hold_rows(spark, metres, tier):
    got = {r["tier"]: r["n"] for r in aggregates.tier_table(spark.createDataFrame([(metres, 1)], "m double, n int"), "m", "n").collect()}
    assert got[tier] == 1 and sum(got.values()) == 1


def test_density_clusters_of_a_crowd_send_few_rows_to_look_for_other_clusters(spark, monkeypatch):
    """Spots of one dense area are one cluster already by one spot for each part of a cell."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(10, 30, 6000), rng.uniform(10, 30, 6000)
    x, y = np.append(x, [50.0, 50.1, 50.2, 33.0]), np.append(y, [50.0, 50.0, 50.0, 20.0])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    asked, plain = [], modelling.nearest

    def counted(q, t, coords, k, lo, hi, dist, rule):
        if rule == "other":
            asked.append(q.count())
        return plain(q, t, coords, k, lo, hi, dist, rule)

    monkeypatch.setattr(modelling, "nearest", counted)
    got = {r.id: r.cluster for r in modelling.density_clusters(df, "id", "x", "y", 10.0, 3, 64.0).collect()}
    assert {got[i] for i in range(6000)} == {0} and [got[i] for i in range(6000, 6004)] == [6000] * 3 + [0]
    assert sum(asked) < 3000

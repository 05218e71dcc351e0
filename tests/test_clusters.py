"""Cell tree, clustering quality and k-means against all pairs and plain loops."""

import numpy as np
import pandas as pd
import pytest

from almanac.operators import clusters

COLUMNS = ["a", "b", "c"]


def all_pairs(x, label):
    """Mean silhouettes of plain and squared distances."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    out = []
    for power in (1, 2):
        total = np.stack([(d[:, label == c] ** power).sum(axis=1) for c in np.unique(label)], axis=1)
        sizes = np.array([(label == c).sum() for c in np.unique(label)])
        own = np.searchsorted(np.unique(label), label)
        at = np.arange(len(x))
        a = total[at, own] / np.maximum(sizes[own] - 1, 1)
        rest = total / sizes
        rest[at, own] = np.inf
        b = rest.min(axis=1)
        top = np.maximum(a, b)
        s = np.divide(b - a, top, out=np.zeros_like(a), where=top > 0)
        out.append(float(np.where(sizes[own] > 1, s, 0).mean()))
    return out


def blobs(n, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * 0.5 + rng.integers(0, 3, size=(n, 1)) * [3.0, 1.0, -2.0]
    x[:copies] = x[0]
    return x, np.minimum(rng.integers(0, 4, n), (x[:, 0] > 1.5) + 2 * (x[:, 0] > 4)).astype(int)


def frame(spark, x, label):
    rows = [(*map(float, r), int(c)) for r, c in zip(x, label)]
    return spark.createDataFrame(rows, "a double, b double, c double, g int")


def test_exact_with_a_cell_per_row(spark):
    x, label = blobs(300, copies=100)
    x = np.round(x, 1)
    got = clusters.quality(frame(spark, x, label).repartition(5), COLUMNS, ["g"], tolerance=0.0)["g"]
    want, square = all_pairs(x, label)
    assert got.silhouette == pytest.approx(want, abs=1e-9) and got.error < 1e-9
    assert got.silhouette_sq == pytest.approx(square, abs=1e-9)


@pytest.mark.parametrize("leaves, tolerance", [(4_096, 0.01), (256, 0.0), (64, 0.05), (1, 0.0)])
def test_error_bound_on_five_thousand_rows(spark, leaves, tolerance):
    x, label = blobs(5_000, seed=2, copies=1_700)
    got = clusters.quality(frame(spark, x, label), COLUMNS, ["g"], leaves, tolerance)["g"]
    want, square = all_pairs(x, label)
    assert abs(got.silhouette - want) <= got.error + 1e-9
    assert got.silhouette_sq == pytest.approx(square, abs=1e-9)
    if leaves >= 256:
        assert got.error < 0.05 and abs(got.silhouette - want) < 0.01


def test_near_cells_only_are_opened():
    """Far cells are taken whole: the walk visits a small part of the nodes for a loose tolerance, all leaves for none."""
    x, label = blobs(3_000, seed=4)
    tree = clusters.cell_tree(x, 3_000)
    leaf = tree.leaf_of(x)
    assert len(np.unique(leaf)) == 3_000  # a cell per distinct row
    found = pd.DataFrame(x, columns=["s0", "s1", "s2"]).assign(leaf=leaf, c=label, w=1)
    for i in range(3):
        found[f"q{i}"], found[f"lo{i}"], found[f"hi{i}"] = x[:, i] ** 2, x[:, i], x[:, i]
    sums = clusters._node_sums(found, 3, tree)
    d = np.sqrt(((x[:50, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    want = np.stack([d[:, label == c].sum(axis=1) for c in range(sums.weight.shape[1])], axis=1)
    for tolerance in (0.0, 0.02, 0.2):
        least, most = clusters.mean_distances(x[:50], tree, sums, tolerance)
        assert (least <= want * (1 + 1e-9)).all() and (want <= most * (1 + 1e-9)).all()
        assert ((most - least) <= (tolerance + 1e-9) * np.bincount(label, minlength=want.shape[1])).all()


def test_no_rows_are_shuffled(spark):
    """Rows only meet the tree: what is exchanged is one row per cell and cluster of a task."""
    x, label = blobs(400)
    rows = frame(spark, x, label)
    tree = clusters.cell_tree(x, 16)
    assert len(clusters._leaf_sums(rows, COLUMNS, ["g"], tree)) <= 16 * 4


def test_kmeans_equals_plain_lloyd(spark):
    x, label = blobs(500, seed=7)
    rows = frame(spark, x, label)
    sample = clusters.hash_sample(rows, COLUMNS)
    assert sorted(map(tuple, sample)) == sorted(map(tuple, x))
    models = clusters.fit_models(rows, COLUMNS, [2, 3], n_init=3, seed=1)
    for k, model in models.items():
        best = np.inf
        for i in range(3):
            centres = clusters.first_centres(sample, k, np.random.default_rng([1, k, i]))
            for _ in range(clusters.ROUNDS):
                own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
                new = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
                moved = ((new - centres) ** 2).sum()
                centres = new
                if moved <= clusters.STILL * sample.var(axis=0).mean():
                    break
            best = min(best, ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum())
        assert model.inertia == pytest.approx(best)
        told = clusters.labelled(rows, COLUMNS, models).toPandas()
        own = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        keyed = dict(zip(map(tuple, x), own))
        assert [keyed[tuple(r)] for r in told[COLUMNS].to_numpy()] == told[f"k{k}"].tolist()


def test_sweep_finds_the_three_blobs(spark):
    x, label = blobs(600, seed=9)
    table, rows = clusters.sweep(frame(spark, x, label), COLUMNS, range(2, 6), n_init=4)
    found = table.orderBy("k").collect()
    assert [r["k"] for r in found] == [2, 3, 4, 5] and [r["k"] for r in found if r["best"]] == [3]
    assert all(a["inertia"] > b["inertia"] for a, b in zip(found, found[1:]))
    assert rows.select("cluster").distinct().count() == 3 and rows.columns == [*COLUMNS, "g", "cluster"]
    quality = clusters.centre_quality(frame(spark, x, label), COLUMNS, range(2, 6), n_init=4).orderBy("k").collect()
    for a, b in zip(found, quality):
        assert a["inertia"] == pytest.approx(b["inertia"]) and a["davies_bouldin"] == pytest.approx(b["davies_bouldin"], rel=0.02)


def test_empty_and_single(spark):
    nothing = frame(spark, np.empty((0, 3)), np.empty(0))
    assert clusters.fit_models(nothing, COLUMNS, [2]) == {} and clusters.quality(nothing, COLUMNS, ["g"]) == {}
    table, rows = clusters.sweep(nothing, COLUMNS, [2])
    assert table.count() == 0 and rows.count() == 0
    one = frame(spark, np.ones((4, 3)), np.zeros(4))
    got = clusters.quality(one, COLUMNS, ["g"])["g"]
    assert (got.silhouette, got.silhouette_sq, got.davies_bouldin) == (0.0, 0.0, 0.0)


def test_equal_rows_are_one_row(spark):
    """Passes read distinct rows: copies change weights only."""
    x, label = blobs(300, seed=5)
    rows = frame(spark, x, label)
    many = rows.union(rows).union(rows)
    held = clusters.weighted(many, COLUMNS, ["g"])
    assert held.count() == 300 and {r[clusters.WEIGHT] for r in held.collect()} == {3}
    one, three = (clusters.fit_models(df, COLUMNS, [3], n_init=2)[3] for df in (rows, many))
    assert np.allclose(one.centres, three.centres) and three.inertia == pytest.approx(3 * one.inertia)


def test_exact_silhouettes_by_tiles(spark, monkeypatch):
    """More distinct rows than cells: without a tolerance all pairs are compared, tile by tile."""
    monkeypatch.setattr(clusters, "CHUNK_ROWS", 100)
    monkeypatch.setattr(clusters, "SAMPLE_ROWS", 50)
    x, label = blobs(700, seed=6, copies=90)
    got = clusters.quality(frame(spark, x, label), COLUMNS, ["g"], leaves=50, tolerance=0.0)["g"]
    want, square = all_pairs(x, label)
    assert got.silhouette == pytest.approx(want, abs=1e-9) and got.error == 0
    assert got.silhouette_sq == pytest.approx(square, abs=1e-9)

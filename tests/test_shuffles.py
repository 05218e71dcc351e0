"""Keyed shuffles: bijections, their distribution, and sums that do not depend on blocks."""

import numpy as np
import pytest

from almanac.operators import shuffles
from almanac.operators import statistics as st


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 23, 500, 1_009])
def test_every_repetition_is_a_bijection(n):
    keys = shuffles.shuffle_keys(np.arange(1, 41), 3)
    there = shuffles.keyed_shuffle(np.arange(n), n, keys)
    assert (np.sort(there, axis=1) == np.arange(n)).all()
    part = shuffles.keyed_shuffle(np.arange(n)[::2], n, keys)  # a formula of the number alone
    assert (part == there[:, ::2]).all()


@pytest.mark.parametrize("n", [12, 30, 400])
def test_images_are_spread_evenly(n):
    reps = 24_000
    there = shuffles.keyed_shuffle(np.arange(n)[:12], n, shuffles.shuffle_keys(np.arange(reps), 1))
    spread = lambda counts: ((counts - reps / len(counts)) ** 2 / (reps / len(counts))).sum() / (len(counts) - 1)
    assert max(spread(np.bincount(there[:, i], minlength=n)) for i in range(12)) < 2.6
    for i, j in ((2, 9), (0, 1), (3, 7)):  # images of two numbers: as even as chance has it
        both = np.bincount(there[:, i] * n + there[:, j], minlength=n * n).reshape(n, n)
        assert not both.diagonal().any() and spread(both[~np.eye(n, dtype=bool)]) < 1.6


@pytest.mark.parametrize("block", [7, 40, 1_000])
def test_sums_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(2)
    n, reps = 90, 33
    c, v = rng.normal(size=(2, n))
    frame = lambda x, name: spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], f"nth long, {name} double")
    got = {r["rep"]: r["s"] for r in shuffles.shuffle_sums(frame(c, "c"), frame(v, "v"), n, reps, 5, block).collect()}
    there = shuffles.keyed_shuffle(np.arange(n), n, shuffles.shuffle_keys(np.arange(1, reps + 1), 5))
    want = (c[None, :] * v[there]).sum(axis=1)
    assert sorted(got) == list(range(1, reps + 1))
    assert [got[r] for r in sorted(got)] == pytest.approx(want)


def test_permutation_moments(spark):
    """Mean and spread over shuffles equal those over all permutations."""
    rng = np.random.default_rng(4)
    n = 60
    values = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))], "id long, x double, y double")
    edges = spark.createDataFrame([(i, (i + d) % n, 0.5) for i in range(n) for d in (1, 3)], "id long, neighbour long, weight double")
    r = st.permutation_test(values, edges, "x", "y", perms=6_000, block=25).first()
    j = st.spatial_lags(values, edges, ["x", "y"]).toPandas().set_index("id").sort_index()
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[i, (i + 3) % n] = 0.5
    c, y = w.T @ j["w_x"].to_numpy(), j["y"].to_numpy()
    sd = np.sqrt(((c - c.mean()) ** 2).sum() * ((y - y.mean()) ** 2).sum() / (n - 1)) / n
    assert r["perm_sd"] == pytest.approx(sd, rel=0.04) and abs(r["perm_mean"]) < 4 * sd / np.sqrt(6_000)

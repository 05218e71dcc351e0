"""k-means for many cluster counts at once, and the quality of clusterings from a tree of cells.

Equal rows are one row with a weight, so passes grow with the number of distinct rows.  All starts of all counts advance
together: a pass over the rows updates every model that still moves, and gives one row per centre.  For silhouettes a tree
cuts the feature space into cells; per cell and cluster three sums are kept (weight, coordinates, squares), from which the
mean distance of any row to the members lies between two exact bounds.  Cells are opened while their bounds may be apart by
more than the tolerance.  Only a tolerance of 0 asks for all pairs of distinct rows: they meet as tiles, each in a group of
its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import materialise

SAMPLE_ROWS = 20_000  # distinct rows, by smallest hash, that place the first centres and the cuts of the tree
LEAVES = 4_096  # cells of the tree
TOLERANCE = 0.01  # a cell is opened if its mean distance is known less exactly than that
BLOCK = 1 << 19  # distances computed at once
CHUNK_ROWS, CHUNKS = 2_048, 32  # rows of a chunk of all pairs while there are few; most chunks
WEIGHT = "_w"  # column: how many rows a distinct row stands for
ROUNDS, STILL = 300, 1e-4  # most passes; a model rests when its centres move by less than this share of the mean variance


@dataclass
class Model:
    """One clustering: its centres, the number of rows and summed squared distance it was last measured with."""

    k: int
    start: int
    centres: np.ndarray
    inertia: float = math.inf


@dataclass(frozen=True)
class Quality:
    """Mean silhouettes (Euclidean with the largest possible error, and squared Euclidean) and Davies-Bouldin index."""

    silhouette: float
    error: float
    silhouette_sq: float
    davies_bouldin: float


def weighted(rows: DataFrame, columns: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """Distinct rows of the columns (and labels) with their number ``_w``, dealt out to all cores; of such a frame itself."""
    if WEIGHT in rows.columns:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return materialise(rows.groupBy(*columns, *labels).agg(F.count("*").alias(WEIGHT)).repartition(cores), "distinct")


def hash_sample(rows: DataFrame, columns: Sequence[str], size: int = SAMPLE_ROWS) -> np.ndarray:
    """Distinct rows of the smallest hashes: a bounded sample that does not depend on partitions."""
    distinct = rows.select(*columns).distinct().withColumn("_h", F.xxhash64(*columns))
    found = distinct.orderBy("_h", *columns).limit(size).drop("_h").toPandas()
    return found.to_numpy(float)


# ---- k-means --------------------------------------------------------------------


def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on the sample: each next centre is drawn by its squared distance to those before."""
    centres = [sample[rng.integers(len(sample))]]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = near.sum()
        at = rng.choice(len(sample), p=near / total) if total > 0 else int(rng.integers(len(sample)))
        centres.append(sample[at])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _assigned(x: np.ndarray, all_centres: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per model the index of the nearest centre (ties to the first) and squared distance; one product for all models."""
    every = np.concatenate(all_centres)
    half = (every**2).sum(axis=1) / 2 - x @ every.T
    at = 0
    for centres in all_centres:
        best = half[:, at : at + len(centres)].argmin(axis=1)
        at += len(centres)
        yield best, ((x - centres[best]) ** 2).sum(axis=1)


def _pass(rows: DataFrame, columns: Sequence[str], models: Sequence[Model]) -> dict[tuple[int, int], tuple[int, float, float, np.ndarray]]:
    """(model, centre) -> rows, summed squared distance, summed distance, summed coordinates; one row per centre is collected."""
    all_centres = [m.centres for m in models]
    names = [f"s{i}" for i in range(len(columns))]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x, w = b[list(columns)].to_numpy(float), b[WEIGHT].to_numpy(float)
            for m, (best, square) in enumerate(_assigned(x, all_centres)):
                share = np.zeros((len(x), len(all_centres[m])))
                share[np.arange(len(x)), best] = w
                parts = share.T @ np.column_stack([np.ones(len(x)), square, np.sqrt(square), x])
                for c in np.unique(best):
                    held[m, int(c)] = held.get((m, int(c)), 0) + parts[c]
        if held:
            yield pd.DataFrame([(m, c, int(v[0]), *v[1:]) for (m, c), v in held.items()], columns=["m", "c", "n", "cost", "spread", *names])

    made = weighted(rows, columns).select(*columns, WEIGHT).mapInPandas(sums, f"m int, c int, n long, cost double, spread double, {', '.join(f'{s} double' for s in names)}")
    total = made.groupBy("m", "c").agg(*[F.sum(v).alias(v) for v in ("n", "cost", "spread", *names)])
    return {(r["m"], r["c"]): (r["n"], r["cost"], r["spread"], np.array([r[s] for s in names])) for r in total.collect()}


def fit_models(
    rows: DataFrame, columns: Sequence[str], ks: Sequence[int], n_init: int = 10, seed: int = 42, rounds: int = ROUNDS
) -> dict[int, Model]:
    """The start of least inertia for every number of clusters (the first of equal ones)."""
    rows = weighted(rows, columns)
    sample = hash_sample(rows, columns)
    if not len(sample):
        return {}
    still = STILL * float(sample.var(axis=0).mean())
    models = [Model(k, i, first_centres(sample, k, np.random.default_rng([seed, k, i]))) for k in ks for i in range(n_init)]
    moving = list(models)
    for _ in range(rounds):
        found = _pass(rows, columns, moving)
        rest = []
        for m, model in enumerate(moving):
            # a centre without rows stays
            new = np.array([found[m, c][3] / found[m, c][0] if (m, c) in found else v for c, v in enumerate(model.centres)])
            moved = float(((new - model.centres) ** 2).sum())
            model.centres = new
            if moved > still:
                rest.append(model)
        moving = rest
        if not moving:
            break
    found = _pass(rows, columns, models)
    for m, model in enumerate(models):
        model.inertia = float(sum(v[1] for (i, _), v in found.items() if i == m))
    return {k: min((m for m in models if m.k == k), key=lambda m: (m.inertia, m.start)) for k in ks}


def nearest_centre(columns: Sequence[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre, as a native expression."""
    square = [sum((F.pow(F.col(c) - float(v), 2) for c, v in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    every = F.array(*square)
    return (F.array_position(every, F.array_min(every)) - 1).cast("int")


# ---- cell tree ------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Inner node i cuts ``axis[i]`` at ``cut[i]``; ``child[i]`` are its two nodes; leaves have axis -1 and their number in ``leaf``."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    leaf: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := self.axis[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            right = x[rows, self.axis[node]] > self.cut[node]
            at[rows] = self.child[node, right.astype(int)]
        return self.leaf[at]


def cell_tree(sample: np.ndarray, leaves: int = LEAVES) -> Tree:
    """Cut the cell of the largest sum of squares again and again, at the middle of its widest side.

    A cell of one distinct row is never cut, so with as many leaves as distinct rows all cells are single rows.
    """
    import heapq

    axis, cut, child = [-1], [0.0], [(0, 0)]
    members: dict[int, np.ndarray] = {0: np.arange(len(sample))}
    spread = lambda rows: float(((sample[rows] - sample[rows].mean(axis=0)) ** 2).sum()) if len(rows) else 0.0
    heap = [(-spread(members[0]), 0)]
    count = 1
    while heap and count < leaves:
        size, node = heapq.heappop(heap)
        rows = members[node]
        low, high = (sample[rows].min(axis=0), sample[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        side = int((high - low).argmax())
        if not high[side] > low[side]:
            continue
        at = low[side] + (high[side] - low[side]) / 2
        at = at if at < high[side] else low[side]
        right = sample[rows, side] > at
        axis[node], cut[node] = side, at
        child[node] = (len(axis), len(axis) + 1)
        for part in (rows[~right], rows[right]):
            members[len(axis)] = part
            heapq.heappush(heap, (-spread(part), len(axis)))
            axis.append(-1)
            cut.append(0.0)
            child.append((0, 0))
        del members[node]
        count += 1
    a = np.array(axis)
    return Tree(a, np.array(cut), np.array(child), np.cumsum(a < 0) - 1)


@dataclass(frozen=True)
class Sums:
    """Per node and cluster of one clustering: weight, mean and mean squared deviation of the members."""

    weight: np.ndarray  # nodes x clusters
    mean: np.ndarray  # nodes x clusters x columns
    variance: np.ndarray  # nodes x clusters; exactly zero if all members are one row


def _leaf_sums(rows: DataFrame, columns: Sequence[str], labels: Sequence[str], tree: Tree) -> pd.DataFrame:
    """One row per clustering, cluster and leaf: bounded by the leaves, whatever the number of rows."""
    d = len(columns)
    names = [f"{kind}{i}" for kind in ("s", "q", "lo", "hi") for i in range(d)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, w = b[list(columns)].to_numpy(float), b[WEIGHT]
            leaf = tree.leaf_of(x)
            for g, label in enumerate(labels):
                by = [leaf, b[label].to_numpy()]
                each, of = pd.DataFrame(x).groupby(by), w.to_numpy()[:, None]
                part = pd.concat([*[pd.DataFrame(v * of).groupby(by).sum() for v in (x, x**2)], each.min(), each.max()], axis=1)
                part.columns = names
                part.insert(0, "w", w.groupby(by).sum())
                part.index.names = ["leaf", "c"]
                part = part.reset_index()
                part.insert(0, "g", g)
                yield part

    made = weighted(rows, columns, labels).select(*columns, *labels, WEIGHT).mapInPandas(sums, f"g int, leaf int, c int, w long, {', '.join(f'{n} double' for n in names)}")
    combine = {"s": F.sum, "q": F.sum, "lo": F.min, "hi": F.max}
    return made.groupBy("g", "leaf", "c").agg(
        F.sum("w").alias("w"), *[combine[n.rstrip("0123456789")](n).alias(n) for n in names]
    ).toPandas()


def _node_sums(found: pd.DataFrame, d: int, tree: Tree) -> Sums:
    """Sums of the leaves carried up to all nodes."""
    nodes, clusters = len(tree.axis), int(found["c"].max()) + 1
    weight = np.zeros((nodes, clusters))
    total, square = np.zeros((2, nodes, clusters, d))
    low, high = np.full((nodes, clusters, d), np.inf), np.full((nodes, clusters, d), -np.inf)
    node_of = np.flatnonzero(tree.axis < 0)[found["leaf"].to_numpy()]
    c = found["c"].to_numpy()
    block = lambda kind: found[[f"{kind}{i}" for i in range(d)]].to_numpy(float)
    weight[node_of, c] = found["w"]
    total[node_of, c], square[node_of, c], low[node_of, c], high[node_of, c] = (block(k) for k in ("s", "q", "lo", "hi"))
    for node in range(nodes - 1, -1, -1):  # children come after their parent
        if tree.axis[node] >= 0:
            a, b = tree.child[node]
            weight[node], total[node], square[node] = weight[a] + weight[b], total[a] + total[b], square[a] + square[b]
            low[node], high[node] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
    divisor = np.maximum(weight, 1)[:, :, None]
    one = (low == high).all(axis=2)
    mean = np.where(one[:, :, None], np.where(np.isfinite(low), low, 0.0), total / divisor)
    variance = np.where(one, 0.0, np.maximum((square / divisor - mean**2).sum(axis=2), 0.0))
    # rounding of the squares must not make a bound too narrow
    variance += np.where(one, 0.0, 1e-12 * (square / divisor).sum(axis=2))
    return Sums(weight, mean, variance)


def mean_distances(x: np.ndarray, tree: Tree, sums: Sums, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible summed distance of every row to the members of every cluster.

    Distance is convex, so the members' mean distance is at least that to their mean; its square is at most the mean
    square, so it is at most the root of squared distance plus variance.  These bounds are apart by the root of the variance
    at most, so the nodes to open are the same for all rows.
    """
    node, cluster = _cells(tree, sums, tolerance)
    mean, variance, weight = sums.mean[node, cluster], sums.variance[node, cluster], sums.weight[node, cluster]
    into = np.zeros((len(node), sums.weight.shape[1]))
    into[np.arange(len(node)), cluster] = weight
    least, most = np.zeros((2, len(x), sums.weight.shape[1]))
    step = max(1, BLOCK // max(1, len(node)))
    for i in range(0, len(x), step):
        square = _squares(x[i : i + step], mean)
        least[i : i + step] = np.sqrt(square) @ into
        most[i : i + step] = np.sqrt(square + variance) @ into
    return least, most


def _cells(tree: Tree, sums: Sums, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Node and cluster of the highest cells whose bounds are apart by no more than the tolerance, else of leaves."""
    out, open_ = [], [0]
    while open_:
        node = open_.pop()
        inside = np.flatnonzero(sums.weight[node] > 0)
        if tree.axis[node] < 0 or (np.sqrt(sums.variance[node, inside]) <= tolerance).all():
            out += [(node, c) for c in inside]
        else:
            open_ += [int(below) for below in tree.child[node]]
    return tuple(np.array(out, int).reshape(-1, 2).T)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances as one product; those near zero, where it would cancel, by differences."""
    xx, yy = (x**2).sum(axis=1), (y**2).sum(axis=1)
    out = np.column_stack([x, xx, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), yy]).T
    a, b = np.nonzero(out < 1e-6 * (xx.max(initial=0.0) + yy.max(initial=0.0)))
    out[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
    return out


def _pair_sums(rows: DataFrame, columns: Sequence[str], labels: Sequence[str], counts: dict[str, int]) -> DataFrame:
    """``rows`` (weighted, distinct) with ``_s_<label>``: summed distances to the members of every cluster, by all pairs.

    The rows are dealt out to at most ``CHUNKS`` chunks; chunk meets chunk in a tile, a group of its own, so no task holds more than two.
    """
    n = rows.count()
    chunks = max(1, min(CHUNKS, -(-n // CHUNK_ROWS)))
    key = [*columns, *labels]
    cut = rows.select(*key, WEIGHT, F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int").alias("_i"))
    each = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_j")
    tiles = min(chunks * chunks, 8 * rows.sparkSession.sparkContext.defaultParallelism)
    mine = cut.select(*key, "_i", each).repartition(tiles, "_i", "_j")
    other = cut.select(*key, WEIGHT, F.col("_i").alias("_k"), each).select(*key, WEIGHT, F.col("_j").alias("_i"), F.col("_k").alias("_j"))
    other = other.repartition(tiles, "_i", "_j")
    wide = [f"_s{g}_{c}" for g, label in enumerate(labels) for c in range(counts[label])]

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = a[list(columns)].to_numpy(float), b[list(columns)].to_numpy(float)
        into, at = np.zeros((len(y), len(wide))), 0
        for label in labels:
            into[np.arange(len(y)), at + b[label].to_numpy(int)] = b[WEIGHT]
            at += counts[label]
        out, step = np.zeros((len(x), len(wide))), max(1, BLOCK // max(1, len(y)))
        for i in range(0, len(x), step):
            out[i : i + step] = np.sqrt(_squares(x[i : i + step], y)) @ into
        return pd.concat([a[key].reset_index(drop=True), pd.DataFrame(out, columns=wide)], axis=1)

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    schema = f"{types}, {', '.join(f'{c} double' for c in wide)}"
    made = mine.groupBy("_i", "_j").cogroup(other.groupBy("_i", "_j")).applyInPandas(sums, schema)
    total = made.groupBy(*key).agg(*[F.sum(c).alias(c) for c in wide])
    told = [F.array(*[F.col(f"_s{g}_{c}") for c in range(counts[label])]).alias(f"_s_{label}") for g, label in enumerate(labels)]
    found = materialise(total.select(*key, *told), "pairs")
    return materialise(rows.join(found, key).repartition(rows.sparkSession.sparkContext.defaultParallelism), "distinct")


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return np.divide(b - a, top, out=np.zeros_like(a), where=top > 0)


def quality(
    rows: DataFrame, columns: Sequence[str], labels: Sequence[str], leaves: int = LEAVES, tolerance: float = TOLERANCE
) -> dict[str, Quality]:
    """Quality of each clustering (a column of cluster numbers from 0, without nulls) over all rows.

    Equal rows are counted once and weighted.  Two passes over the distinct ones, no shuffle: the true mean silhouette lies
    within ``error`` of the one given.  A tolerance of 0 is exact to rounding: all pairs of distinct rows are compared in tiles.
    """
    d = len(columns)
    rows = weighted(rows, columns, labels)
    exact = tolerance == 0
    tree = cell_tree(hash_sample(rows, columns), 1 if exact else leaves)
    found = _leaf_sums(rows, columns, labels, tree)
    every = {label: _node_sums(found[found["g"] == g], d, tree) for g, label in enumerate(labels) if (found["g"] == g).any()}
    moments = {}
    for g, label in enumerate(every):
        mine = found[found["g"] == g].groupby("c")
        n = mine["w"].sum().to_numpy(float)
        moments[label] = (n, mine[[f"s{i}" for i in range(d)]].sum().to_numpy(), mine[[f"q{i}" for i in range(d)]].sum().to_numpy().sum(axis=1), list(mine.groups))

    sums: list[str] = []
    if exact:
        rows = _pair_sums(rows, columns, list(every), {label: int(max(moments[label][3])) + 1 for label in every})
        sums = [f"_s_{label}" for label in every]

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, w = b[list(columns)].to_numpy(float), b[WEIGHT].to_numpy(float)
            out = []
            for g, label in enumerate(every):
                n, total, square, present = moments[label]
                own = np.searchsorted(present, b[label].to_numpy())
                at, each = np.arange(len(x)), np.arange(len(present))[None, :]
                both = (np.stack(b[f"_s_{label}"].to_numpy()),) * 2 if exact else mean_distances(x, tree, every[label], tolerance)
                least, most = (v[:, present] for v in both)
                other = np.where(each != own[:, None], n[None, :], np.inf)
                single = (n[own] <= 1) | (len(present) < 2)
                mine = np.maximum(n[own] - 1, 1)
                b_least, b_most = np.where(each != own[:, None], least / other, np.inf).min(axis=1), np.where(each != own[:, None], most / other, np.inf).min(axis=1)
                low = np.where(single, 0.0, _score(most[at, own] / mine, np.where(single, 0.0, b_least)))
                high = np.where(single, 0.0, _score(least[at, own] / mine, np.where(single, 0.0, b_most)))
                sq = np.maximum(((x**2).sum(axis=1)[:, None] * n - 2 * x @ total.T + square), 0.0)  # to all members of a cluster
                b_sq = np.where(each != own[:, None], sq / n, np.inf).min(axis=1)
                flat = np.where(single, 0.0, _score(sq[at, own] / mine, np.where(single, 0.0, b_sq)))
                centre = total / n[:, None]
                for c in np.unique(own):
                    rows_of = own == c
                    times = w[rows_of]
                    spread = np.sqrt(((x[rows_of] - centre[c]) ** 2).sum(axis=1))
                    out.append((g, int(c), int(times.sum()), *[float(times @ v) for v in (low[rows_of], high[rows_of], flat[rows_of], spread)]))
            yield pd.DataFrame(out, columns=["g", "c", "n", "low", "high", "flat", "spread"])

    made = rows.select(*columns, *labels, WEIGHT, *sums).mapInPandas(scores, "g int, c int, n long, low double, high double, flat double, spread double")
    names = ["n", "low", "high", "flat", "spread"]
    summed = made.groupBy("g", "c").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # one row per cluster
    out = {}
    for g, label in enumerate(every):
        mine = summed[summed["g"] == g].sort_values("c")
        n, total, _, _ = moments[label]
        low, high, flat = (mine[c].sum() / mine["n"].sum() for c in ("low", "high", "flat"))
        index = davies_bouldin(total / n[:, None], (mine["spread"] / mine["n"]).to_numpy())
        out[label] = Quality(float(low + high) / 2, float(high - low) / 2, float(flat), index)
    return out


def davies_bouldin(centres: np.ndarray, spread: np.ndarray) -> float:
    """Mean over clusters of the worst (spread + spread) / centre distance; only centres are compared.  One cluster: 0."""
    apart = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    worst = [
        max((spread[i] + spread[j]) / apart[i, j] if apart[i, j] > 0 else math.inf for j in range(len(centres)) if j != i)
        for i in range(len(centres))
        if len(centres) > 1
    ]
    return float(np.mean(worst)) if worst else 0.0


# ---- sweeps ---------------------------------------------------------------------


def labelled(rows: DataFrame, columns: Sequence[str], models: dict[int, Model]) -> DataFrame:
    """The rows with their cluster in every clustering, as columns ``k<count>``."""
    return rows.withColumns({f"k{k}": nearest_centre(columns, m.centres) for k, m in models.items()})


def sweep(
    df: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int] = range(2, 9),
    n_init: int = 10,
    seed: int = 42,
    enough: float = 0.25,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """Sweep table over the cluster counts, and the rows with the clustering of the largest silhouette as ``cluster``.

    ``structure`` says whether the best silhouette reaches ``enough``.
    """
    ready = materialise(df, "kmeans")
    distinct = weighted(ready, columns)
    models = fit_models(distinct, columns, ks, n_init, seed)
    rows = labelled(ready, columns, models)
    told = quality(labelled(distinct, columns, models), columns, [f"k{k}" for k in models], tolerance=tolerance)
    best = max(models, key=lambda k: (told[f"k{k}"].silhouette, -k), default=None)
    structure = "meaningful" if best is not None and told[f"k{best}"].silhouette >= enough else "weak/none"
    table = [
        (k, q.silhouette, q.error, q.silhouette_sq, q.davies_bouldin, m.inertia, k == best, structure)
        for k, m in models.items()
        if (q := told[f"k{k}"])
    ]
    schema = (
        "k int, silhouette double, silhouette_error double, silhouette_sq double, davies_bouldin double, inertia double, "
        "best boolean, structure string"
    )
    chosen = F.lit(None).cast("int") if best is None else F.col(f"k{best}")
    return df.sparkSession.createDataFrame(table, schema), rows.withColumn("cluster", chosen).drop(*[f"k{k}" for k in models])


def centre_quality(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 9), n_init: int = 10, seed: int = 42) -> DataFrame:
    """(k, davies_bouldin, inertia): from the centres and one pass, without silhouettes."""
    ready = weighted(df, columns)
    models = fit_models(ready, columns, ks, n_init, seed)
    found = _pass(ready, columns, list(models.values()))
    out = []
    for m, (k, model) in enumerate(models.items()):
        mine = [found[m, c] for c in range(k) if (m, c) in found]
        centres = np.array([v[3] / v[0] for v in mine])
        # spread is measured to the centres the pass used, which the means of a resting model equal
        out.append((k, davies_bouldin(centres, np.array([v[2] / v[0] for v in mine])), model.inertia))
    return df.sparkSession.createDataFrame(out, "k int, davies_bouldin double, inertia double")

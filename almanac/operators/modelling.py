"""Clustering, projection and classification on entity tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.logistic import out_of_fold
from almanac.operators.nearest import nearest
from almanac.operators.sampling import stratified_split
from almanac.operators.statistics import group_histogram, ranked_groups, standardise
from almanac.session import materialise


def feature_table(matrix: DataFrame, categories: Sequence[str], group: str, order: Sequence[str], lean: str) -> DataFrame:
    """Counts, total, ordinal group rank (unknown groups last) and lean as 1, -1 or 0, all z-scored."""
    total = F.lit(0)
    for c in categories:
        total = total + F.col(c)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(group)) - 1, F.lit(-1))
    out = matrix.withColumn("total", total).withColumn("group_rank", F.when(rank < 0, len(order)).otherwise(rank).cast("double"))
    out = out.withColumn("lean_score", F.when(F.col(lean) == "Dem", 1.0).when(F.col(lean) == "Rep", -1.0).otherwise(0.0))
    return standardise(out, [*categories, "total", "group_rank", "lean_score"])


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def cluster_profiles(clustered: DataFrame, columns: Sequence[str], group: str, lean: str) -> DataFrame:
    """Size, means, most common group and lean shares per cluster."""
    share = lambda side: (F.count_if(F.col(lean) == side) * 100.0 / F.count("*"))
    return clustered.groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns], F.mode(group, True).alias("dominant_group"),
        share("Dem").alias("pct_dem"), share("Rep").alias("pct_rep"),
    )


# ---- projection -----------------------------------------------------------------


def pca_project(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """First ``k`` principal components of centred columns as ``pc1..``; the largest loading of each is positive."""
    vectors = assemble(df, columns)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    out = model.transform(vectors).withColumn("_a", vector_to_array("_pc"))
    return out.select(*df.columns, *[(F.col("_a")[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(k)])


def pca_by_variance(train: DataFrame, other: DataFrame, vector: str, share: float = 0.95) -> tuple[DataFrame, DataFrame, int]:
    """Both frames with ``vector`` projected on as many components, fitted on ``train`` only, as reach the variance share.

    The projection is centred on the training mean, so its columns have mean zero over the training rows.
    """
    as_vec = lambda d: d.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    width = len(train.select(vector).first()[0])
    model = PCA(k=width, inputCol="_v", outputCol="_pc").fit(as_vec(train))
    keep = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share)) + 1
    keep = min(keep, width)
    means = train.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()  # a row per column
    middle = np.array([r["m"] for r in sorted(means, key=lambda r: r["i"])]) @ model.pc.toArray()[:, :keep]
    shift = F.array(*[F.lit(float(v)) for v in middle])
    centred = F.zip_with(F.slice(vector_to_array("_pc"), 1, keep), shift, lambda a, b: a - b)
    cut = lambda d: model.transform(as_vec(d)).withColumn(vector, centred).drop("_v", "_pc")
    return cut(train), cut(other), keep


# ---- classifiers ----------------------------------------------------------------


def cross_validate(df: DataFrame, y: str, columns: Sequence[str], key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Accuracy, AUC and majority baseline of out-of-fold logistic predictions."""
    scored = materialise(out_of_fold(df, y, columns, key, folds, seed), "scored")
    right = F.count_if((F.col("prediction") >= 0.5) == (F.col(y) == 1))
    base = F.greatest(F.avg(F.col(y).cast("double")), 1 - F.avg(F.col(y).cast("double")))
    out = scored.agg(F.count("*").alias("n"), (right / F.count("*")).alias("accuracy"), base.alias("baseline"))
    return out.withColumn("auc", roc_auc(scored, y, "prediction").scalar())


def boosted_trees(
    train: DataFrame,
    test: DataFrame,
    vector: str,
    y: str,
    key: str,
    rounds: int = 500,
    depth: int = 6,
    step: float = 0.05,
    row_share: float = 0.8,
    column_share: float = 0.8,
    validation: float = 0.15,
    patience: int = 30,
    seed: int = 42,
) -> tuple[DataFrame, int]:
    """Scores of ``test`` by boosted trees on a vector column, and the number of trees that were kept.

    The rare class is weighted up to balance.  Each tree sees a share of the rows, each node a share of the columns.  A
    stratified share of the training rows is held back, and the trees up to the smallest loss on it are kept: rounds are
    doubled, up to ``rounds``, until that loss has not fallen for ``patience`` of them.  The seed fixes the trees, so more
    rounds only add to them.
    """
    counts = {r[0]: r[1] for r in train.groupBy(y).count().collect()}  # two classes
    weight = F.when(F.col(y) == 1, counts.get(0, 1) / max(1, counts.get(1, 1))).otherwise(1.0)
    as_vec = lambda d: d.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    dealt = stratified_split(train.drop("split"), y, key, [("fit", 1 - validation), ("held", validation)], seed)
    rows = materialise(dealt.select(vector, y, weight.alias("_w"), (F.col("split") == "held").alias("_held")), "boosting")
    fitted, held = as_vec(rows.where("NOT _held")), as_vec(rows.where("_held"))

    def grow(trees: int) -> GBTClassificationModel:
        return GBTClassifier(
            featuresCol="features", labelCol=y, weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=row_share,
            featureSubsetStrategy=str(column_share), seed=seed,
        ).fit(fitted)

    trees = min(rounds, 2 * patience)
    while True:
        model = grow(trees)
        loss = model.evaluateEachIteration(held)
        best = int(np.argmin(loss)) + 1
        if best + patience <= trees or trees == rounds:
            break
        trees = min(rounds, 2 * trees)
    model = model if best == trees else grow(best)
    out = model.transform(as_vec(test))
    return out.select(key, y, vector_to_array("probability")[1].alias("score")), best


# ---- thresholds and ROC ----------------------------------------------------------


def threshold_sweep(df: DataFrame, y: str, score: str, steps: int = 200, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Precision, recall and F1 at each threshold.

    Each score falls into one step; counts per step are then summed from the top, so
    rows are never paired with thresholds.
    """
    grid = np.linspace(lo, hi, steps)
    cuts = F.array(*[F.lit(float(t)) for t in grid])
    step = F.size(F.filter(cuts, lambda t: t <= F.col(score)))
    pos = F.col(y) == 1
    hist = df.groupBy(step.alias("step")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"))
    rows = {r["step"]: (r["p"], r["q"]) for r in hist.collect()}  # at most steps + 1 rows
    total = sum(p for p, _ in rows.values())
    out, tp, fp = [], 0, 0
    for s in range(steps, 0, -1):
        p, q = rows.get(s, (0, 0))
        tp, fp = tp + p, fp + q
        prec, rec = tp / (tp + fp) if tp + fp else 0.0, tp / total if total else 0.0
        out.append((s - 1, float(grid[s - 1]), tp, fp, total - tp, prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0.0))
    return df.sparkSession.createDataFrame(
        out, "step int, threshold double, tp long, fp long, fn long, precision double, recall double, f1 double"
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold with the largest F1."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve with equal scores taken together, by way of rank sums; 0 when a class is missing."""
    sums, _ = ranked_groups(group_histogram(df.withColumn("_y", F.col(y).cast("int")), "_y", score), ())
    n1 = F.sum(F.when(F.col("grp") == 1, F.col("n"))).cast("double")
    n0 = F.sum(F.when(F.col("grp") == 0, F.col("n"))).cast("double")
    r1 = F.sum(F.when(F.col("grp") == 1, F.col("rank_sum")))
    return sums.agg(F.coalesce((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), F.lit(0.0)).alias("auc"))


# ---- density clusters -------------------------------------------------------------


CELL_PARTS = 8  # parts of a cell along each axis


def _merged(core: DataFrame, near: Callable[..., DataFrame]) -> DataFrame:
    """Core spots (id, x, y, attr) after clusters that see each other have taken the smallest label, until none do.

    The largest cluster need not look: whoever is in its reach sees it.
    """
    while True:
        largest = core.groupBy("attr").count().orderBy(F.desc("count"), "attr").select("attr").first()
        if largest is None:
            return core
        seen = near(core.where(F.col("attr") != largest["attr"]), core, 1, "other").select("id", "other")
        label = core.select("id", "attr")
        links = seen.join(label, "id").join(label.select(F.col("id").alias("other"), F.col("attr").alias("b")), "other")
        links = links.select(F.col("attr").alias("a"), "b").distinct()
        links = materialise(links.union(links.select("b", "a")).distinct(), "links")
        if links.isEmpty():
            return core
        parent = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        parent = materialise(parent, "parents")
        while True:  # follow parents to their root
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            moved = parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), (F.col("pp") < F.col("p")).alias("m"))
            moved = materialise(moved, "parents")
            parent = moved.drop("m")
            if moved.where("m").isEmpty():
                break
        core = core.join(parent.withColumnRenamed("a", "attr"), "attr", "left").select("id", "x", "y", F.coalesce("p", "attr").alias("attr"))
        core = materialise(core, "cores")


def density_clusters(points: DataFrame, key: str, x: str, y: str, eps: float, min_points: int, extent: float) -> DataFrame:
    """DBSCAN labels (key, cluster): the smallest core key of the cluster, -1 for noise.

    Points on one spot are one weighted spot.  Core spots of one small cell belong
    together from the start; then spots look for the nearest core spot of another
    cluster within reach, and clusters that see each other merge, until none do: first
    with one spot of each part of a cell, which leaves little, then with all.
    """
    spots = points.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.min(key).alias("id"), F.count("*").alias("size")
    )
    spots = materialise(spots, "spots")
    near = lambda q, t, k, rule=None: nearest(q, t, ["x", "y"], k, 0.0, extent, eps, rule)
    weight = near(spots, spots, min_points).join(spots.select(F.col("id").alias("other"), "size"), "other")
    cores = weight.groupBy("id").agg(F.sum("size").alias("w")).where(F.col("w") >= min_points).select("id")
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    core = spots.join(cores, "id").withColumn("ci", F.floor(F.col("x") / side)).withColumn("cj", F.floor(F.col("y") / side))
    first = core.groupBy("ci", "cj").agg(F.min("id").alias("attr"))
    core = materialise(core.join(first, ["ci", "cj"]).select("id", "x", "y", "attr"), "cores")
    # One core spot of each small part of a cell stands for it: as many as the area holds, however crowded it is.
    part = side / CELL_PARTS
    one = core.groupBy("attr", F.floor(F.col("x") / part), F.floor(F.col("y") / part)).agg(F.min_by(F.struct("id", "x", "y"), "id").alias("s"))
    one = materialise(one.select("s.*", "attr"), "parts")
    names = _merged(one, near).select("id", F.col("attr").alias("p")).join(one.select("id", "attr"), "id").groupBy("attr").agg(F.min("p").alias("p"))
    core = core.join(names, "attr").select("id", "x", "y", F.col("p").alias("attr"))
    core = _merged(materialise(core, "cores"), near)
    # A border spot takes the smallest label in reach: look for ever smaller ones.
    low = core.withColumn("attr", -F.col("attr"))
    rest = spots.join(core, "id", "left_anti").select("id", "x", "y").withColumn("attr", F.lit(-(2**62)).cast("bigint"))
    border = materialise(rest.where("false"), "border")
    while True:
        better = near(rest, low, 1, "above").select("id", "other")
        better = better.join(low.select(F.col("id").alias("other"), "attr"), "other").select("id", "attr")
        better = materialise(better.join(rest.select("id", "x", "y"), "id"), "border")
        if better.isEmpty():
            break
        border = materialise(border.join(better, "id", "left_anti").select("id", "x", "y", "attr").unionByName(better), "border")
        rest = better
    labels = core.select("id", F.col("attr").alias("cluster")).unionByName(border.select("id", (-F.col("attr")).alias("cluster")))
    placed = spots.join(labels, "id", "left").select("x", "y", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"))
    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.join(placed, ["x", "y"]).select(key, "cluster")


def bubble_table(members: DataFrame, cluster: str, lat: str, lon: str, n: str) -> DataFrame:
    """Size, share with any action, mean count and centre per cluster; noise is the -1 row."""
    acted = F.count_if(F.col(n) > 0)
    return members.groupBy(cluster).agg(
        F.count("*").alias("n"), acted.alias("n_with_action"), F.round(acted * 100.0 / F.count("*"), 1).alias("pct_with_action"),
        F.round(F.avg(n), 2).alias("mean_actions"), F.round(F.avg(lat), 4).alias("centroid_lat"), F.round(F.avg(lon), 4).alias("centroid_lon"),
    )


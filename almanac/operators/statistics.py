"""Rank tests, corrections, correlation and tables, computed from distributed counts.

Every test reduces its data to a histogram of distinct values per group first; only
result tables (a row per group or per pair of groups) are finished row by row.
Asymptotic forms with tie correction are used; exact small-sample tables are not built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.dist import chi2_p, normal_p, t_p
from almanac.operators.ranks import average_ranks, later_minimum, order_bounds, row_number_within, running_total, slice_of
from almanac.operators.shuffles import SHUFFLE_BLOCK, shuffle_sums
from almanac.session import materialise


def _cube(n: Column) -> Column:
    n = n.cast("double")
    return n * n * n - n


def group_histogram(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(group).alias("grp"), F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    return materialise(hist, "histogram")  # read several times below; the data behind it only once


def ranked_groups(hist: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rank sums per (by, grp), and pooled size and tie term per by, from group histograms."""
    keyed = hist if by else hist.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    pooled = keyed.groupBy(*keys, "v").agg(F.sum("n").alias("t"))
    ranked = running_total(pooled, keys, "v", F.col("t"), "_before", order_bounds(pooled, "v"))
    ranked = ranked.withColumn("rank", F.col("_before") + (F.col("t") + 1) / 2)
    sums = (
        keyed.join(ranked.select(*keys, "v", "rank"), [*keys, "v"])
        .groupBy(*keys, "grp")
        .agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n")).alias("rank_sum"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    )
    totals = pooled.groupBy(*keys).agg(F.sum("t").alias("n_total"), F.sum(_cube(F.col("t"))).alias("ties"))
    return sums, totals


def friedman(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repeated measures over the columns; ranks are taken inside each row, so one aggregate does it."""
    k = len(columns)
    vals = F.array(*[F.col(c).cast("double") for c in columns])

    def rank(c: str) -> Column:
        x = F.col(c).cast("double")
        less, same = F.size(F.filter("_v", lambda o: o < x)), F.size(F.filter("_v", lambda o: o == x))
        return less + (same + 1) / 2

    def same_square(c: str) -> Column:
        same = F.size(F.filter("_v", lambda o: o == F.col(c).cast("double")))
        return same * same - 1

    ties = F.lit(0)
    for c in columns:
        ties = ties + same_square(c)
    sums = matrix.withColumn("_v", vals).agg(
        F.count("*").alias("n_subjects"),
        F.sum(ties).cast("double").alias("_ties"),
        *[F.sum(rank(c)).alias(f"_r{i}") for i, c in enumerate(columns)],
    )
    n = F.col("n_subjects")
    squares = F.lit(0.0)
    for i in range(k):
        squares = squares + F.col(f"_r{i}") * F.col(f"_r{i}")
    raw = squares * 12.0 / (n * k * (k + 1)) - n * 3 * (k + 1)
    chi2 = raw / (1 - F.col("_ties") / (n * k * (k * k - 1)))
    out = sums.select("n_subjects", F.lit(k - 1).alias("df"), chi2.alias("chi2"))
    return out.withColumn("p", chi2_p("chi2", "df"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H test across groups with more than one member."""
    hist = group_histogram(df, group, value)
    large = hist.groupBy("grp").agg(F.sum("n").alias("s")).where("s > 1").select("grp")
    sums, totals = ranked_groups(hist.join(large, "grp"), ())
    n, t = F.col("n_total"), F.col("ties")
    per = sums.groupBy("_all").agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.count("*").alias("n_groups")
    )
    h = (F.col("s") * 12.0 / (n * (n + 1)) - 3 * (n + 1)) / (1 - t / _cube(n))
    out = per.join(totals, "_all").select(
        h.alias("H"), (F.col("n_groups") - 1).cast("int").alias("df"), "n_groups", F.col("n_total")
    )
    return out.withColumn("p", chi2_p("H", "df"))


def _u_test(first: DataFrame, second: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U statistics from rank sums of two groups per key."""
    a = first.select(*keys, F.col("grp").alias("group1"), F.col("n").alias("n1"), F.col("rank_sum").alias("_r1"), F.col("mean").alias("mean1"))
    b = second.select(*keys, F.col("grp").alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("mean2"))
    j = a.join(b, list(keys)).join(totals, list(keys))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("n_total").cast("double")
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
    out = j.withColumn("U", u).withColumn("z", z).withColumn("rank_biserial", 1 - 2 * F.col("U") / (n1 * n2))
    return out.withColumn("p", F.when(F.col("z") <= 0, 1.0).otherwise(normal_p("z"))).drop("_r1", "ties", "n_total")


def mann_whitney(df: DataFrame, group: str, value: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided U test of two groups with continuity and tie correction, per ``by`` key."""
    hist = group_histogram(df.where(F.col(group).isin(first, second)), group, value, by)
    sums, totals = ranked_groups(hist, by)
    keys = list(by) or ["_all"]
    return _u_test(sums.where(F.col("grp") == first), sums.where(F.col("grp") == second), totals, keys).drop("_all")


def wilcoxon(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank test of paired columns; zero differences drop out, all-zero gives p = 1."""
    keyed = df if by else df.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    d = F.col(x) - F.col(y)
    diffs = keyed.select(*keys, F.abs(d).cast("double").alias("v"), F.signum(d).alias("s"))
    hist = diffs.where("v > 0").groupBy(*keys, "v").agg(
        F.count("*").alias("t"), F.count_if(F.col("s") > 0).alias("up"), F.count_if(F.col("s") < 0).alias("down")
    )
    ranked = running_total(hist, keys, "v", F.col("t"), "_before", order_bounds(hist, "v"))
    rank = F.col("_before") + (F.col("t") + 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum("t").cast("double").alias("n"), F.sum(_cube(F.col("t"))).alias("ties"),
        F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * F.col("down")).alias("w_minus"),
    )
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    stat = F.least("w_plus", "w_minus")
    tested = sums.select(*keys, stat.alias("stat"), ((stat - n * (n + 1) / 4) / spread).alias("z"), n.cast("bigint").alias("n"))
    everyone = keyed.select(*keys).distinct().join(tested, keys, "left").na.fill({"stat": 0.0, "n": 0})
    return everyone.withColumn("p", F.coalesce(normal_p("z"), F.lit(1.0))).drop("_all")


def bonferroni(p: Column, m: Column) -> Column:
    return F.least(p * m, F.lit(1.0))


def pairwise(df: DataFrame, group: str, value: str, only_significant: bool = False) -> DataFrame:
    """U test for each pair of groups with Bonferroni correction.

    Each pair ranks its own two groups; what is copied per pair is the histogram, not the rows.
    """
    hist = group_histogram(df, group, value)
    groups = hist.select("grp").distinct()
    pairs = groups.select(F.col("grp").alias("a")).join(groups.select(F.col("grp").alias("b")), F.col("a") < F.col("b"))
    sided = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("grp"))
    sums, totals = ranked_groups(hist.join(sided, "grp"), ["a", "b"])
    tested = _u_test(sums.where("grp = a"), sums.where("grp = b"), totals, ["a", "b"]).drop("a", "b")
    return _corrected(tested, pairs.select(F.count("*")).scalar(), only_significant)


def pairwise_paired(matrix: DataFrame, columns: Sequence[str], only_significant: bool = False) -> DataFrame:
    """Signed-rank test for each pair of matrix columns with Bonferroni correction."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("group1"), F.lit(b).alias("group2"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    long = matrix.select(F.explode(cells).alias("c")).select("c.*")
    return _corrected(wilcoxon(long, "x", "y", ["group1", "group2"]), F.lit(len(pairs)), only_significant)


def _corrected(tested: DataFrame, m: Column, only_significant: bool) -> DataFrame:
    out = tested.withColumn("p_bonf", bonferroni(F.col("p"), m)).withColumn("sig", F.col("p_bonf") < 0.05)
    return out.where("sig") if only_significant else out


def dunn(df: DataFrame, group: str, value: str, method: str = "fdr_bh") -> DataFrame:
    """Post-hoc z per pair of groups on one pooled ranking with a shared tie term."""
    sums, totals = ranked_groups(group_histogram(df, group, value), ())
    n = F.col("n_total").cast("double")
    sigma = totals.withColumn("_s", n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))).select("_all", "_s")
    side = lambda i: sums.select(
        "_all", F.col("grp").alias(f"group{i}"), F.col("n").alias(f"n{i}"), (F.col("rank_sum") / F.col("n")).alias(f"_m{i}"), F.col("mean").alias(f"mean{i}")
    )
    pairs = side(1).join(side(2), "_all").where("group1 < group2").join(sigma, "_all")
    se = F.sqrt(F.col("_s") * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    z = F.when(se > 0, (F.col("_m1") - F.col("_m2")) / se).otherwise(0.0)
    out = pairs.withColumn("z", z).withColumn("p", normal_p("z")).drop("_all", "_m1", "_m2", "_s")
    return adjust(out, "p", method).withColumn("sig", F.col("p_adj") < 0.05)


def adjust(table: DataFrame, p: str, method: str = "fdr_bh") -> DataFrame:
    """Adds ``p_adj``: Bonferroni, or Benjamini-Hochberg by a reverse running minimum."""
    table = materialise(table, "p-values")  # read for the size, the bounds, the ranks and the result
    m = table.select(F.count(p)).scalar()
    if method == "bonferroni":
        return table.withColumn("p_adj", bonferroni(F.col(p), m))
    hist = table.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    bounds = order_bounds(hist, p)
    counted = running_total(hist.withColumn("_all", F.lit(0)), ["_all"], p, F.col("_n"), "_before", bounds)
    scaled = counted.withColumn("_s", F.col(p) * m / (F.col("_before") + F.col("_n")))
    lowest = later_minimum(scaled, p, "_s", "_adj", bounds).select(p, F.least("_adj", F.lit(1.0)).alias("p_adj"))
    return table.join(lowest, p, "left")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r with its p-value and the least-squares line of y on x."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.agg(
        F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return out.withColumn("p", t_p(t, (n - 2).cast("double")))


def spearman(df: DataFrame, x: str, y: str, tests: int = 1) -> DataFrame:
    """Correlation of average ranks, with Bonferroni over ``tests``.

    Ranks are joined at the level of distinct (x, y) pairs, not rows.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    rx = average_ranks(both.select(F.col(x).alias("_x")), "_x").select("_x", F.col("rank").alias("_rx"))
    ry = average_ranks(both.select(F.col(y).alias("_y")), "_y").select("_y", F.col("rank").alias("_ry"))
    w, a, b = F.col("_n").cast("double"), F.col("_rx"), F.col("_ry")
    ranked = pairs.join(rx, "_x").join(ry, "_y")
    middle = (ranked.select(F.sum("_n")).scalar() + 1) / 2  # both rank columns average (n + 1) / 2
    a, b = a - middle, b - middle
    out = ranked.agg(F.sum("_n").alias("n"), (F.sum(w * a * b) / F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))).alias("rho"))
    r, n = F.col("rho"), F.col("n")
    out = out.withColumn("p", t_p(r * F.sqrt((n - 2) / (1 - r * r)), (n - 2).cast("double")))
    return out.withColumn("p_bonf", bonferroni(F.col("p"), F.lit(tests)))


def two_by_two(df: DataFrame, group: Column, outcome: Column) -> DataFrame:
    """Counts, chi-square without continuity correction, signed phi, odds ratio with half added and its interval."""
    g, o = group, outcome
    cells = df.where(g.isNotNull() & o.isNotNull()).agg(
        F.count_if(g & o).alias("a"), F.count_if(g & ~o).alias("b"), F.count_if(~g & o).alias("c"), F.count_if(~g & ~o).alias("d")
    )
    return two_by_two_statistics(cells)


def two_by_two_statistics(cells: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    det = a * d - b * c
    chi2 = n * det * det / ((a + b) * (c + d) * (a + c) * (b + d))
    phi = F.sqrt(F.col("chi2") / n) * F.when(a / (a + b) >= c / (c + d), 1).otherwise(-1)
    odds = (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))
    se = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))
    out = cells.withColumn("chi2", chi2).withColumn("phi", phi).withColumn("odds_ratio", odds)
    out = out.withColumn("or_low", F.exp(F.ln("odds_ratio") - se * 1.96)).withColumn("or_high", F.exp(F.ln("odds_ratio") + se * 1.96))
    return out.withColumn("p", chi2_p("chi2", F.lit(1)))


def bootstrap_means(df: DataFrame, value: str, reps: int = 10_000, seed: int = 42, block: int = 500) -> DataFrame:
    """Means of ``reps`` resamples with replacement, as (rep, mean).

    A resample draws how often each distinct value occurs: first how many draws fall to
    each slice of the histogram (the same seeded draw in every task), then inside the slice.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    hist = hist.withColumn("slice", slice_of(F.col("v"), order_bounds(hist, "v", 50_000)))
    sizes = {r["slice"]: r["n"] for r in hist.groupBy("slice").agg(F.sum("n").alias("n")).collect()}  # few slices
    names = sorted(sizes)
    total = sum(sizes.values())
    shares = [sizes[s] / total for s in names]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        part, b = int(pdf["slice"].iloc[0]), int(pdf["block"].iloc[0])
        first = b * block
        size = min(block, reps - first)
        split = np.random.default_rng([seed, b]).multinomial(total, shares, size=size)[:, names.index(part)]
        pdf = pdf.sort_values("v")
        values, weight = pdf["v"].to_numpy(), pdf["n"].to_numpy() / pdf["n"].sum()
        rng = np.random.default_rng([seed, b, part + 1])
        sums = [float(rng.multinomial(k, weight) @ values) for k in split]
        return pd.DataFrame({"rep": np.arange(first, first + size), "s": sums})

    blocks = F.sequence(F.lit(0), F.lit((reps - 1) // block))
    drawn = hist.withColumn("block", F.explode(blocks)).groupBy("slice", "block").applyInPandas(draw, "rep long, s double")
    return drawn.groupBy("rep").agg((F.sum("s") / total).alias("mean"))


def bootstrap_interval(df: DataFrame, value: str, reps: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean; the ``reps`` means are few, so plain percentiles do."""
    means = bootstrap_means(df, value, reps, seed)
    return means.agg(F.percentile("mean", alpha / 2).alias("ci_lo"), F.percentile("mean", 1 - alpha / 2).alias("ci_hi"))


def mardia(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Multivariate skewness and kurtosis with their asymptotic statistics.

    On whitened columns the skewness is a sum of squared third moments, so two
    aggregates replace the usual comparison of all pairs of rows.
    """
    k = len(columns)
    stats = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]
    stats += [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]
    row = df.agg(*stats).first()
    cov = np.array([[row[f"c_{i}_{j}"] for j in range(k)] for i in range(k)])
    whiten = np.linalg.inv(np.linalg.cholesky(cov))
    centred = [F.col(c) - row[f"m_{i}"] for i, c in enumerate(columns)]
    z = []
    for i in range(k):
        s = F.lit(0.0)
        for j in range(k):
            s = s + centred[j] * float(whiten[i, j])
        z.append(s)
    white = df.select(*[c.alias(f"z{i}") for i, c in enumerate(z)])
    length = F.lit(0.0)
    for i in range(k):
        length = length + F.col(f"z{i}") * F.col(f"z{i}")
    thirds = [F.avg(F.col(f"z{a}") * F.col(f"z{b}") * F.col(f"z{c}")).alias(f"t{a}_{b}_{c}") for a in range(k) for b in range(k) for c in range(k)]
    agg = white.agg(F.count("*").alias("n"), F.avg(length * length).alias("kurtosis"), *thirds)
    skew = F.lit(0.0)
    for a in range(k):
        for b in range(k):
            for c in range(k):
                skew = skew + F.col(f"t{a}_{b}_{c}") * F.col(f"t{a}_{b}_{c}")
    n = F.col("n")
    out = agg.select("n", skew.alias("skewness"), "kurtosis")
    out = out.withColumn("skew_stat", n * F.col("skewness") / 6).withColumn(
        "kurt_z", (F.col("kurtosis") - k * (k + 2)) / F.sqrt(F.lit(8.0 * k * (k + 2)) / n)
    )
    return out.withColumn("skew_p", chi2_p("skew_stat", F.lit(k * (k + 1) * (k + 2) // 6))).withColumn("kurt_p", normal_p("kurt_z"))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by z-scores of population spread."""
    parts = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]
    spread = df.select(F.struct(*parts)).scalar()  # one pass for all columns
    return df.withColumns({c: (F.col(c) - spread[c]["mean"]) / spread[c]["sd"] for c in columns})


# ---- spatial association -------------------------------------------------------


def spatial_lags(values: DataFrame, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scored columns and their neighbour averages ``w_<column>`` per id; edges are (id, neighbour, weight)."""
    z = standardise(values, columns)
    there = z.select(F.col("id").alias("neighbour"), *[F.col(c).alias(f"_{c}") for c in columns])
    lag = edges.join(there, "neighbour").groupBy("id").agg(
        F.sum("weight").alias("w_total"), *[F.sum(F.col("weight") * F.col(f"_{c}")).alias(f"w_{c}") for c in columns]
    )
    return z.join(lag, "id")


def lees_l(values: DataFrame, edges: DataFrame, x: str, y: str) -> DataFrame:
    """Bivariate spatial association with both Moran's I beside it."""
    j = spatial_lags(values, edges, [x, y])
    morans = [
        (F.count("*") / F.sum("w_total") * F.sum(F.col(c) * F.col(f"w_{c}")) / F.sum(F.col(c) * F.col(c))).alias(f"morans_i_{c}") for c in (x, y)
    ]
    top, bottom = F.sum(F.col(f"w_{x}") * F.col(f"w_{y}")), F.sum(F.col("w_total") * F.col("w_total"))
    return j.agg(F.count("*").alias("n"), (top / bottom).alias("lees_l"), *morans)


def local_lees_l(values: DataFrame, edges: DataFrame, x: str, y: str) -> DataFrame:
    """Each place's contribution; they sum to n times the global value."""
    j = spatial_lags(values, edges, [x, y])
    scale = j.select(F.count("*") / F.sum(F.col("w_total") * F.col("w_total"))).scalar()
    return j.select("id", (F.col(f"w_{x}") * F.col(f"w_{y}") * scale).alias("local_l"))


def permutation_test(
    values: DataFrame, edges: DataFrame, x: str, y: str, perms: int = 999, seed: int = 0, block: int = SHUFFLE_BLOCK
) -> DataFrame:
    """Pseudo p-values of Lee's L under keyed shuffles of ``y`` over the places numbered by id (``shuffle_sums``)."""
    j = materialise(spatial_lags(values, edges, [x, y]), "lags")
    n = j.count()
    back = edges.join(j.select("id", F.col(f"w_{x}").alias("_wx")), "id")
    coef = back.groupBy(F.col("neighbour").alias("id")).agg(F.sum(F.col("weight") * F.col("_wx")).alias("c"))
    numbered = row_number_within(j.select("id", F.col(y).alias("v")), [], "id").withColumn("nth", F.col("nth") - 1)
    numbered = materialise(numbered.join(coef, "id", "left").na.fill({"c": 0.0}).select("nth", "v", "c"), "numbered")
    bottom = j.select(F.sum(F.col("w_total") * F.col("w_total"))).scalar()
    observed = j.select(F.sum(F.col(f"w_{x}") * F.col(f"w_{y}"))).scalar()
    sums = shuffle_sums(numbered.select("nth", "c"), numbered.select("nth", "v"), n, perms, seed, block)
    s = sums.select((F.col("s") / bottom).alias("l")).withColumn("obs", observed / bottom)
    return s.agg(
        F.max("obs").alias("lees_l"), F.avg("l").alias("perm_mean"), F.stddev_pop("l").alias("perm_sd"),
        ((F.max("obs") - F.avg("l")) / F.stddev_pop("l")).alias("z"),
        ((F.count_if(F.col("l") >= F.col("obs")) + 1) / (perms + 1)).alias("p_one_sided"),
        ((F.count_if(F.abs("l") >= F.abs("obs")) + 1) / (perms + 1)).alias("p_two_sided"),
    )

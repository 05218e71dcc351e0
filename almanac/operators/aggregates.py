"""Counts, matrices, outliers and group tables of the analysis layer.

The population is always an explicit frame: each caller says which entities count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.labels import pure_label, require_mapped, rule_bucket
from almanac.functions.values import distance_tier, merge_values
from almanac.operators.ranks import percentiles
from almanac.operators.upsert import first_per_key

Z_LIMIT = 3.0


# ---- spread of means and shares ------------------------------------------------


def sd_mean(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def sem(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def ci95_mean(x: Column) -> Column:
    return sem(x) * 1.96


def sd_share(k: Column, n: Column) -> Column:
    p = k / n
    return F.when(n > 0, F.sqrt(p * (1 - p) / n)).otherwise(0.0)


def ci95_share(k: Column, n: Column) -> Column:
    return sd_share(k, n) * 1.96


# ---- populations and facts -----------------------------------------------------


def applicable(labels: DataFrame, category: str = "category", error: str = "error") -> DataFrame:
    """Labels that name something: not N/A, no error."""
    return labels.where((F.col(category) != "N/A") & (F.coalesce(F.col(error), F.lit("")) == ""))


def actions_view(
    labels: DataFrame,
    entities: DataFrame,
    rules: Sequence[tuple[str, Sequence[str]]],
    excluded: DataFrame | None = None,
    group: str = "grp",
    merge: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per applicable label with its bucket and its entity's group; unmapped labels fail the job."""
    out = applicable(labels)
    if excluded is not None:
        out = out.join(excluded.select("entity_id"), "entity_id", "left_anti")
    action = pure_label(F.col("category"))
    return (
        out.withColumn("action", action)
        .withColumn("bucket", require_mapped(rule_bucket(F.col("action"), rules)))
        .join(entities, "entity_id")
        .withColumn(group, merge_values(F.col(group), merge or {}))
    )


def active_entities(sites: DataFrame, pages: DataFrame, entity: str, site: str, has_error: str = "has_error") -> DataFrame:
    """Entities with a site that was read without error and has at least one page."""
    return sites.where(~F.col(has_error)).join(pages.select(site), site, "left_semi").select(entity).distinct()


def find_outliers(counts: DataFrame, n: str = "n", limit: float = Z_LIMIT) -> DataFrame:
    """z of ``log1p(n)`` by population spread, flagged beyond ``limit``."""
    logged = counts.withColumn("log_n", F.log1p(n))
    spread = logged.select(F.struct(F.avg("log_n").alias("mean"), F.stddev_pop("log_n").alias("sd"))).scalar()
    z = (F.col("log_n") - spread["mean"]) / spread["sd"]
    return logged.withColumn("zscore", z).withColumn("is_outlier", F.abs("zscore") > limit)


def denominator(active: DataFrame, outliers: DataFrame, entity: str) -> DataFrame:
    """Active entities that are not outliers."""
    return active.join(outliers.where("is_outlier").select(entity), entity, "left_anti")


def tukey_outliers(counts: DataFrame, n: str, log: bool = False, multiplier: float = 1.5) -> DataFrame:
    """Fence rule on raw or log counts: outside the quartiles by ``multiplier`` times their distance."""
    x = F.log1p(n) if log else F.col(n).cast("double")
    valued = counts.withColumn("_x", x)
    quart = percentiles(valued, "_x", {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3")).scalar()
    q1, q3 = quart["q1"], quart["q3"]
    reach = (q3 - q1) * multiplier
    return valued.withColumn("is_outlier", (F.col("_x") < q1 - reach) | (F.col("_x") > q3 + reach)).drop("_x")


# ---- matrices ------------------------------------------------------------------


def count_matrix(facts: DataFrame, ids: DataFrame, entity: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Entity by category counts for every given id, zero-filled, columns in the given order.

    Listing the categories lets the pivot run as one partial aggregate.
    """
    counts = facts.groupBy(entity).agg(*[F.count_if(F.col(category) == c).alias(c) for c in categories])
    return ids.select(entity).join(counts, entity, "left").na.fill(0, list(categories))


def long_form(matrix: DataFrame, entity: str, categories: Sequence[str], name: str = "category", value: str = "n") -> DataFrame:
    return matrix.unpivot([entity], list(categories), name, value)


def category_table(matrix: DataFrame, entity: str, categories: Sequence[str]) -> DataFrame:
    """Mean, spread, share of entities with any, and total per category."""
    n = F.col("n")
    return long_form(matrix, entity, categories).groupBy("category").agg(
        F.avg(n).alias("mean"),
        sd_mean(n).alias("sd"),
        F.count_if(n > 0).alias("n_with"),
        (F.count_if(n > 0) * 100.0 / F.count("*")).alias("pct_with"),
        F.sum(n).alias("total"),
    )


def overview(matrix: DataFrame, distinct_types: DataFrame, entity: str, categories: Sequence[str]) -> DataFrame:
    """Headline numbers of one population.

    ``distinct_types`` has (entity, types): how many different labels an entity has.
    """
    total = F.lit(0)
    for c in categories:
        total = total + F.col(c)
    per = matrix.select(entity, total.alias("n")).join(distinct_types, entity, "left").na.fill({"types": 0})
    n, active = F.col("n"), F.count_if(F.col("n") > 0)
    return per.agg(
        F.count("*").alias("n_all"),
        active.alias("n_active"),
        (active * 100.0 / F.count("*")).alias("pct_active"),
        (ci95_share(active, F.count("*")) * 100).alias("pct_ci95"),
        F.avg(n).alias("mean_all"),
        F.avg(F.when(n > 0, n)).alias("mean_active"),
        ci95_mean(F.when(n > 0, n)).alias("mean_active_ci95"),
        F.avg(F.when(n > 0, F.col("types"))).alias("types_active"),
        F.avg("types").alias("types_all"),
    )


# ---- group tables --------------------------------------------------------------


def share_active(members: DataFrame, facts: DataFrame, group: str, entity: str, low: int = 5) -> DataFrame:
    """Distinct members and members with a fact per group, their share, and a flag for small groups."""
    acted = facts.select(entity).distinct().withColumn("_hit", F.lit(True))
    per = members.select(group, entity).distinct().join(acted, entity, "left").groupBy(group)
    out = per.agg(F.count("*").alias("n"), F.count("_hit").alias("n_active"))
    return out.withColumn("share", F.col("n_active") / F.col("n")).withColumn("low_sample", F.col("n") < low)


def unplaced_count(members: DataFrame, group: str) -> DataFrame:
    """How many members have no group and so drop out."""
    return members.agg(F.count_if(F.col(group).isNull()).alias("dropped"))


def group_table(per_entity: DataFrame, group: str, n: str = "n") -> DataFrame:
    """Size, active size, share with its binomial spread, and means over all and over active members."""
    x = F.col(n)
    active = F.count_if(x > 0)
    return per_entity.groupBy(group).agg(
        F.count("*").alias("n_all"),
        active.alias("n_active"),
        (active * 100.0 / F.count("*")).alias("pct_active"),
        (sd_share(active, F.count("*")) * 100).alias("pct_sd"),
        F.avg(x).alias("mean_all"),
        sd_mean(x).alias("sd_all"),
        F.avg(F.when(x > 0, x)).alias("mean_active"),
        sem(F.when(x > 0, x)).alias("sem_active"),
        ci95_mean(x).alias("ci95_all"),
        (ci95_share(active, F.count("*")) * 100).alias("pct_ci95"),
    )


def composition(matrix: DataFrame, group: str, categories: Sequence[str], active_only: bool) -> DataFrame:
    """Mean count per group and category, over all or over active members."""
    total = F.lit(0)
    for c in categories:
        total = total + F.col(c)
    df = matrix.where(total > 0) if active_only else matrix
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in categories])


def own_shares(matrix: DataFrame, entity: str, categories: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Each entity's categories as shares of its own total; entities without any drop out."""
    total = F.lit(0)
    for c in categories:
        total = total + F.col(c)
    return matrix.where(total > 0).select(entity, *carry, *[(F.col(c) / total).alias(c) for c in categories])


def relative_mix(matrix: DataFrame, group: str, categories: Sequence[str]) -> DataFrame:
    """Group totals per category as shares of the group total."""
    sums = matrix.groupBy(group).agg(*[F.sum(c).alias(c) for c in categories])
    total = F.lit(0)
    for c in categories:
        total = total + F.col(c)
    return sums.select(group, *[F.try_divide(F.col(c), total).alias(c) for c in categories])


def prevalence(rows: DataFrame, group: str, within: str) -> DataFrame:
    """Share of each group inside each ``within`` value; the totals table is one row per value."""
    counts = rows.groupBy(within, group).agg(F.count("*").alias("n"))
    totals = counts.groupBy(within).agg(F.sum("n").alias("_all"))
    return counts.join(totals, within).select(within, group, "n", (F.col("n") / F.col("_all")).alias("share"))


def rate_table(facts: DataFrame, base: DataFrame, entity: str, keys: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Facts per base entity for each key and group, zero-free: (keys, groups, n, per_entity)."""
    sizes = base.groupBy(*groups).agg(F.count("*").alias("_size")) if groups else base.agg(F.count("*").alias("_size"))
    placed = facts.join(base, entity)
    counts = placed.groupBy(*groups, *keys).agg(F.count("*").alias("n"))
    if groups:
        return counts.join(sizes, list(groups)).select(*groups, *keys, "n", (F.col("n") / F.col("_size")).alias("per_entity"))
    return counts.select(*keys, "n", (F.col("n") / sizes.scalar()).alias("per_entity"))


def tier_table(rows: DataFrame, metres: str, n: str) -> DataFrame:
    """Size and mean per distance tier; empty tiers are reported too."""
    spark = rows.sparkSession
    tiers = spark.createDataFrame([("close",), ("medium",), ("far",)], "tier string")
    per = rows.groupBy(distance_tier(F.col(metres)).alias("tier")).agg(F.count("*").alias("n"), F.avg(n).alias("mean"))
    return tiers.join(per, "tier", "left").na.fill({"n": 0})


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), col).limit(top)


def dominant_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most common value per group, ties to the smaller value."""
    counts = df.groupBy(group, value).agg((-F.count("*")).alias("_n"))
    return counts.groupBy(group).agg(F.min(F.struct("_n", value)).alias("b")).select(group, F.col(f"b.{value}").alias(value), (-F.col("b._n")).alias("n"))


def supported_rate(df: DataFrame, group: str, hit: Column, least: int = 5, top: int = 15) -> DataFrame:
    """Hit rate of groups with enough rows, best ones first."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))
    return per.where(F.col("n") >= least).orderBy(F.desc("rate"), group).limit(top)


# ---- crawl and cohort reports --------------------------------------------------


def cohort_report(
    entities: DataFrame, sites: DataFrame, pages: DataFrame, entity: str, site: str, text: str, judged: str
) -> DataFrame:
    """Sites, pages and pages with text per entity, and the first reason that applies.

    Pages are counted per site before anything is joined.
    """
    per_site = pages.groupBy(site).agg(
        F.count("*").alias("_pages"), F.count_if(F.coalesce(F.col(text), F.lit("")) != "").alias("_text")
    )
    per = (
        sites.join(per_site, site, "left")
        .groupBy(entity)
        .agg(F.countDistinct(site).alias("n_sites"), F.sum("_pages").alias("n_pages"), F.sum("_text").alias("n_text"))
    )
    out = entities.join(per, entity, "left").na.fill(0, ["n_sites", "n_pages", "n_text"])
    reason = (
        F.when(F.col(judged), "judged but undecided")
        .when(F.col("n_sites") == 0, "no site")
        .when(F.col("n_pages") == 0, "site never read")
        .when(F.col("n_text") == 0, "no text")
        .otherwise("ready to judge")
    )
    return out.withColumn("reason", reason)


def crawl_outcome(manifest: DataFrame, pages: DataFrame, domain: str) -> DataFrame:
    """Outcome per domain: an error iff nothing was saved; stored pages force success."""
    per = manifest.groupBy(domain).agg(
        F.sum("pages_saved").alias("saved"), F.sum("pages_failed").alias("failed"), F.min("error_text").alias("error_text")
    )
    stored = pages.select(domain).distinct().withColumn("_stored", F.lit(True))
    out = per.join(stored, domain, "left")
    failed = (F.col("saved") == 0) & F.col("_stored").isNull()
    return out.select(
        domain, "saved", "failed", failed.alias("has_error"),
        F.when(failed, F.coalesce("error_text", F.lit("no pages saved"))).otherwise("").alias("error_text"),
    )


def listed_values(df: DataFrame, key: str, value: str, part_size: int | None = None) -> DataFrame:
    """Sorted distinct values per key: (key, items), one array per key.

    Distinct values are found before they are collected, so copies of one value do not meet.  With ``part_size`` a key comes
    as several arrays of about so many values (key, part, items), spread by a hash, for keys whose array would not
    fit into one cell.
    """
    distinct = df.select(key, value).distinct()
    items = F.array_sort(F.collect_list(value)).alias("items")
    if part_size is None:
        return distinct.groupBy(key).agg(items)
    sizes = distinct.groupBy(key).agg(F.ceil(F.count("*") / part_size).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64(value), F.col("_parts")).cast("int")
    return distinct.join(sizes, key).withColumn("part", part).groupBy(key, "part").agg(items)


def dimension(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], seq: str) -> DataFrame:
    """First row per key becomes the dimension row."""
    return first_per_key(df.select(*keys, *attributes, seq), keys, [seq]).drop(seq)


def entities_per_framing(framed: DataFrame, framing: str, entity: str) -> DataFrame:
    return framed.groupBy(framing).agg(F.countDistinct(entity).alias("entities"), F.count("*").alias("chunks"))


# ---- distributions -------------------------------------------------------------


def histogram(df: DataFrame, col: str, bins: int = 39, cap: float = 0.99) -> DataFrame:
    """Equal-width counts from the minimum to the ``cap`` percentile; larger values are not drawn.

    The last bin includes its upper edge.
    """
    lo = df.select(F.min(col)).scalar()
    hi = percentiles(df, col, {"cap": cap}).scalar()
    x = F.col(col)
    width = (hi - lo) / bins
    at = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where((x >= lo) & (x <= hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, group: str, col: str) -> DataFrame:
    """Minimum, quartiles and maximum per group, by linear interpolation."""
    ends = df.groupBy(group).agg(F.min(col).alias("low"), F.max(col).alias("high"))
    return ends.join(percentiles(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group]), group)

"""Label clean-up, ordered-rule bucketing and review verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.addresses import lookup
from almanac.session import join_counted

UNMAPPED = "??UNMAPPED"
# Texts that stand for "no particular action".
OTHER_TEXTS = ("", "other", "na", "n/a")

# Ordered tag rules, most specific first: (tag, accepted values, feature type).
FEATURE_RULES = (
    ("highway", ("motorway",), "highway_motorway"),
    ("highway", ("trunk",), "highway_trunk"),
    ("highway", ("primary",), "highway_primary"),
    ("aeroway", ("aerodrome", "airstrip"), "airport"),
    ("landuse", ("military",), "military"),
    ("military", ("base", "airfield"), "military"),
    ("industrial", ("slaughterhouse",), "abattoir"),
    ("landuse", ("landfill",), "landfill"),
    ("landuse", ("brownfield", "quarry"), "env_hazard"),
    ("industrial", ("chemical", "refinery", "oil", "mine"), "env_hazard"),
    ("landuse", ("industrial",), "industrial"),
    ("man_made", ("works",), "industrial"),
    ("industrial", ("factory", "scrap_yard", "warehouse"), "industrial"),
    ("landuse", ("forest", "grass", "recreation_ground", "village_green", "greenery"), "green_space"),
    ("leisure", ("park", "nature_reserve", "garden", "common"), "green_space"),
    ("natural", ("wood", "scrub", "wetland", "grassland", "heath"), "green_space"),
)


def pure_label(raw: Column) -> Column:
    """Text after the last underscore; the whole text when there is none."""
    return F.substring_index(raw, "_", -1)


def rule_bucket(label: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """First bucket with a contained key; blank-like texts are ``Other``; anything else is unmapped."""
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(s.isin(*OTHER_TEXTS), F.lit("Other"))
    for bucket, keys in rules:
        hit = F.lit(False)
        for k in keys:
            hit = hit | s.contains(k)
        out = out.when(hit, F.lit(bucket))
    return out.otherwise(F.lit(UNMAPPED))


def require_mapped(bucket: Column) -> Column:
    """The bucket, failing the job on the first unmapped label."""
    return F.when(bucket != UNMAPPED, bucket).otherwise(F.raise_error(F.lit("a label has no bucket rule")))


def major_category(raw: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Bucket of a raw label; null for N/A, blank and unmapped ones."""
    bucket = rule_bucket(pure_label(raw), rules)
    return F.when((raw != "N/A") & (raw != "") & (bucket != UNMAPPED), bucket)


def canonical_label(raw: Column, canon: Sequence[str], fallback: str, strip: str = r"\s\".,;") -> Column:
    """Canonical spelling of a label stripped of quotes and punctuation, or the fallback."""
    bare = F.lower(F.regexp_replace(F.coalesce(raw, F.lit("")), f"^[{strip}]+|[{strip}]+$", ""))
    return F.coalesce(lookup(bare, {c.lower(): c for c in canon}), F.lit(fallback))


def mapped_or_unknown(raw: Column, mapping: Mapping[str, str], unknown: str = "Unknown") -> Column:
    """Blank stays null; a present value without a mapping is unknown."""
    s = F.lower(F.trim(raw))
    return F.when(s != "", F.coalesce(lookup(s, mapping), F.lit(unknown)))


def owned_by(source: Column, owner: str) -> Column:
    """True for rows this job may rewrite: no source yet, or its own."""
    return source.isNull() | (source == owner)


def feature_type(tags: Column, rules: Sequence[tuple[str, Sequence[str], str]] = FEATURE_RULES) -> Column:
    """Feature type of a tag map by ordered rules; null means the object is dropped."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for tag, accepted, kind in rules:
        out = out.when(tags[tag].isin(*accepted), F.lit(kind))
    return out


def review_verdict(verdict: Column, notes: Column, mapping: Mapping[str, str]) -> Column:
    """Struct (action, label): whole word ``remove`` wins, then the exact verdict map, else skip."""
    v, n = F.trim(F.coalesce(verdict, F.lit(""))), F.trim(F.coalesce(notes, F.lit("")))
    remove = v.rlike(r"(?i)\bremove\b") | n.rlike(r"(?i)\bremove\b")
    label = lookup(v, mapping)
    return F.struct(
        F.when(remove, "delete").when(label.isNotNull(), "label").otherwise("skip").alias("action"),
        F.when(~remove, label).alias("label"),
    )


def sub_label(raw: Column) -> Column:
    """Text after the first underscore, a doubled ``NA_`` prefix dropped; null for N/A labels."""
    lab = F.regexp_replace(F.coalesce(raw, F.lit("")), r'^[\s"]+|[\s"]+$', "")
    part = F.when(lab.contains("_"), F.regexp_replace(lab, "^[^_]*_", "")).otherwise(lab)
    part = F.regexp_replace(part, "^(?i)NA_", "")
    norm = F.trim(F.regexp_replace(F.lower(part), r"\s+", " "))
    return F.when(~F.upper(lab).isin("N/A", "NA", ""), F.nullif(norm, F.lit("")))


def taxonomy_match(labels: DataFrame, label: str, canon: Sequence[str], cutoff: float = 0.6) -> DataFrame:
    """Map each distinct noisy label to a taxonomy entry.

    Tiers: equal; entry starts with the label (shortest entry); label starts with the
    entry (longest entry); best edit-distance ratio at or above ``cutoff``.  Only the
    distinct labels are scored, against a literal array of the fixed taxonomy.
    """
    distinct = labels.select(label, sub_label(F.col(label)).alias("_n")).distinct()
    entries = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(" ".join(c.lower().split())).alias("n"))
          for i, c in enumerate(canon)]
    )
    n = F.col("_n")

    def score(e: Column) -> Column:
        ratio = 1 - F.levenshtein(n, e["n"]) / F.greatest(F.length(n), F.length(e["n"]))
        tier = (
            F.when(e["n"] == n, 1.0)
            .when(e["n"].startswith(n), 2.0)
            .when(n.startswith(e["n"]), 3.0)
            .when(ratio >= cutoff, 4.0)
        )
        order = (
            F.when(tier == 2.0, F.length(e["n"]).cast("double"))
            .when(tier == 3.0, -F.length(e["n"]).cast("double"))
            .when(tier == 4.0, -ratio)
            .otherwise(0.0)
        )
        return F.struct(tier.alias("tier"), order.alias("o"), e["i"].alias("i"), e["c"].alias("c"))

    best = F.array_min(F.filter(F.transform(entries, score), lambda s: s["tier"].isNotNull()))
    mapped = distinct.where(n.isNotNull()).select(
        label, best["c"].alias("entry"), best["tier"].cast("int").alias("tier")
    )
    return join_counted(labels, mapped, label, "left")

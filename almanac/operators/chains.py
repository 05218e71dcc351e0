"""Joins along entity, site, page, span and label tables, and label transfer between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_chain(tables: Mapping[str, DataFrame], source: str) -> DataFrame:
    """Labels joined up to their entity.

    ``source="spans"`` goes label -> span -> page -> site -> entity; ``"pages"`` has no
    span step.  Tables carry the key columns span_id, page_id, site_id and entity_id.
    """
    out = tables["labels"]
    if source == "spans":
        out = out.join(tables["spans"], "span_id")
    elif source != "pages":
        raise ValueError(f"unknown label source {source!r}")
    for step, key in (("pages", "page_id"), ("sites", "site_id"), ("entities", "entity_id")):
        out = out.join(tables[step], key)
    return out


def framing_chain(tables: Mapping[str, DataFrame], source: str, allowed: Sequence[str]) -> DataFrame:
    """Framings of successful, applicable labels, down to the page."""
    good = tables["labels"].where((F.col("category") != "N/A") & (F.coalesce(F.col("error"), F.lit("")) == ""))
    out = tables["framings"].where(F.col("framing").isin(*allowed)).join(good, "label_id")
    if source == "spans":
        out = out.join(tables["spans"], "span_id")
    return out.join(tables["pages"], "page_id")


def left_counts(base: DataFrame, facts: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Count of facts per base row, 0 when there are none; facts are aggregated before the join."""
    counts = facts.groupBy(key).agg(F.count("*").alias(out))
    return base.join(counts, key, "left").na.fill({out: 0})


def natural_key_lookup(
    rows: DataFrame, lookup: DataFrame, first: str, second: str, value: str
) -> DataFrame:
    """Value by the first natural key, else by the second."""
    by = lambda k, n: lookup.where(F.col(k).isNotNull()).select(k, F.col(value).alias(n))
    return (
        rows.join(by(first, "_v1"), first, "left")
        .join(by(second, "_v2"), second, "left")
        .withColumn(value, F.coalesce("_v1", "_v2"))
        .drop("_v1", "_v2")
    )


def agreed_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key whose rows all agree; keys with two values drop out.

    Smallest and largest value are compared, so the state per key has fixed size.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    ends = known.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_hi"))
    return ends.where(F.col(value) == F.col("_hi")).drop("_hi")


def transfer_labels(labelled: DataFrame, sites: DataFrame, domain: str, entity: str, label: str) -> DataFrame:
    """Entity labels by way of the domain; conflicting domains and conflicting entities drop out."""
    by_domain = agreed_value(labelled, domain, label)
    return agreed_value(sites.select(entity, domain).join(by_domain, domain), entity, label)


def implied_label_outcome(
    sites: DataFrame, current: DataFrame, entity: str, implied: str, label: str, unknown: str = "Unknown"
) -> DataFrame:
    """What a label implied by an entity's URLs does to its current label."""
    ends = (
        sites.where(F.col(implied).isNotNull())
        .groupBy(entity)
        .agg(F.min(implied).alias(implied), F.max(implied).alias("_hi"))
    )
    outcome = (
        F.when(F.col(implied) != F.col("_hi"), "conflict")
        .when(F.col(label).isNull(), "fill-null")
        .when(F.col(label) == unknown, "upgrade-unknown")
        .when(F.col(label) == F.col(implied), "agree")
        .otherwise("disagree")
    )
    return ends.join(current, entity).select(entity, implied, label, outcome.alias("outcome"))


def precedence(layers: Sequence[tuple[str, Column]], label: str = "label") -> list[Column]:
    """Label and source columns of the strongest layer that has a value; strongest first."""
    value = F.coalesce(*[c for _, c in layers])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in layers])
    return [value.alias(label), source.alias(f"{label}_source")]

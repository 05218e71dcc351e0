"""Numbers, dates and small value maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL_BELOW = -1_000_000
YEAR_RANGE = (1995, 2027)

# Rural-urban commuting codes.
COMMUTING_LABELS = {
    1: "Urban core", 2: "Urban, high commute", 3: "Urban, low commute", 4: "Large rural, high commute",
    5: "Large rural, low commute", 6: "Large rural town", 7: "Small rural, high commute",
    8: "Small rural, low commute", 9: "Small rural town", 10: "Isolated rural",
}
# First and last variable number of each home-language group.
LANGUAGE_GROUPS = {
    "total": (1, 1), "english_only": (2, 2), "spanish": (3, 4), "indo_european": (5, 12),
    "asian_pacific": (13, 22), "arabic": (23, 24), "other": (25, 26),
}


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def clean_int(col: Column, below: int = SENTINEL_BELOW) -> Column:
    """Whole number, or null for unreadable values and missing-value sentinels."""
    n = col.try_cast("bigint")
    return F.when(n >= below, n)


def sum_present(cols: Sequence[Column]) -> Column:
    """Sum of the non-null values; null when all are null."""
    nothing = F.lit(None).cast("bigint")
    return F.aggregate(F.array(*cols), nothing, lambda total, x: F.coalesce(total + x, total, x))


def language_groups(variables: Mapping[int, Column]) -> dict[str, Column]:
    """Group totals from the 26 numbered language variables."""
    return {
        name: sum_present([clean_int(variables[i]) for i in range(lo, hi + 1)])
        for name, (lo, hi) in LANGUAGE_GROUPS.items()
    }


def commuting_code(raw: Column) -> Column:
    return blank_to_null(raw).try_cast("int")


def commuting_label(code: Column) -> Column:
    pairs = [F.lit(x) for kv in COMMUTING_LABELS.items() for x in kv]
    return F.create_map(*pairs)[code]


def plausible_date(raw: Column, years: tuple[int, int] = YEAR_RANGE) -> Column:
    """``yyyy-MM-dd`` from an RFC-822 or ISO text, in its own offset; null for junk years."""
    s = F.trim(raw)
    rfc = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s\-]+([A-Za-z]{3})[A-Za-z]*[\s\-]+(\d{4})\b"
    rfc_text = F.concat_ws(
        " ", F.regexp_extract(s, rfc, 1), F.initcap(F.regexp_extract(s, rfc, 2)), F.regexp_extract(s, rfc, 3)
    )
    iso_basic = F.regexp_extract(s, r"^(\d{8})(?:$|[T ])", 1)
    date = F.coalesce(
        F.when(s.rlike(r"[A-Za-z]{3},?\s"), F.try_to_date(rfc_text, "d MMM yyyy")),
        F.try_to_date(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"),
        F.try_to_date(iso_basic, "yyyyMMdd"),
    )
    return F.when(F.year(date).between(*years), F.date_format(date, "yyyy-MM-dd"))


def best_dated_source(ranked: Sequence[tuple[str, Column]], fallback: tuple[str, Column]) -> Column:
    """Struct (date, source): the latest date, ties to the earlier source; fallback only when all are missing."""
    best = F.greatest(
        *[
            F.when(
                blank_to_null(c).isNotNull(),
                F.struct(blank_to_null(c).alias("date"), F.lit(-i).alias("rank"), F.lit(n).alias("source")),
            )
            for i, (n, c) in enumerate(ranked)
        ]
    )
    name, col = fallback
    return F.struct(
        F.coalesce(best["date"], blank_to_null(col)).alias("date"),
        F.coalesce(best["source"], F.when(blank_to_null(col).isNotNull(), F.lit(name))).alias("source"),
    )


def distance_tier(metres: Column, edges: Sequence[float] = (25_000.0, 50_000.0)) -> Column:
    """close / medium / far; each upper edge belongs to its tier."""
    return (
        F.when((metres >= 0) & (metres <= edges[0]), "close")
        .when((metres > edges[0]) & (metres <= edges[1]), "medium")
        .when(metres > edges[1], "far")
    )


def merge_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Relabel some values at analysis time, keep the rest."""
    out = col
    for old, new in mapping.items():
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


def log_km(km: Column) -> Column:
    return F.log10(km + 0.01)


def size_factor(n: Column, largest: Column, floor: float = 0.12) -> Column:
    """Area-true symbol scale that never vanishes."""
    return F.greatest(F.sqrt(n / largest), F.lit(floor))

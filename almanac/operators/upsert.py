"""Keyed table maintenance without a table format: every operator returns the new snapshot.

A caller writes the snapshot to a new folder and then points readers to it; the
folder being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key by an order; a plain aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row per key by an order."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def append_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Target plus the first source row of each key the target does not have; ``inserted`` marks the new rows.

    A null in a key never conflicts, so such source rows are all appended.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    new = first_per_key(source.where(whole), keys, order).join(target.select(*keys), list(keys), "left_anti")
    new = new.select(*source.columns).unionByName(source.where(~whole))
    return target.withColumn("inserted", F.lit(False)).unionByName(new.withColumn("inserted", F.lit(True)))


def skipped_count(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """How many source rows an append-ignore drops in silence."""
    merged = append_ignore(target, source, keys, order)
    kept = merged.where("inserted").select(F.count("*")).scalar()
    return source.agg((F.count("*") - kept).alias("skipped"))


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column | str], stamp: str | None = None, at: Column | None = None
) -> DataFrame:
    """Source rows replace target rows of the same key; among source rows the last one wins.

    With ``stamp`` that column tells when a row was last written: ``at`` (the time of the run if not given) for rows from
    the source, what the target has for all others (null if it has no such column).
    """
    latest = last_per_key(source, keys, order)
    if stamp is not None:
        target = target if stamp in target.columns else target.withColumn(stamp, F.lit(None).cast("timestamp"))
        latest = latest.withColumn(stamp, (F.current_timestamp() if at is None else at).cast(target.schema[stamp].dataType))
    return target.join(latest.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(
        latest.select(*target.columns)
    )


def scoped_replace(stored: DataFrame, fresh: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Rows of the scoped keys come from ``fresh``, all others stay; running it twice changes nothing."""
    kept = stored.join(scope.select(key), key, "left_anti").select(*stored.columns)
    return kept.unionByName(fresh.join(scope.select(key), key, "left_semi").select(*stored.columns))


def cascade_delete(
    tables: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str, str]], root: str, doomed: DataFrame, key: str
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Delete root rows by key and their descendants.

    ``links`` are (child, child column, parent, parent column), parents first.
    Returns (kept, backup) per table.
    """
    out = {
        root: (
            tables[root].join(doomed.select(key), key, "left_anti").select(*tables[root].columns),
            tables[root].join(doomed.select(key), key, "left_semi").select(*tables[root].columns),
        )
    }
    for child, ccol, parent, pcol in links:
        gone = out[parent][1].select(F.col(pcol).alias(ccol)).distinct()
        t = tables[child]
        out[child] = (
            t.join(gone, ccol, "left_anti").select(*t.columns),
            t.join(gone, ccol, "left_semi").select(*t.columns),
        )
    return out

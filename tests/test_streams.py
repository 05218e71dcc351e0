"""Bucket tables and the streams kept on them: replays, re-arrivals, expiry and retries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from almanac.operators import text, upsert
from almanac.plans import source_plans
from almanac.session import scratch_path
from almanac.sources.buckets import replace_rows
from almanac.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_an_epoch_opens_its_own_buckets_only(spark):
    table = incremental.new_buckets(spark, "t", "k long, v string", ["k"], 16)
    assert table.read().count() == 0 and table.manifest() == {}
    table.update(0, spark.range(200).selectExpr("id AS k", "'old' AS v"), replace_rows(["k"]))
    change = spark.createDataFrame([(7, "new"), (None, "no key")], "k long, v string")
    touched = table.touched(change)
    assert len(touched) == 2
    opened = table.read(touched).inputFiles()
    assert {f.split("_bucket=")[1].split("/")[0] for f in opened} == {str(b) for b in touched} and len(opened) == 2
    for _ in range(2):  # an epoch that is repeated gives the same table
        table.update(1, change, replace_rows(["k"]))
        want = [(i, "new" if i == 7 else "old") for i in range(200)] + [(None, "no key")]
        assert rows(table.read()) == sorted(want, key=repr)
    assert rows(table.read(before=1)) == sorted([(i, "old") for i in range(200)], key=repr)
    table.update(2, change.where("false"), replace_rows(["k"]))
    table.update(3, change.where("k IS NULL").withColumn("v", F.lit("again")), replace_rows(["k"]))
    assert table.read().count() == 201 and table.read().where("k IS NULL").first()["v"] == "again"
    assert len(table.read().inputFiles()) == 16  # one file a bucket, however many epochs


def test_seen_ids_replay_and_expire(spark):
    seen = incremental.new_buckets(spark, "seen", "id long, epoch int", ["id"], 4)
    batch = lambda *pairs: spark.createDataFrame(list(pairs), "id long, v string")
    take = lambda df, epoch: rows(incremental.new_ids(df, epoch, "id", ["v"], seen, keep_epochs=2))
    first = batch((1, "b"), (1, "a"), (2, "x"), (None, "n"))
    assert take(first, 0) == take(first, 0) == [(1, "a"), (2, "x")]  # the smallest version, again on a replay
    assert take(batch((1, "c"), (3, "y")), 1) == [(3, "y")]
    assert take(batch((1, "c")), 2) == [] and take(batch((1, "c")), 4) == []  # met again in time
    assert take(batch((2, "late"), (3, "late")), 4) == [(2, "late"), (3, "late")]  # forgotten
    assert take(batch((1, "c")), 20) == [(1, "c")]
    assert rows(seen.read(seen.touched(batch((1, "c")))).where("id = 1")) == [(1, 20)]


def test_totals_of_pages_that_come_again(spark):
    """Re-arrived, changed and moved pages: the totals equal the batch rollup of the last versions."""
    lexicon = text.lexicon_pattern(["solar", "wind"])
    first = [(i, f"s{i % 3}", "solar power and wind " * (i % 4), 1) for i in range(30)]
    second = [(i, f"s{(i + 1) % 3}", "no such word" if i % 2 else "solar, far away from it the wind " * 3, 3) for i in range(0, 30, 4)]
    second += [(100, "s9", "wind", 1)]
    third = [(0, "s0", "wind and solar", 2), (100, "s8", "solar", 2), (100, "s7", "wind", 2), (1, "s5", "wind", 2)]  # page 0 comes late
    schema = "page long, site string, body string, version int"
    counts = "pages_with_hits bigint, total_pages bigint, spans bigint"
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "checkpoint")
    parts = incremental.new_buckets(spark, "parts", f"page long, site string, version int, {counts}", ["page"], 8)
    totals = incremental.new_buckets(spark, "totals", f"site string, {counts}", ["site"], 4)
    every = []
    for drop in (first, second, third):
        every += drop
        spark.createDataFrame(drop, schema).coalesce(1).write.mode("append").parquet(inbox)
        got = incremental.rolling_site_totals(
            incremental.file_stream(spark, inbox, schema), "page", "site", "body", "version", lexicon, parts, totals, checkpoint
        )
        last = {}
        for r in sorted(every, key=lambda r: (r[3], r[1])):
            last[r[0]] = r
        want = text.site_rollup(spark.createDataFrame(list(last.values()), schema), "site", "body", lexicon)
        assert rows(got.select(*want.columns)) == rows(want)
    assert "s9" not in {r["site"] for r in got.collect()}  # its only page has moved


def test_failed_items_come_up_on_the_next_trigger(spark):
    judged = incremental.new_buckets(spark, "judged", "id long, label string, error string, attempts int, judged_at int", ["id"], 4)
    pending, checkpoint = incremental.new_table(spark, "pending", "id long, body string, attempts int", ["id"])
    inbox = scratch_path(spark, "inbox")

    def scorer(epoch, body):
        if body.startswith("hard") and epoch < 2:
            raise TimeoutError(f"busy {epoch}")
        if body == "never":
            raise ValueError("no")
        return body[:4]

    def run(*items):
        spark.createDataFrame(list(items), "id long, body string").coalesce(1).write.mode("append").parquet(inbox)
        stream = incremental.file_stream(spark, inbox, "id long, body string")
        out = incremental.judge_stream(stream, "id", "body", scorer, judged, pending, checkpoint)
        return {r["id"]: (r["label"], r["attempts"], r["judged_at"]) for r in out.collect()}

    assert run((1, "easy"), (2, "hard one"), (3, "never"), (None, "x")) == {1: ("easy", 1, 0), 2: (None, 1, 0), 3: (None, 1, 0)}
    assert run((1, "other"), (4, "easy")) == {1: ("easy", 1, 0), 2: (None, 2, 1), 3: (None, 2, 1), 4: ("easy", 1, 1)}
    last = run((5, "easy"))
    assert last[2] == ("hard", 3, 2) and last[3] == (None, 3, 2) and last[5] == ("easy", 1, 2)
    left = incremental.errored(judged.read()).collect()
    assert [(r["id"], r["error"]) for r in left] == [(3, "ValueError: no")]


def test_upsert_stamps_what_it_writes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    source = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, o int")
    once = upsert.upsert(target, source, ["k"], ["o"], "at", F.lit("2024-01-01"))
    assert [(r["k"], r["v"], str(r["at"])[:10]) for r in once.orderBy("k").collect()] == [(1, "a", "None"), (2, "d", "2024-01-01"), (3, "e", "2024-01-01")]
    twice = upsert.upsert(once, source.where("k = 3").withColumn("v", F.lit("f")), ["k"], ["o"], "at", F.lit("2024-02-02"))
    assert [str(r["at"])[:10] for r in twice.orderBy("k").collect()] == ["None", "2024-01-01", "2024-02-02"]
    now = upsert.upsert(target, source, ["k"], ["o"], "at").where("k = 2").first()["at"]
    assert now is not None and upsert.upsert(target, source, ["k"], ["o"]).columns == ["k", "v"]


@pytest.mark.parametrize("name", ["r01_incremental_chunks", "r03_rolling_site_totals"])
def test_pages_arrive_more_than_once(name):
    """The registered queries feed pages that come again, so their checks see re-arrivals."""
    import inspect

    from almanac.plans import source_plans

    body = inspect.getsource(getattr(source_plans, name[:3]))
    assert "arrived(spark, docs, again)" in body or "arrived(spark, old, docs)" in body


def test_arrivals_are_as_many_files_as_the_scan_has_splits(spark):
    """A large drop is not gathered into a few files, and an epoch takes its share of them."""
    df = spark.range(0, 1_000, 1, 12)
    path, files = source_plans.arrived(spark, df, df)
    assert len(list(Path(path).glob("*.parquet"))) == 24 and files == 6
    assert max(r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_name").count().collect()) <= 84
    path, files = source_plans.arrived(spark, df.coalesce(1), parts=3)
    assert len(list(Path(path).glob("*.parquet"))) == 3 and files == 1

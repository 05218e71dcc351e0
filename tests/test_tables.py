"""Sources, keyed maintenance, sampling and incremental runs."""

from pyspark.sql import functions as F

from almanac.operators import sampling, text, upsert
from almanac.plans import source_plans
from almanac.session import scratch_path
from almanac.sources import files, snapshots
from almanac.streaming import incremental


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_append_ignore_reports_skipped(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string").withColumn("s", F.lit(0))
    source = spark.createDataFrame([(1, "b", 1), (2, "c", 3), (2, "d", 2), (None, "e", 4)], "k long, v string, s int")
    merged = upsert.append_ignore(target, source, ["k"], ["s"])
    assert sorted((r.k or 0, r.v, r.inserted) for r in merged.collect()) == [(0, "e", True), (1, "a", False), (2, "d", True)]
    assert upsert.skipped_count(target, source, ["k"], ["s"]).first().skipped == 2


def test_upsert_latest_wins(spark):
    target = spark.createDataFrame([(1, "a"), (3, "z")], "k long, v string")
    source = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k long, v string, s int")
    assert rows(upsert.upsert(target, source, ["k"], ["s"]), "k", "v") == [(1, "c"), (2, "d"), (3, "z")]


def test_scoped_replace_is_idempotent(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "d string, n int")
    fresh = spark.createDataFrame([("a", 9), ("a", 8), ("b", 7)], "d string, n int")
    scope = spark.createDataFrame([("a",)], "d string")
    once = upsert.scoped_replace(stored, fresh, scope, "d")
    assert rows(once, "d", "n") == rows(upsert.scoped_replace(once, fresh, scope, "d"), "d", "n") == [("a", 8), ("a", 9), ("b", 2)]


def test_epoch_table_repeats_safely(spark):
    t = snapshots.EpochTable(spark, scratch_path(spark, "t"), "k long, v string", ["k"])
    assert t.current().count() == 0
    t.write(0, spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    t.write(1, spark.createDataFrame([(2, "c")], "k long, v string"))
    t.write(1, spark.createDataFrame([(2, "c")], "k long, v string"))
    assert rows(t.current(), "k", "v") == [(1, "a"), (2, "c")]
    assert rows(t.compact(scratch_path(spark, "t2")).current(), "k", "v") == [(1, "a"), (2, "c")]


def test_incremental_equals_batch_over_two_runs(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (40 + i)) for i in range(12)], "id long, body string")
    inbox = scratch_path(spark, "inbox")
    table, checkpoint = incremental.new_table(spark, "chunks", "id long, chunk_index int, chunk_text string", ["id", "chunk_index"])
    seen = incremental.new_buckets(spark, "chunked", "id long, epoch int", ["id"])
    for part in (docs.where("id < 6"), docs.where("id >= 4")):  # two pages arrive again
        part.coalesce(1).write.mode("append").parquet(inbox)
        got = incremental.ingest_chunks(incremental.file_stream(spark, inbox, "id long, body string"), "id", "body", table, seen, checkpoint)
    want = text.fixed_chunks(docs, "id", "body")
    assert rows(got, "id", "chunk_index", "chunk_text") == rows(want, "id", "chunk_index", "chunk_text")
    assert table.history().count() == want.count()


def test_coding_sheet(spark, tmp_path):
    body = (
        ",,,,Framing,,Énergie\n0,Entity,Link,Keywords,Implicit,Explicit,Solaire\n"
        ",x,http://ex.org/é,k,TRUE,FALSE,true\n,y,none,k,TRUE,TRUE,TRUE\n"
    )
    (tmp_path / "s.csv").write_bytes(body.encode("latin-1"))
    got = files.read_coding_sheet(spark, str(tmp_path / "s.csv"))
    assert rows(got, "link", "category", "label") == [("http://ex.org/é", "Framing", "Implicit"), ("http://ex.org/é", "Énergie", "Solaire")]


def test_lists_and_padded_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" Ab \nab\n\nC\n")
    (tmp_path / "p.txt").write_text("1|u|2020\n2|v\n3\n")
    (tmp_path / "k.txt").write_text('"solar power", "wind*",\n"rain garden"')
    assert rows(files.read_list(spark, str(tmp_path / "l.txt")), "value") == [("ab",), ("c",)]
    assert rows(files.read_padded(spark, str(tmp_path / "p.txt"), ["a", "b", "c"]), "a", "b", "c") == [("1", "u", "2020"), ("2", "v", ""), ("3", "", "")]
    assert files.read_quoted_list(spark, str(tmp_path / "k.txt")) == ["solar power", "wind*", "rain garden"]


def test_html_tree_drops_unknown_domains(spark, tmp_path):
    for d, f in (("ex.org", "a/index.html"), ("ex.org", "b.html"), ("bad.org", "c.html")):
        path = tmp_path / "tree" / d / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"<p>{f}</p>\n<i>")
    sites = spark.createDataFrame([("ex.org",)], "domain string")
    got = files.read_html_tree(spark, str(tmp_path / "tree"), sites)
    assert rows(got, "domain", "page_path", "html") == [
        ("ex.org", "ex.org/a/index.html", "<p>a/index.html</p>\n<i>"), ("ex.org", "ex.org/b.html", "<p>b.html</p>\n<i>")
    ]


def test_page_bundles_hold_whole_pages_in_few_files(spark, tmp_path):
    html = F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit('<p>"é\n\r\u2028\u001e\\</p>\n'), F.col("id").cast("string")))
    domain = F.when(F.col("id") % 3 == 0, "bad.org").otherwise("ex.org")
    pages = spark.range(300).select(domain.alias("domain"), (F.floor(F.col("id") / 2)).cast("string").alias("page_path"), html.alias("html"))
    root = str(tmp_path / "tree")
    files.write_page_bundles(pages.coalesce(2), root)
    assert len(list((tmp_path / "tree").rglob("part-*.json"))) <= 4
    got = files.read_page_bundles(spark, root, spark.createDataFrame([("ex.org",)], "domain string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, pages.where("domain = 'ex.org'").collect()), key=repr)
    assert got.count() == 200


def test_html_tree_query_takes_no_file_per_page(spark, tmp_path, monkeypatch):
    n = 400
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://www.ex.org/a").alias("url"), F.concat(F.lit("<p>\n"), "id").alias("html"))
    pages.write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    root = tmp_path / "made"
    monkeypatch.setattr(source_plans, "scratch_path", lambda spark, name: str(root))
    got = source_plans.s04(spark, str(tmp_path / "sf"))
    assert rows(got, "domain", "page_id", "html") == [("ex.org", i, f"<p>\n{i}") for i in range(n)]
    assert len([f for f in root.rglob("part-*") if not f.name.startswith(".")]) <= 50


def test_split_sizes_and_repeatability(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    parts = [("train", 0.6), ("valid", 0.2), ("test", 0.2)]
    a = sampling.stratified_split(df, "y", "id", parts)
    sizes = {(r.y, r.split): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "train"): 54, (0, "valid"): 18, (0, "test"): 18, (1, "train"): 6, (1, "valid"): 2, (1, "test"): 2}
    b = sampling.stratified_split(df.repartition(7), "y", "id", parts)
    assert rows(a, "id", "split") == rows(b, "id", "split")
    kept = sampling.undersample(df, "y", "id", 0.25)
    assert {r.y: r["count"] for r in kept.groupBy("y").count().collect()} == {1: 10, 0: 30}

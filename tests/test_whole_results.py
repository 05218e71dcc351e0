"""Nothing is cut or changed by sizes: slices, samples, reports, chunks, offsets, labels, broadcasts."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from almanac import session
from almanac.functions import labels, pages
from almanac.operators import ranks, sampling, text
from almanac.sources import files


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 37, 1000])
def test_slice_is_the_number_of_bounds_below(spark, n):
    bounds = sorted(random.Random(n).uniform(0, 100) for _ in range(n))
    values = [-1.0, 0.0, 101.0, None, *bounds[:20], *[i * 3.3 for i in range(30)]]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.slice_of(F.col("v"), bounds).alias("s"))
    for r in df.collect():
        assert r.s == (0 if r.v is None else bisect.bisect_left(bounds, r.v))


def test_sample_is_the_same_by_either_plan(spark, monkeypatch):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    few = {(r.g, r.id) for r in sampling.seeded_sample_per_group(df, "g", "id", 7).collect()}
    monkeypatch.setattr(sampling, "GROUP_LIMIT", 0)
    assert few == {(r.g, r.id) for r in sampling.seeded_sample_per_group(df, "g", "id", 7).collect()}


def test_report_positions_cover_every_row(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 2 == 0).alias("late"))
    got = sampling.numbered_report(df.repartition(6), F.col("late"), "k").collect()
    want = sorted(((r.late, r.k) for r in df.collect()))
    assert [(r.late, r.k) for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(1, 3001))


def test_report_of_no_rows_is_empty(spark):
    assert sampling.numbered_report(spark.range(0), F.lit(False), "id").collect() == []


def loop_chunks(body, size):
    start, out = 0, []
    while start < len(body or ""):
        end = min(start + size, len(body))
        if end < len(body):
            space = body.rfind(" ", start, end)
            end = space if space > start else end
        if body[start:end].strip():
            out.append(body[start:end].strip())
        start = end
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_chunks_follow_the_loop(spark, size):
    draw = random.Random(size)
    bodies = [None, "", " ", "\n \t ", "x" * 1200, "\x1c a \x85b  "]
    bodies += ["".join(draw.choice("ab  \n\té\U0001f600") for _ in range(draw.randrange(1500 if size > 99 else 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {}
    for r in text.fixed_chunks(df, "id", "body", size).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.chunk_text)
        assert r.chunk_index == len(got[r.id]) - 1
    assert got == {i: c for i, b in enumerate(bodies) if (c := loop_chunks(b, size))}


def test_listing_hits_moves_nothing(spark):
    rows = [(1, "this and that, with this"), (2, None), (3, ""), (4, "none here"), (5, "that")]
    hits = text.keyword_hits(spark.createDataFrame(rows, "id int, body string"), "id", "body", text.lexicon_pattern(["that", "this"]))
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.pos, r.keyword, r.start, r.end) for r in hits.collect()}
    assert got == {(1, 0, "this", 0, 4), (1, 1, "that", 9, 13), (1, 2, "this", 20, 24), (5, 0, "that", 0, 4)}


def test_label_and_page_text_keep_their_end(spark):
    long = "x" * 600_000 + " end"
    row = spark.range(1).select(
        labels.sub_label(F.lit("a_na_Blue Steel")).alias("sub"), pages.quick_text(F.lit(f"<p>{long}</p>")).alias("t"),
        pages.quick_text(F.lit("<p>abcdef</p>"), 3).alias("cut"),
    ).first()
    assert (row["sub"], row["t"], row["cut"]) == ("blue steel", long, "abc")


@pytest.mark.parametrize("n", [0, 2])
def test_report_of_another_number_of_rows_is_refused(spark, tmp_path, n):
    with pytest.raises(ValueError):
        files.write_report(spark.range(n), str(tmp_path / "r"))


def test_wide_side_is_not_sent(spark, monkeypatch):
    side = spark.range(50).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    big = spark.range(100)
    assert session.join_counted(big, side, "id", "inner").count() == 50
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    assert not session._sendable(side)
    assert session._sendable(spark.range(0))
    assert session.join_counted(big, side, "id", "inner").count() == 50


@pytest.mark.parametrize("name, operator", [("m01", "sweep"), ("m01_profiles", "sweep"), ("m02", "centre_quality")])
def test_sweeps_are_registered_whole(monkeypatch, name, operator):
    from inspect import signature

    from almanac.plans import model_plans

    plan, real, asked = getattr(model_plans, name), signature(getattr(model_plans.clusters, operator)), {}

    class Stop(Exception):
        pass

    def sweep(*args, **options):
        bound = real.bind(*args, **options)
        bound.apply_defaults()
        asked.update(bound.arguments)
        raise Stop

    monkeypatch.setattr(model_plans.clusters, operator, sweep)
    monkeypatch.setattr(model_plans, "features", lambda spark, sf: None)
    with pytest.raises(Stop):
        plan(None, None)
    assert list(asked["ks"]) == list(range(2, 9)) and asked["n_init"] == 10


def test_permutations_are_registered_whole(monkeypatch):
    from almanac.plans import statistics_plans

    monkeypatch.setattr(statistics_plans, "spatial", lambda spark, sf: (None, None))
    monkeypatch.setattr(statistics_plans, "rounded", lambda out, *columns: out)
    monkeypatch.setattr(statistics_plans.st, "permutation_test", lambda *args, perms=999, **options: perms)
    assert statistics_plans.x14(None, None) == 9_999

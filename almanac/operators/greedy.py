"""Global greedy one-to-one matching without a sorted loop: chains of competing places are contracted.

Every place keeps the exact list of its nearest places of the other side.  A place points to the first of its list; along
pointers the pairs get closer, so they end in places that point to each other, whose pair is final.  Further up the
pointers the outcome follows from the next place's: the second choice of a place with one member gets it exactly if that
place loses its own first choice, a later choice loses it if the place gets its first choice.  These rules compose, so
pointer jumping decides whole chains in the logarithm of their length, and one round settles what a loop over sorted
pairs would take one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.geo import haversine_km
from almanac.operators.nearest import locations, nearest_places
from almanac.operators.ranks import row_number_within
from almanac.session import materialise

LIST = 8  # places a list starts with; exhausted lists are filled again, longer if they hold one distance only
ROUNDS = 64

#: What a place knows of its first choice, by what becomes of that place's own first choice (gets it, loses it, unknown).
MUTUAL, SECOND, LATER, OPEN = "TTT", "FTU", "FUU", "UUU"


def _places(df: DataFrame, side: int) -> DataFrame:
    """Distinct places as numbered vertices; ``left`` members of them are free, the next to go has the key ``head``."""
    loc = locations(df, "id", "lat", "lon").select(
        (F.monotonically_increasing_id() * 2 + side).alias("v"), F.lit(side).alias("side"), "lat", "lon", "x", "y", "z",
        F.col("size").alias("left"), F.lit(0).cast("bigint").alias("used"), F.col("id").alias("head"),
        F.lit(False).alias("complete"),
    )
    return materialise(loc, "places")


def _filled(alive: DataFrame, lists: DataFrame | None, max_km: float) -> tuple[DataFrame, DataFrame]:
    """Lists without the places that are gone; those run dry are filled again from all places left.

    Of a list that may go on, the places at its last distance are left out, as others of that distance may be missing.
    """
    if lists is not None:
        there = alive.select(F.col("v").alias("other"))
        lists = lists.join(there, "other", "left_semi").join(alive.select("v"), "v", "left_semi").select("v", "other", "d2")
        lists = materialise(lists, "lists")
    length = LIST
    while True:
        dry = alive.where("NOT complete")
        if lists is not None:
            dry = dry.join(lists.select("v").distinct(), "v", "left_anti")
        dry = materialise(dry.select("v", "side", "x", "y", "z"), "dry")
        if dry.isEmpty():
            return alive, lists
        found = None
        for side in (0, 1):
            ask = dry.where(F.col("side") == side).select(F.col("v").alias("id"), "x", "y", "z")
            there = alive.where(F.col("side") != side).select(F.col("v").alias("id"), "x", "y", "z")
            part = nearest_places(ask, there, length, max_km).select(F.col("id").alias("v"), "other", "d2")
            found = part if found is None else found.unionByName(part)
        found = materialise(found, "found")
        ends = found.groupBy("v").agg(F.count("*").alias("n"), F.max("d2").alias("last"))
        full = F.coalesce(F.col("n") >= length, F.lit(False))
        done = dry.select("v").join(ends, "v", "left").select("v", (~full).alias("_done"))
        more = found.join(ends, "v").where(~full | (F.col("d2") < F.col("last"))).select("v", "other", "d2")
        lists = more if lists is None else lists.unionByName(more)
        lists = materialise(lists, "lists")
        alive = alive.join(done, "v", "left").withColumn("complete", F.col("complete") | F.coalesce("_done", F.lit(False))).drop("_done")
        alive = materialise(alive, "places")
        length *= 2


def _choices(alive: DataFrame, lists: DataFrame) -> DataFrame:
    """v, a, d2 (first choice and its distance), second, tied, and the free members and side of v."""
    heads = alive.select(F.col("v").alias("other"), "head")
    order = F.array_sort(F.collect_list(F.struct("d2", "head", "other")))  # a list is short
    two = lists.join(heads, "other").groupBy("v").agg(F.slice(order, 1, 2).alias("two"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    told = two.select(
        "v", first["other"].alias("a"), first["d2"].alias("d2"), second["other"].alias("second"),
        F.coalesce(second["d2"] == first["d2"], F.lit(False)).alias("tied"),
    )
    return materialise(told.join(alive.select("v", "side", "left", "used"), "v"), "choices")


def _outcome(rule: Column, of: Column) -> Column:
    """``rule`` applied to an outcome T, F or U."""
    return F.substring(rule, F.instr(F.lit("TFU"), of), 1)


def _decided(choices: DataFrame) -> DataFrame:
    """v, a and x: whether v gets its first choice (T), loses it (F) or does not know yet (U)."""
    target = choices.select(
        F.col("v").alias("a"), F.col("a").alias("a1"), F.col("second").alias("a2"), F.col("left").alias("a_left")
    )
    single = F.col("a_left") == 1
    rule = (
        F.when(F.col("a1") == F.col("v"), MUTUAL).when(single & (F.col("a2") == F.col("v")), SECOND).when(single, LATER).otherwise(OPEN)
    )
    at = choices.select("v", "a").join(target, "a", "left").select("v", "a", F.coalesce(rule, F.lit(OPEN)).alias("rule"))
    at = materialise(at.withColumn("to", F.col("a")), "pointers")
    known = (F.substring("rule", 1, 1) == F.substring("rule", 2, 1)) & (F.substring("rule", 2, 1) == F.substring("rule", 3, 1))
    while not at.where(~known).isEmpty():  # each jump doubles the stretch a rule spans, and pointers cannot form a ring
        ahead = at.select(F.col("v").alias("to"), F.col("rule").alias("then"), F.col("to").alias("next"))
        moved = at.where(~known).join(ahead, "to")
        composed = F.concat(*[_outcome(F.col("rule"), F.substring("then", i, 1)) for i in (1, 2, 3)])
        moved = moved.select("v", "a", composed.alias("rule"), F.col("next").alias("to"))
        at = materialise(at.where(known).unionByName(moved), "pointers")
    return at.select("v", "a", F.substring("rule", 1, 1).alias("x"))


def _settled(choices: DataFrame) -> DataFrame:
    """l, r, l_used, r_used, amount: places whose next free members pair off now.

    At equal distances only the next members pair: which place comes first among equals may change after them.
    """
    won = _decided(choices).where("x = 'T'").select("v", "a")
    end = lambda name: choices.select(F.col("v").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("side", "left", "used", "tied", "a")])
    pairs = won.join(end("v"), "v").join(end("a"), "a")
    mutual = F.col("a_a") == F.col("v")
    pairs = pairs.where(~mutual | (F.col("v_side") == 0))
    amount = F.when(mutual & ~F.col("v_tied") & ~F.col("a_tied"), F.least("v_left", "a_left")).otherwise(1)
    is_left = F.col("v_side") == 0
    pick = lambda c, d: F.when(is_left, F.col(c)).otherwise(F.col(d))
    return materialise(
        pairs.select(
            pick("v", "a").alias("l"), pick("a", "v").alias("r"), pick("v_used", "a_used").alias("l_used"),
            pick("a_used", "v_used").alias("r_used"), amount.cast("bigint").alias("amount"),
        ),
        "settled",
    )


def _remaining(alive: DataFrame, settled: DataFrame, crowds: DataFrame) -> DataFrame:
    """Places with members left, and the key of the next of them."""
    took = settled.select(F.col("l").alias("v"), "amount").unionByName(settled.select(F.col("r").alias("v"), "amount"))
    rows = alive.join(took, "v", "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast("bigint")))
    rows = rows.withColumn("left", F.col("left") - F.col("amount")).withColumn("used", F.col("used") + F.col("amount")).where("left > 0")
    rows = rows.join(crowds.withColumnRenamed("key", "_key"), (F.col("v") == F.col("_v")) & (F.col("used") + 1 == F.col("nth")), "left")
    return materialise(
        rows.withColumn("head", F.when(F.col("amount") > 0, F.col("_key")).otherwise(F.col("head"))).select(*alive.columns), "places"
    )


def _members(df: DataFrame, places: DataFrame) -> DataFrame:
    """_v, nth, key: the rows of every place, numbered by key."""
    numbered = row_number_within(df, ["lat", "lon"], "id")
    return numbered.join(places.select("lat", "lon", F.col("v").alias("_v")), ["lat", "lon"]).select("_v", "nth", F.col("id").alias("key"))


def _nothing(spark: SparkSession, key_type: str) -> DataFrame:
    return spark.createDataFrame([], f"left_id {key_type}, right_id {key_type}, km double")


def greedy_nearest_pairs(
    left: DataFrame, right: DataFrame, key: str = "id", lat: str = "lat", lon: str = "lon", max_km: float = 1.0, rounds: int = ROUNDS
) -> DataFrame:
    """One-to-one pairs as if all pairs were taken in order of (distance, left key, right key): left_id, right_id, km.

    Works on places, not rows; rows of one place pair off by key.  A round settles every chain of first and second
    choices, however long, with a logarithmic number of joins; only places that wait for a third choice or whose
    members are many go on to the next round.  Should ``rounds`` rounds not be enough, it stops with an error instead of
    going on for as many rounds as there are places.  Rows without a place match nothing.
    """
    spark = left.sparkSession
    cols = [F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")]
    has_place = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = [materialise(df.select(*cols).where(has_place), "side") for df in (left, right)]
    places = [_places(df, side) for side, df in enumerate(rows)]
    members = materialise(_members(rows[0], places[0]).unionByName(_members(rows[1], places[1])), "members")
    many = places[0].unionByName(places[1]).where("left > 1").select(F.col("v").alias("_v"))
    crowds = materialise(members.join(many, "_v", "left_semi"), "crowds")
    alive: DataFrame = places[0].unionByName(places[1])
    lists: DataFrame | None = None
    done: list[DataFrame] = []
    for _ in range(rounds):
        alive, lists = _filled(alive, lists, max_km)
        if lists is None or lists.isEmpty():
            break
        settled = _settled(_choices(alive, lists))
        done.append(settled)
        alive = _remaining(alive, settled, crowds)
    else:
        alive, lists = _filled(alive, lists, max_km)
        if lists is not None and not lists.isEmpty():
            raise RuntimeError(f"greedy matching: {alive.count()} places are left after {rounds} rounds; raise rounds")
    if not done:
        return _nothing(spark, rows[0].schema["id"].dataType.simpleString())
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.unionByName(more)
    each = pairs.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("amount"))))
    each = each.select("l", "r", (F.col("l_used") + F.col("i")).alias("l_nth"), (F.col("r_used") + F.col("i")).alias("r_nth"))
    at = lambda side, name: places[side].select(F.col("v").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    who = lambda name, out: members.select(F.col("_v").alias(name), F.col("nth").alias(f"{name}_nth"), F.col("key").alias(out))
    each = each.join(who("l", "left_id"), ["l", "l_nth"]).join(who("r", "right_id"), ["r", "r_nth"])
    each = each.join(at(0, "l"), "l").join(at(1, "r"), "r")
    return each.select("left_id", "right_id", haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")).alias("km"))

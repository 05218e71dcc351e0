"""Entity resolution: name matching, merging and survivorship."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.geo import chord, haversine_km, unit_xyz
from almanac.functions.names import NAME_MATCH_SHARE, name_tokens, normal_name, token_share
from almanac.functions.values import blank_to_null
from almanac.operators.nearest import curve_key, nearest_places
from almanac.operators.ranks import order_bounds, row_number_within, slice_of
from almanac.session import join_counted, materialise

ANY_STATE = "*"
LIST, LONGEST = 16, 64  # units on the lists of a merge, at first and at most
TILE_UNITS, TILE_ROWS = 32_000, 250_000  # units of a tile, and rows that one task settles
OPEN_END = 2**62


# ---- name matching -------------------------------------------------------------


def _prefix_tokens(classes: DataFrame, share: float) -> DataFrame:
    """One row per class and blocking token.

    Two names that share enough words share one of the few rarest words of each, so a
    word that is in a third of all names is almost never a blocking key.
    """
    words = classes.select("cls", "tokens", F.explode("tokens").alias("token"))
    often = words.groupBy("token").agg(F.count("*").alias("often"))
    ranked = words.join(often, "token").groupBy("cls", "tokens").agg(
        F.array_sort(F.collect_list(F.struct("often", "token"))).alias("by_rarity")
    )
    n = F.size("tokens")
    keep = n - F.ceil(n * share - 1e-9).cast("int") + 1
    return ranked.select(
        "cls", "tokens", F.explode(F.slice("by_rarity", F.lit(1), keep)).alias("r")
    ).select("cls", "tokens", F.col("r.token").alias("token"))


def name_class_pairs(
    left: DataFrame, right: DataFrame, stop: Sequence[str] = (), share: float = NAME_MATCH_SHARE
) -> DataFrame:
    """Pairs (l_norm, r_norm, state) of distinct names that match within one state key.

    Both sides are distinct (norm, state) rows, so copies of a name are compared once.
    """

    def classes(df: DataFrame) -> DataFrame:
        return df.select("norm", "state").distinct().select(
            F.struct("norm", "state").alias("cls"), name_tokens(F.col("norm"), stop).alias("tokens")
        )

    lc, rc = classes(left), classes(right)
    # Token order must be the same on both sides: rank by frequency over both.
    both = lc.withColumn("side", F.lit(0)).unionByName(rc.withColumn("side", F.lit(1)))
    keyed = _prefix_tokens(both.select(F.struct("cls", "side").alias("cls"), "tokens"), share)
    side = lambda i, p: keyed.where(F.col("cls.side") == i).select(
        F.col("cls.cls.norm").alias(f"{p}_norm"), F.col("cls.cls.state").alias("state"), F.col("tokens").alias(f"{p}_tokens"), "token"
    )
    by_words = (
        side(0, "l").join(side(1, "r"), ["state", "token"])
        .where(token_share(F.col("l_tokens"), F.col("r_tokens")) >= share)
        .select("l_norm", "r_norm", "state")
    )
    equal = left.select(F.col("norm").alias("l_norm"), "state").distinct().join(
        right.select(F.col("norm").alias("l_norm"), "state").distinct(), ["l_norm", "state"]
    ).select("l_norm", F.col("l_norm").alias("r_norm"), "state")
    return by_words.unionByName(equal).distinct()


def first_match_fill(
    rows: DataFrame,
    reference: DataFrame,
    key: str,
    name: str,
    state: str,
    seq: str,
    payload: Sequence[str],
    stop: Sequence[str] = (),
    share: float = NAME_MATCH_SHARE,
) -> DataFrame:
    """For each row the first reference record (by ``seq``) with a fitting state and name.

    Reference records may serve many rows.  Only the first record of each distinct
    (name, state) can win, so copies collapse before any comparison; rows without a
    state look in a copy of the reference that is collapsed over all states.
    """
    state_key = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    asked = rows.select(
        key, normal_name(F.col(name)).alias("norm"),
        F.when(state_key(state) == "", ANY_STATE).otherwise(state_key(state)).alias("state"),
    )
    ref = reference.select(
        normal_name(F.col(name)).alias("norm"), state_key(state).alias("state"), F.struct(seq, *payload).alias("rec")
    )
    first = lambda df: df.groupBy("norm", "state").agg(F.min_by("rec", F.col(f"rec.{seq}")).alias("rec"))
    offered = first(ref.where(F.col("state") != "")).unionByName(first(ref.withColumn("state", F.lit(ANY_STATE))))
    pairs = name_class_pairs(asked, offered, stop, share)
    winners = (
        pairs.join(offered.withColumnRenamed("norm", "r_norm"), ["r_norm", "state"])
        .groupBy(F.col("l_norm").alias("norm"), "state")
        .agg(F.min_by("rec", F.col(f"rec.{seq}")).alias("rec"))
    )
    return join_counted(asked, winners, ["norm", "state"], "inner").select(key, "rec.*")


def fill_cascade(rows: DataFrame, key: str, field: str, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Fill a blank field from ranked sources; the first that has a value wins and is named.

    Each stage is (source name, frame of key and field).
    """
    out = rows.withColumn(field, blank_to_null(F.col(field)))
    source = F.when(F.col(field).isNotNull(), F.lit("own"))
    value = F.col(field)
    for i, (name, found) in enumerate(stages):
        out = out.join(found.select(key, F.col(field).alias(f"_s{i}")), key, "left")
        source = F.coalesce(source, F.when(F.col(f"_s{i}").isNotNull(), F.lit(name)))
        value = F.coalesce(value, F.col(f"_s{i}"))
    return out.withColumn(f"{field}_source", source).withColumn(field, value).drop(*[f"_s{i}" for i in range(len(stages))])


# ---- two-list merge ------------------------------------------------------------


def _name_edges(left: DataFrame, right: DataFrame, near_km: float, max_km: float, stop: Sequence[str]) -> DataFrame:
    """Edges (left id, place and class keys) admitted by the state and name rule beyond ``near_km``."""
    cls = lambda df: df.select("norm", "state", "lat", "lon").distinct()
    pairs = name_class_pairs(left, right, stop)
    reach = chord(max_km) * (1 + 1e-9) + 1e-9
    at = lambda: dict(zip(("cx", "cy", "cz"), unit_xyz(F.col("lat"), F.col("lon"))))
    cell = lambda c: F.floor(c / (2 * reach)).cast("bigint")  # noqa: E731  a place reaches into two cells each way at most
    l = cls(left).select(  # noqa: E741
        F.col("norm").alias("l_norm"), "state", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"),
        *[F.sequence(cell(c - reach), cell(c + reach)).alias(n) for n, c in at().items()],
    )
    for c in at():
        l = l.withColumn(c, F.explode(c))  # noqa: E741
    r = cls(right).select(
        F.col("norm").alias("r_norm"), "state", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
        *[cell(c).alias(n) for n, c in at().items()],
    )
    d = haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    return (
        l.join(pairs, ["l_norm", "state"])
        .join(r, ["r_norm", "state", *at()])
        .withColumn("km", d)
        .where((F.col("km") <= max_km) & (F.col("km") > near_km))
        .select("l_norm", "state", "l_lat", "l_lon", "r_norm", "r_lat", "r_lon", "km")
    )


def merge_two_lists(
    left: DataFrame,
    right: DataFrame,
    key: str = "id",
    seq: str = "seq",
    name: str = "name",
    state: str = "state",
    lat: str = "lat",
    lon: str = "lon",
    near_km: float = 0.2,
    max_km: float = 1.0,
    stop: Sequence[str] = (),
) -> DataFrame:
    """Match two lists as a loop over the left list would: each left row, in ``seq`` order, takes
    the nearest unused right row that is within ``near_km``, or within ``max_km`` with the same
    state and a matching name.  Returns (left_id, right_id, km).

    The loop is a stable matching in which every right row prefers the smallest ``seq``.  It is
    found by proposals: rows propose to the units of their lists in turn, a unit keeps its
    smallest proposers, the rest go on; a row at the end of its list asks for the next units that
    would still take it.  A unit is a run of right rows of one place,
    in ``seq`` order, that act alike: those no name rule reaches, or those of one name and
    state.  So a crowded place or a group of copies is one target with room for many.  Equal
    distances are taken in right ``seq`` order.
    """
    norm_state = F.upper(F.coalesce(F.col(state), F.lit("")))
    has_place = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    cols = [
        F.col(key).alias("id"), F.col(seq).cast("bigint").alias("seq"), normal_name(F.col(name)).alias("norm"),
        norm_state.alias("state"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
    ]
    left, right = (materialise(d.select(*cols).where(has_place), "list") for d in (left, right))
    spots = ["lat", "lon", "norm", "state"]
    edges = _name_edges(left, right, near_km, max_km, stop).select(
        F.col("l_norm").alias("norm"), "state", F.col("l_lat").alias("lat"), F.col("l_lon").alias("lon"),
        "r_norm", "r_lat", "r_lon", "km",
    )
    edges = materialise(edges, "edges")
    reached = edges.select(F.col("r_norm").alias("norm"), "state", F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))
    reached = reached.distinct().withColumn("label", F.concat_ws("|", "norm", "state"))
    bounds = order_bounds(right, "seq")
    labelled = right.join(reached, spots, "left").na.fill({"label": ""}).withColumn("_slice", slice_of(F.col("seq"), bounds))
    along = Window.partitionBy("lat", "lon", "_slice").orderBy("seq")
    starts = F.lag("label").over(along).isNull() | (F.lag("label").over(along) != F.col("label"))
    run = F.max(F.when(F.col("_starts"), F.col("seq"))).over(along)
    labelled = labelled.withColumn("_starts", starts).withColumn("unit", run).drop("_starts")
    labelled = materialise(labelled, "units")
    units = labelled.groupBy("unit", "lat", "lon").agg(F.count("*").alias("room"))
    edges = edges.join(
        labelled.where("label <> ''").select(F.col("norm").alias("r_norm"), "state", F.col("lat").alias("r_lat"),
                                             F.col("lon").alias("r_lon"), "unit").distinct(),
        ["r_norm", "state", "r_lat", "r_lon"],
    ).select("norm", "state", "lat", "lon", "unit", "km")
    edges, units = materialise(edges, "edges"), materialise(units, "rooms")
    places = _tiled(units).withColumn("bar", F.lit(OPEN_END).cast("bigint"))
    length, asking, state = LIST, left, None
    while True:
        lists = _lists(asking, places, edges, near_km, length)
        state = _settled(lists if state is None else state.where("unit IS NOT NULL").unionByName(lists))
        # Rows that came to the end of a list that may go on ask again; those at the end of a whole one stay unmatched.
        dry = state.where("unit IS NULL AND NOT complete").select("seq")
        asking = materialise(left.join(dry, "seq", "left_semi").select(left.columns), "asking")
        if asking.isEmpty():
            break
        # A unit's bar is the largest seq it holds once full: it takes only smaller ones.
        full = _held(state).groupBy("unit").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
        bar = F.when(F.col("n") >= F.col("room"), F.col("last")).otherwise(OPEN_END).alias("bar")
        places = materialise(places.drop("bar").join(full, "unit", "left").select(*places.drop("bar").columns, bar), "rooms")
        length = min(4 * length, LONGEST)
    members = row_number_within(labelled, ["unit"], "seq", bounds=bounds).select("unit", "nth", F.col("id").alias("right_id"))
    winners = row_number_within(_held(state), ["unit"], "seq")
    at = units.select("unit", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return (
        winners.join(members, ["unit", "nth"])
        .join(left.select("seq", F.col("id").alias("left_id"), "lat", "lon"), "seq")
        .join(at, "unit")
        .select("left_id", "right_id", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("km"))
    )


def _tiled(units: DataFrame) -> DataFrame:
    """Units with their tile in two layouts: stretches of two space-filling curves, one shifted by a third of the other's box.

    Thus a border of one layout lies inside a tile of the other, whatever the size of its cells.
    """
    xyz = unit_xyz(F.col("lat"), F.col("lon"))
    keyed = materialise(units.withColumns({f"_key{i}": curve_key(xyz, lo, lo + 4.0) for i, lo in enumerate((-1.0, -1.0 - 4 / 3))}), "keys")
    tiles = {f"tile{i}": slice_of(F.col(f"_key{i}"), order_bounds(keyed, f"_key{i}", TILE_UNITS)) for i in (0, 1)}
    return materialise(keyed.withColumns(tiles).drop("_key0", "_key1"), "rooms")


def _lists(asking: DataFrame, places: DataFrame, edges: DataFrame, near_km: float, length: int) -> DataFrame:
    """Of every asking row the next units whose bar is above its seq, best first, with their rooms and tiles.

    ``complete`` says that there are no others.  Units of the name rule come behind all near ones, so they are looked
    up for rows whose near ones are all listed.
    """
    x, y, z = unit_xyz(F.col("lat"), F.col("lon"))
    xyz = [x.alias("x"), y.alias("y"), z.alias("z")]
    q = asking.select(F.col("seq").alias("id"), *xyz, F.col("seq").alias("attr"))
    t = places.select(F.col("unit").alias("id"), *xyz, F.col("bar").alias("attr"))
    near = nearest_places(q, t, length, near_km, rule="above").select(F.col("id").alias("seq"), F.col("other").alias("unit"), "rank")
    near = materialise(near, "near")
    whole = near.groupBy("seq").count().where(F.col("count") >= length)
    by_km = Window.partitionBy("seq").orderBy("km", "unit")
    named = (
        asking.join(whole, "seq", "left_anti")
        .join(edges, ["norm", "state", "lat", "lon"])
        .join(places.select("unit", "bar"), "unit")
        .where(F.col("bar") > F.col("seq"))
        .withColumn("rank", F.row_number().over(by_km))
        .where(F.col("rank") <= length)
    )
    both = near.select("seq", "unit", "rank", F.lit(0).alias("tier")).unionByName(named.select("seq", "unit", "rank", F.lit(1).alias("tier")))
    ends = F.max(F.when(F.col("rank") >= length, True).otherwise(False))  # a list that is full may go on
    entry = F.struct("tier", "rank", "unit", "room", "tile0", "tile1")
    listed = both.join(places.select("unit", "room", "tile0", "tile1"), "unit").groupBy("seq").agg(
        F.array_sort(F.collect_list(entry)).alias("_l"), (~ends).alias("complete")
    )  # at most two lengths
    listed = listed.select(
        "seq", *[F.col(f"_l.{c}").alias(f"{c}s") for c in ("unit", "room", "tile0", "tile1")], "complete", F.lit(0).alias("pos"),
        F.lit(True).alias("moved"),
    )
    return materialise(listed.withColumn("unit", F.get("units", F.col("pos"))), "lists")


def _held(state: DataFrame) -> DataFrame:
    """seq and unit of the rows that a unit holds."""
    return state.where("unit IS NOT NULL").select("seq", "unit")


def _settled(state: DataFrame) -> DataFrame:
    """The rows at their places in their lists (``pos``) once no unit refuses any more; ``unit`` is null at the end of a list.

    The outcome of proposals does not depend on their order, so a task follows those inside its tile to their end;
    rows refused there whose next unit is in another tile go on in the next round, which has the other layout of tiles.
    In a tile with more than ``TILE_ROWS`` rows every unit ranks its rows by itself, one proposal a round.
    """
    columns = state.columns
    layout = 0
    while True:
        tiles = f"tile{layout}s"
        laid = state.withColumn("_tile", F.get(tiles, F.col("pos")))
        load = laid.where("unit IS NOT NULL").groupBy("_tile").agg(F.count("*").alias("_n"), F.max("moved").alias("_new"))
        load = materialise(load.where("_new").select("_tile", (F.col("_n") > TILE_ROWS).alias("_crowded")), "load")
        crowded = load.agg(F.max("_crowded")).first()[0]
        if crowded is None:
            return state
        marked = laid.join(F.broadcast(load), "_tile", "left")  # a row per tile
        still = marked.where(F.col("_crowded").isNull()).select(columns).withColumn("moved", F.lit(False))
        calm = marked.where(~F.col("_crowded")).select("_tile", *columns)
        moving = calm.groupBy("_tile").applyInArrow(_settle_tile(tiles, columns), state.schema)
        if crowded:
            rows = materialise(marked.where("_crowded").select(columns), "crowded")
            out = F.col("nth") > F.get("rooms", F.col("pos"))
            ranked = row_number_within(rows, ["unit"], "seq").withColumn("moved", out)
            moving = moving.unionByName(ranked.withColumn("pos", F.col("pos") + out.cast("int")).select(columns))
        state = materialise(still.unionByName(moving.withColumn("unit", F.get("units", F.col("pos")))), "state")
        layout = 1 - layout


def _settle_tile(tile_lists: str, columns: Sequence[str]):
    """Proposals to the units of one tile: a unit holds its smallest seqs, a refused row goes on in its list."""

    def settle(rows: pa.Table) -> pa.Table:
        here = rows.column("_tile")[0].as_py()
        units, rooms, tiles = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("units", "rooms", tile_lists))
        ends = np.cumsum(rows.column("units").combine_chunks().value_lengths().to_numpy())
        seq, pos = rows.column("seq").to_pylist(), rows.column("pos").to_numpy()
        first = np.concatenate([[0], ends[:-1]])
        at, end = (first + pos).tolist(), ends.tolist()
        moved = [False] * len(seq)
        held: dict[int, list[tuple[int, int]]] = {}
        asking = list(range(len(seq)))
        while asking:
            i = asking.pop()
            unit = held.setdefault(int(units[at[i]]), [])
            heapq.heappush(unit, (-seq[i], i))
            if len(unit) > rooms[at[i]]:
                i = heapq.heappop(unit)[1]
                at[i] += 1
                if at[i] < end[i]:
                    if tiles[at[i]] == here:
                        asking.append(i)
                    else:
                        moved[i] = True
        made = {"pos": pa.array(np.asarray(at) - first, pa.int32()), "moved": pa.array(moved, pa.bool_())}
        return pa.table({c: made.get(c, rows.column(c)) for c in columns})

    return settle


def survivorship(
    left: DataFrame,
    right: DataFrame,
    on: Column,
    fields: Mapping[str, str],
    labels: tuple[str, str, str] = ("both", "left", "right"),
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Full outer merge of two lists aliased ``l`` and ``r``.

    ``fields`` maps each output field to ``left`` or ``right``: the side whose value
    is preferred; the other side fills in blanks.  ``source`` says where a row is from.  ``extra`` are further columns
    over ``l`` and ``r`` (``_l`` and ``_r`` are true where a side has a row), put in front.
    """
    l, r = left.withColumn("_l", F.lit(True)).alias("l"), right.withColumn("_r", F.lit(True)).alias("r")  # noqa: E741
    joined = l.join(r, on, "full_outer")
    picked = []
    for f, side in fields.items():
        sides = [s for s in (("l", "r") if side == "left" else ("r", "l")) if f in (left if s == "l" else right).columns]
        picked.append(F.coalesce(*[blank_to_null(F.col(f"{s}.{f}").cast("string")) for s in sides], F.lit("")).alias(f))
    both, only_l, only_r = labels
    source = F.when(F.col("_l") & F.col("_r"), both).when(F.col("_l"), only_l).otherwise(only_r)
    return joined.select(*[c.alias(n) for n, c in (extra or {}).items()], *picked, source.alias("source"))


def merged_list(
    left: DataFrame,
    right: DataFrame,
    pairs: DataFrame,
    key: str,
    fields: Mapping[str, str],
    labels: tuple[str, str, str] = ("both", "left", "right"),
    chosen: Mapping[str, tuple[Column, Column, Column]] | None = None,
) -> DataFrame:
    """One list of two, by the pairs (left_id, right_id, km) that were matched: every row of either side comes once.

    Columns are ``left_id``, ``right_id`` and ``km`` (null where there is no partner), ``fields`` and ``source`` as
    ``survivorship`` has them, and ``chosen``: values by a rule of their own for rows of both sides, of the left only, of the
    right only, over the sides as ``l`` and ``r``.
    """
    one = pairs.select(F.col("left_id").alias("_pair"), F.col("right_id").alias("_right"), "km")
    l = left.join(one, left[key] == one["_pair"], "left").withColumn("left_id", left[key]).drop("_pair")  # noqa: E741
    r = right.withColumn("right_id", right[key])
    rules = {name: F.when(F.col("_l") & F.col("_r"), both).when(F.col("_l"), only_l).otherwise(only_r) for name, (both, only_l, only_r) in (chosen or {}).items()}
    extra = {"left_id": F.col("l.left_id"), "right_id": F.col("r.right_id"), "km": F.col("l.km"), **rules}
    return survivorship(l, r, F.col("l._right") == F.col("r.right_id"), fields, labels, extra)


def consolidate(rows: DataFrame, key: str, seq: str, fields: Sequence[str]) -> DataFrame:
    """First non-blank value of each field per key in ``seq`` order; combines map-side."""
    first = [
        F.min_by(F.col(f), F.when(blank_to_null(F.col(f).cast("string")).isNotNull(), F.col(seq))).alias(f) for f in fields
    ]
    return rows.groupBy(key).agg(*first)

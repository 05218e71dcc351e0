"""Queries for joins, matching and geography (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import urls
from almanac.functions.values import blank_to_null
from almanac.operators import chains, greedy, matching, nearest, regions, search, upsert
from almanac.functions.geo import grid_points
from almanac.plans import tables as t
from almanac.plans.registry import query
from almanac.plans.scalar_plans import CANON_SQL, HAV_SQL
from almanac.plans.tables import table, with_views
from almanac.session import materialise
from almanac.presets import DENSE_BOXES, FILL_STOP_WORDS, MERGE_STOP_WORDS
from almanac.plans.text_plans import CENTROID_SQL, phrases


@query(
    "j01_label_chain",
    """SELECT l_orderkey, l_linenumber, l_partkey, n_name AS entity, c_mktsegment AS site, o_orderpriority AS page
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey""",
)
def j01(spark, sf):
    frames = {
        "labels": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("span_id"), "l_linenumber", "l_partkey"),
        "spans": table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("span_id"), F.col("o_custkey").alias("page_id"), F.col("o_orderpriority").alias("page")
        ),
        "pages": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("site_id"), F.col("c_mktsegment").alias("site")
        ),
        "sites": table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("site_id"), F.col("n_regionkey").alias("entity_id"), F.col("n_name").alias("entity")
        ),
        "entities": table(spark, sf, "region").select(F.col("r_regionkey").alias("entity_id")),
    }
    out = chains.label_chain(frames, "spans")
    return out.select(F.col("span_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "entity", "site", "page")


@query(
    "j02_framing_chain",
    """SELECT event_id AS label_id, doc_id AS page_id, event_type AS framing, lang FROM events JOIN documents ON doc_id = user_id
    WHERE event_type IN ('click', 'purchase') AND value >= 10 AND event_id % 5 <> 0""",
)
def j02(spark, sf):
    e = table(spark, sf, "events")
    frames = {
        "labels": e.select(
            F.col("event_id").alias("label_id"), F.col("user_id").alias("page_id"),
            F.when(F.col("value") < 10, "N/A").otherwise("x").alias("category"),
            F.when(F.col("event_id") % 5 == 0, "late").alias("error"),
        ),
        "framings": e.select(F.col("event_id").alias("label_id"), F.col("event_type").alias("framing")),
        "pages": table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang"),
    }
    return chains.framing_chain(frames, "pages", ["click", "purchase"]).select("label_id", "page_id", "framing", "lang")


@query(
    "j03_left_counts",
    """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    AND o_orderstatus = 'F' GROUP BY c_custkey""",
)
def j03(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return chains.left_counts(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@query(
    "j04_semi_join",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
    AND o_orderpriority = '1-URGENT')""",
)
def j04(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@query(
    "j05_anti_join",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
    WHERE o_orderpriority = '1-URGENT')""",
)
def j05(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_anti")


@query(
    "j06_greedy_nearest_pairs",
    with_views(
        "geo",
        f"""+ e AS MATERIALIZED (SELECT a.id AS l, b.id AS r, {HAV_SQL.format('a.lat', 'b.lat', 'a.lon', 'b.lon')} AS km
            FROM geo a JOIN geo b ON a.id % 2 = 0 AND b.id % 2 = 1 WHERE km <= 25),
        g AS (SELECT 0 AS n, {{'km': NULL::DOUBLE, 'l': -1::BIGINT, 'r': -1::BIGINT}} AS b, [-1::BIGINT] AS ls, [-1::BIGINT] AS rs
            UNION ALL SELECT n + 1, b, list_append(ls, b.l), list_append(rs, b.r) FROM (
                SELECT any_value(n) AS n, any_value(ls) AS ls, any_value(rs) AS rs, min({{'km': e.km, 'l': e.l, 'r': e.r}}) AS b
                FROM g, e WHERE NOT list_contains(ls, e.l) AND NOT list_contains(rs, e.r)) WHERE b IS NOT NULL)
        SELECT b.l AS left_id, b.r AS right_id, round(b.km, 6) AS km FROM g WHERE n > 0""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def j06(spark, sf):
    g = t.geo(spark, sf)
    return greedy.greedy_nearest_pairs(g.where("id % 2 = 0"), g.where("id % 2 = 1"), max_km=25.0).withColumn(
        "km", F.round("km", 6)
    )


@query(
    "j06_first_round_pairs",
    with_views(
        "geo",
        f"""+ p AS (SELECT a.id AS l, b.id AS r, {HAV_SQL.format('a.lat', 'b.lat', 'a.lon', 'b.lon')} AS km
            FROM geo a JOIN geo b ON a.id % 2 = 0 AND b.id % 2 = 1)
        SELECT l AS left_id, r AS right_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY km, r) AS x,
        row_number() OVER (PARTITION BY r ORDER BY km, l) AS y FROM p) WHERE x = 1 AND y = 1""",
    ),
)
def j06_round(spark, sf):
    g = t.geo(spark, sf)
    left, right = g.where("id % 2 = 0"), g.where("id % 2 = 1")
    a = nearest.knn_join(left, right, "id", "lat", "lon", 1).select(F.col("id").alias("left_id"), F.col("neighbour").alias("right_id"), "km")
    b = nearest.knn_join(right, left, "id", "lat", "lon", 1).select(F.col("id").alias("right_id"), F.col("neighbour").alias("left_id"))
    return a.join(b, ["left_id", "right_id"]).withColumn("km", F.round("km", 6)).select("left_id", "right_id", "km")


def fill_rows(spark, sf):
    p = table(spark, sf, "part")
    rows = p.where("p_size <= 25").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("name"),
        F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")).alias("state"),
    )
    ref = p.where("p_size > 25").select(
        F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", "p_type").alias("name"),
        F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.lower("p_brand")).alias("state"),
        F.col("p_retailprice").cast("string").alias("site"),
        "p_size",
    )
    return rows, ref


FILL_SQL = """rows_ AS (SELECT p_partkey AS id, string_split(lower(concat(p_type, ' ', p_name)), ' ') AS t,
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS st FROM part WHERE p_size <= 25),
    ref AS (SELECT p_partkey AS seq, string_split(lower(concat(p_name, ' ', p_type)), ' ') AS t,
        CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS st, p_size FROM part WHERE p_size > 25),
    cand AS (SELECT id, seq, p_size FROM rows_ a JOIN ref b ON (a.st = '' OR a.st = b.st)
        AND len(list_intersect(a.t, b.t)) / CAST(greatest(len(list_distinct(a.t)), len(list_distinct(b.t))) AS DOUBLE) >= 0.65)"""


@query("j07_first_match_fill", f"WITH {FILL_SQL} SELECT id, min(seq) AS seq FROM cand GROUP BY id")
def j07(spark, sf):
    rows, ref = fill_rows(spark, sf)
    return matching.first_match_fill(rows, ref, "id", "name", "state", "seq", ["site"], FILL_STOP_WORDS).select("id", "seq")


@query(
    "j08_fill_cascade",
    f"""WITH {FILL_SQL}, a AS (SELECT id, min(seq) AS seq FROM cand WHERE p_size <= 30 GROUP BY id),
    b AS (SELECT id, min(seq) AS seq FROM cand WHERE p_size > 30 GROUP BY id)
    SELECT id, CASE WHEN id % 5 = 0 THEN 'own' WHEN a.seq IS NOT NULL THEN 'list' WHEN b.seq IS NOT NULL THEN 'directory' END
    AS seq_source, CASE WHEN id % 5 = 0 THEN '0' ELSE CAST(coalesce(a.seq, b.seq) AS VARCHAR) END AS seq
    FROM rows_ LEFT JOIN a USING (id) LEFT JOIN b USING (id)""",
)
def j08(spark, sf):
    rows, ref = fill_rows(spark, sf)
    found = lambda r: matching.first_match_fill(rows, r, "id", "name", "state", "seq", [], FILL_STOP_WORDS).select(
        "id", F.col("seq").cast("string").alias("seq")
    )
    base = rows.select("id", F.when(F.col("id") % 5 == 0, "0").otherwise(" ").alias("seq"))
    stages = [("list", found(ref.where("p_size <= 30"))), ("directory", found(ref.where("p_size > 30")))]
    return matching.fill_cascade(base, "id", "seq", stages).select("id", "seq", "seq_source")


def two_lists(spark, sf):
    g = t.geo(spark, sf).join(table(spark, sf, "part"), F.col("id") == F.col("p_partkey"))
    g = g.select("id", F.col("id").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("state"), "lat", "lon")
    return g.where("id % 2 = 0"), g.where("id % 2 = 1")


MERGE_SQL = f"""+ side AS (SELECT id, lat, lon, p_name AS name, p_type AS state, p_brand AS brand, p_retailprice AS price,
        list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda w: w NOT IN {MERGE_STOP_WORDS}) AS ws
        FROM geo JOIN part ON id = p_partkey),
    near AS (SELECT a.id AS l, b.id AS r, {HAV_SQL.format('a.lat', 'b.lat', 'a.lon', 'b.lon')} AS km, upper(a.state) = upper(b.state)
        AND len(list_intersect(a.ws, b.ws)) / CAST(greatest(len(a.ws), len(b.ws)) AS DOUBLE) >= 0.65 AS named
        FROM side a JOIN side b ON a.id % 2 = 0 AND b.id % 2 = 1),
    e AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY l) AS turn, * FROM near WHERE km <= 15 OR (km <= 60 AND named)),
    g AS (SELECT 0::BIGINT AS turn, {{'km': NULL::DOUBLE, 'r': -1::BIGINT, 'l': -1::BIGINT}} AS b, [-1::BIGINT] AS used
        UNION ALL SELECT turn + 1, b, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.r) END FROM (
            SELECT any_value(g.turn) AS turn, any_value(g.used) AS used,
            min({{'km': e.km, 'r': e.r, 'l': e.l}}) FILTER (NOT list_contains(g.used, e.r)) AS b
            FROM g LEFT JOIN e ON e.turn = g.turn + 1) WHERE turn < (SELECT max(turn) FROM e)),
    pairs AS (SELECT b.l AS left_id, b.r AS right_id, b.km AS km FROM g WHERE turn > 0 AND b IS NOT NULL)"""


def merged_sql(body: str) -> str:
    return with_views("geo", f"{MERGE_SQL} {body}").replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "j09_merge_two_lists",
    merged_sql(
        """SELECT id AS left_id, right_id, round(km, 6) AS km FROM side LEFT JOIN pairs ON left_id = id WHERE id % 2 = 0
        UNION ALL SELECT NULL, id, NULL FROM side WHERE id % 2 = 1 AND id NOT IN (SELECT right_id FROM pairs)"""
    ),
)
def j09(spark, sf):
    left, right = two_lists(spark, sf)
    pairs = matching.merge_two_lists(left, right, near_km=15.0, max_km=60.0, stop=MERGE_STOP_WORDS).withColumn("km", F.round("km", 6))
    merged = left.select(F.col("id").alias("left_id")).join(pairs, "left_id", "left")
    only_right = right.select(F.col("id").alias("right_id")).join(pairs, "right_id", "left_anti")
    return merged.unionByName(only_right, allowMissingColumns=True)


@query(
    "j09_merged_list",
    merged_sql(
        """, l AS (SELECT *, CASE WHEN id % 3 = 0 THEN ' ' ELSE 'l' || id END AS site FROM side WHERE id % 2 = 0),
        r AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE 'r' || id END AS site FROM side WHERE id % 2 = 1)
        SELECT l.id AS left_id, r.id AS right_id, round(km, 6) AS km, coalesce(l.name, r.name) AS name, coalesce(l.state, r.state) AS state,
        coalesce(nullif(trim(r.site), ''), nullif(trim(l.site), ''), '') AS site, coalesce(r.brand, '') AS brand,
        CASE WHEN l.id IS NULL THEN CASE WHEN r.site IS NULL THEN '' ELSE 'right' END WHEN r.id IS NULL THEN 'own'
            WHEN trim(r.site) <> '' THEN 'right' ELSE 'own' END AS site_source,
        CASE WHEN r.id IS NULL THEN 'left' WHEN l.id IS NULL THEN 'right' ELSE 'both' END AS source
        FROM l LEFT JOIN pairs ON left_id = l.id FULL JOIN r ON r.id = right_id"""
    ),
)
def j09_list(spark, sf):
    """Match, survivorship and source of two lists in one table."""
    left, right = two_lists(spark, sf)
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    pairs = matching.merge_two_lists(left, right, near_km=15.0, max_km=60.0, stop=MERGE_STOP_WORDS)
    left = left.withColumn("site", F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit("l"), F.col("id").cast("string"))))
    right = right.withColumn("site", F.when(F.col("id") % 5 != 0, F.concat(F.lit("r"), F.col("id").cast("string")))).join(brands, "id")
    has = blank_to_null(F.col("r.site")).isNotNull()
    rule = (F.when(has, "right").otherwise("own"), F.lit("own"), F.when(has, "right").otherwise(""))
    fields = {"name": "left", "state": "left", "site": "right", "brand": "right"}
    out = matching.merged_list(left, right, pairs, "id", fields, chosen={"site_source": rule})
    return out.withColumn("km", F.round("km", 6))


@query(
    "j09_eligible_nearest",
    with_views(
        "geo",
        f"""+ p AS (SELECT a.id AS left_id, b.id AS right_id, {HAV_SQL.format('a.lat', 'b.lat', 'a.lon', 'b.lon')} AS km
            FROM geo a JOIN geo b ON a.id % 2 = 0 AND b.id % 2 = 1)
        SELECT left_id, arg_min(right_id, km) AS right_id, round(min(km), 6) AS km FROM p WHERE km <= 40 GROUP BY left_id""",
    ),
)
def j09_edges(spark, sf):
    g = t.geo(spark, sf)
    best = nearest.knn_join(g.where("id % 2 = 0"), g.where("id % 2 = 1"), "id", "lat", "lon", 1, max_km=40.0)
    return best.select(F.col("id").alias("left_id"), F.col("neighbour").alias("right_id"), F.round("km", 6).alias("km"))


@query(
    "j10_survivorship",
    """SELECT CAST(coalesce(c_custkey, s_suppkey) AS VARCHAR) AS id, coalesce(c_name, s_name) AS name,
    coalesce(CASE WHEN s_acctbal < 1000 THEN NULL ELSE s_name END, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END, '') AS website,
    coalesce(c_mktsegment, '') AS segment, CASE WHEN c_custkey IS NULL THEN 'right' WHEN s_suppkey IS NULL THEN 'left'
    ELSE 'both' END AS source FROM customer FULL JOIN supplier ON s_suppkey = c_custkey + 50""",
)
def j10(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name")).alias("website"),
    )
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 1000, "").otherwise(F.col("s_name")).alias("website"),
    )
    fields = {"id": "left", "name": "left", "website": "right", "segment": "left"}
    return matching.survivorship(c, s, F.col("r.id") == F.col("l.id") + 50, fields)


@query(
    "j11_consolidate",
    """SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS kind,
    arg_min(CAST(value AS VARCHAR), event_id) FILTER (value > 20) AS amount FROM events GROUP BY user_id""",
)
def j11(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("kind"),
        F.when(F.col("value") > 20, F.col("value").cast("string")).alias("amount"),
    )
    return matching.consolidate(e, "user_id", "event_id", ["kind", "amount"])


def boxes(spark, sf):
    """Square regions over the cells that hold odd points, with a square hole in every third one."""
    g = t.geo(spark, sf).where("id % 2 = 1")
    cells = g.select(F.floor(F.col("lon") / 2).alias("i"), F.floor(F.col("lat") / 2).alias("j")).distinct()
    x, y = F.col("i") * 2.0 - 0.5, F.col("j") * 2.0 - 0.5

    def square(x0, y0, side):
        pts = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.array(*[F.struct((x0 + a * side).alias("x"), (y0 + b * side).alias("y")) for a, b in pts])

    hole = F.when(F.col("i") % 3 == 0, F.array(square(x, y, 2.7), square(x + 0.5, y + 0.5, 1.0)))
    out = cells.select((F.col("i") * 1000 + F.col("j")).alias("region"), F.coalesce(hole, F.array(square(x, y, 2.7))).alias("rings"))
    return regions.boundary_table(out, None, "region", "rings")


BOXES_SQL = """box AS (SELECT DISTINCT CAST(floor(lon / 2) AS BIGINT) AS i, CAST(floor(lat / 2) AS BIGINT) AS j FROM geo WHERE id % 2 = 1)"""


@query(
    "j12_point_in_region",
    with_views(
        "geo",
        f"""+ {BOXES_SQL} SELECT id, min(i * 1000 + j) AS region FROM geo JOIN box ON lon > i * 2 - 0.5 AND lon < i * 2 + 2.2
        AND lat > j * 2 - 0.5 AND lat < j * 2 + 2.2 AND NOT (i % 3 = 0 AND lon > i * 2 AND lon < i * 2 + 1 AND lat > j * 2
        AND lat < j * 2 + 1) GROUP BY id""",
    ),
)
def j12(spark, sf):
    return regions.point_in_region(t.geo(spark, sf), boxes(spark, sf), "id", "region")


@query(
    "j13_nearest_feature",
    with_views(
        "geo",
        f"""+ p AS (SELECT a.id, b.label, min({HAV_SQL.format('a.lat', 'b.lat', 'a.lon', 'b.lon')}) AS km
            FROM geo a JOIN geo b ON a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY ALL)
        SELECT id, round(min(km) FILTER (label = 0), 6) AS dist_0, round(min(km) FILTER (label = 1), 6) AS dist_1,
        CAST('Infinity' AS DOUBLE) AS dist_99 FROM p GROUP BY id""",
    ),
)
def j13(spark, sf):
    g = t.geo(spark, sf)
    out = regions.nearest_feature_km(g.where("id % 2 = 0"), g.where("id % 2 = 1"), [0, 1, 99], "label")
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("dist_0", "dist_1", "dist_99")])


def _polygon_sql() -> str:
    """Every point with every 0.1 degree piece of the squares: the nearest by its chord on the sphere, then its distance in place."""
    xyz = lambda lat, lon, to: f"cos(radians({lat})) * cos(radians({lon})) AS x{to}, cos(radians({lat})) * sin(radians({lon})) AS y{to}, sin(radians({lat})) AS z{to}"
    dot = lambda a, b: " + ".join(f"({a.format(c)}) * ({b.format(c)})" for c in "xyz")
    way, to = "{0}2 - {0}1", "{0} - {0}1"
    gap = "{0} - {0}1 - t * ({0}2 - {0}1)"
    return f"""+ {BOXES_SQL}, sq AS (SELECT i, i * 2.0::DOUBLE - 0.5::DOUBLE AS x0, j * 2.0::DOUBLE - 0.5::DOUBLE AS y0, 2.7::DOUBLE AS side FROM box
            UNION ALL SELECT i, i * 2.0::DOUBLE - 0.5::DOUBLE + 0.5::DOUBLE, j * 2.0::DOUBLE - 0.5::DOUBLE + 0.5::DOUBLE, 1.0::DOUBLE FROM box WHERE i % 3 = 0),
        edge AS (SELECT x0 + a * side AS lon1, y0 + b * side AS lat1, x0 + c * side AS lon2, y0 + d * side AS lat2
            FROM sq, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) v(a, b, c, d)),
        n AS (SELECT *, CAST(greatest(ceil(greatest(abs(lat2 - lat1), abs(lon2 - lon1)) / 0.1::DOUBLE), 1) AS BIGINT) AS n FROM edge),
        piece AS (SELECT DISTINCT lat1 + (lat2 - lat1) * k / n AS lat1, lon1 + (lon2 - lon1) * k / n AS lon1,
            lat1 + (lat2 - lat1) * (k + 1) / n AS lat2, lon1 + (lon2 - lon1) * (k + 1) / n AS lon2 FROM n, range(28) r(k) WHERE k < n),
        p3 AS MATERIALIZED (SELECT *, {xyz('lat1', 'lon1', '1')}, {xyz('lat2', 'lon2', '2')} FROM piece),
        q3 AS (SELECT id, lat, lon, {xyz('lat', 'lon', '')} FROM geo),
        held AS (SELECT DISTINCT id FROM geo JOIN box ON lon > i * 2 - 0.5 AND lon < i * 2 + 2.2 AND lat > j * 2 - 0.5 AND lat < j * 2 + 2.2
            AND NOT (i % 3 = 0 AND lon > i * 2 AND lon < i * 2 + 1 AND lat > j * 2 AND lat < j * 2 + 1)),
        d AS (SELECT id, lat, lon, lat1, lon1, lat2, lon2, {dot(gap, gap)} AS d2 FROM (SELECT *, greatest(0, least(1,
            coalesce(({dot(to, way)}) / nullif({dot(way, way)}, 0), 0))) AS t FROM q3, p3 WHERE id NOT IN (FROM held))),
        best AS (SELECT id, any_value(lat) AS lat, any_value(lon) AS lon, arg_min({{'a': lat1, 'b': lon1, 'c': lat2, 'd': lon2}}, d2) AS e FROM d GROUP BY id),
        s AS (SELECT *, cos(radians(lat)) AS w FROM best),
        u AS (SELECT *, greatest(0, least(1, -((e.b - lon) * w * (e.d - e.b) * w + (e.a - lat) * (e.c - e.a))
            / (pow((e.d - e.b) * w, 2) + pow(e.c - e.a, 2)))) AS t FROM s),
        f AS (SELECT id, lat, lon, e.a + (e.c - e.a) * t AS flat, e.b + (e.d - e.b) * t AS flon FROM u)
        SELECT id, round({HAV_SQL.format('lat', 'flat', 'lon', 'flon')}, 6) AS dist_0 FROM f UNION ALL SELECT id, 0.0::DOUBLE FROM held"""


@query("j13_nearest_polygon", with_views("geo", _polygon_sql()))
def j13_polygon(spark, sf):
    g = t.geo(spark, sf)
    shapes = boxes(spark, sf).withColumn("label", F.lit(0))
    out = regions.nearest_feature_km(g, g.where("false"), [0], "label", polygons=shapes)
    return out.select("id", F.round("dist_0", 6).alias("dist_0"))


KNN_SQL = f"""pair AS (SELECT a.id, b.id AS neighbour, {HAV_SQL.format('a.lat', 'b.lat', 'a.lon', 'b.lon')} AS km
        FROM geo a JOIN geo b ON a.id <> b.id),
    knn AS (SELECT id, neighbour, km, row_number() OVER (PARTITION BY id ORDER BY km, neighbour) AS rank FROM pair
        QUALIFY rank <= 8)"""


@query(
    "j14_knn_graph",
    with_views("geo", f"""+ {KNN_SQL} SELECT id, neighbour, CAST(rank AS INTEGER) AS rank, round(km, 6) AS km, 0.125::DOUBLE AS weight FROM knn"""),
)
def j14(spark, sf):
    g = t.geo(spark, sf)
    k = 8
    edges = nearest.knn_join(g, g, "id", "lat", "lon", k, exclude_self=True)
    return edges.select("id", "neighbour", "rank", F.round("km", 6).alias("km"), F.lit(1.0 / k).alias("weight"))


DENSE = (*DENSE_BOXES, (36.0, 37.2, -97.0, -94.9))
BOX_SQL = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {i})" for i, (a, b, c, d) in enumerate(DENSE, 1))


@query(
    "j15_assign_to_grid",
    with_views(
        "geo",
        f"""+ box AS (SELECT * FROM (VALUES {BOX_SQL}) v(a, b, c, d, r)),
        pts AS (SELECT 24.0::DOUBLE + i AS lat, -125.0::DOUBLE + j AS lon, 0 AS r FROM range(26) x(i), range(60) y(j)
            UNION ALL SELECT round(a + i * 0.5, 6), round(c + j * 0.5, 6), r FROM box, range(4) x(i), range(7) y(j)
            WHERE a + i * 0.5 <= b + 1e-9 AND c + j * 0.5 <= d + 1e-9),
        grid AS (SELECT DISTINCT lat, lon FROM pts p WHERE NOT EXISTS (SELECT 1 FROM box WHERE box.r > p.r AND lat BETWEEN a AND b AND lon BETWEEN c AND d)),
        near AS (SELECT id, round(grid.lat, 6) AS c_lat, round(grid.lon, 6) AS c_lon FROM geo JOIN grid
            ON {HAV_SQL.format('geo.lat', 'grid.lat', 'geo.lon', 'grid.lon')} <= 50)
        SELECT id, CAST(c_lat AS DOUBLE) AS c_lat, CAST(c_lon AS DOUBLE) AS c_lon FROM near
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY c_lat, c_lon) = 1""",
    ),
)
def j15(spark, sf):
    centres = grid_points(spark, (24.0, 49.0), (-125.0, -66.0), 1.0, DENSE, 0.5)
    return regions.assign_to_grid(t.geo(spark, sf), centres, "id", "lat", "lon")


@query(
    "j16_natural_key_lookup",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey END AS k1,
        l_suppkey + 100 AS k2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a.p_name, b.p_name) AS p_name FROM r
    LEFT JOIN part a ON a.p_partkey = k1 LEFT JOIN part b ON b.p_partkey = k2 AND b.p_partkey % 2 = 0""",
)
def j16(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("map_id"),
        (F.col("l_suppkey") + 100).alias("place_id"),
    )
    keys = table(spark, sf, "part").select(
        F.col("p_partkey").alias("map_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("place_id"), "p_name"
    )
    out = chains.natural_key_lookup(rows, keys, "map_id", "place_id", "p_name")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query(
    "j17_transfer_labels",
    with_views(
        "site",
        """+ d AS (SELECT domain, min(length(url) % 2) AS label FROM site WHERE page_id % 2 = 0 GROUP BY domain
            HAVING count(DISTINCT length(url) % 2) = 1)
        SELECT page_id % 60 AS owner, CAST(min(label) AS VARCHAR) AS label FROM site JOIN d USING (domain) GROUP BY 1
        HAVING count(DISTINCT label) = 1""",
    ),
)
def j17(spark, sf):
    s = t.site(spark, sf).select("page_id", "url", "domain", (F.col("page_id") % 60).alias("owner"))
    labelled = s.where("page_id % 2 = 0").withColumn("label", (F.length("url") % 2).cast("string"))
    return chains.transfer_labels(labelled, s, "domain", "owner", "label")


URL_LABELS = (("blog", "Blog"), ("spam", "Spam"), (r"m\.", "Mobile"))


@query(
    "j18_implied_label_outcome",
    with_views(
        "site",
        r"""+ i AS (SELECT page_id % 90 AS owner, CASE WHEN regexp_matches(domain || ' ' || url, 'blog') THEN 'Blog'
            WHEN regexp_matches(domain || ' ' || url, 'spam') THEN 'Spam'
            WHEN regexp_matches(domain || ' ' || url, 'm\.') THEN 'Mobile' END AS implied FROM site),
        e AS (SELECT owner, min(implied) AS implied, max(implied) AS hi FROM i WHERE implied IS NOT NULL GROUP BY owner),
        c AS (SELECT DISTINCT page_id % 90 AS owner FROM site),
        l AS (SELECT owner, ['Blog', 'Unknown', NULL, 'Spam'][owner % 4 + 1] AS label FROM c)
        SELECT owner, implied, label, CASE WHEN implied <> hi THEN 'conflict' WHEN label IS NULL THEN 'fill-null'
        WHEN label = 'Unknown' THEN 'upgrade-unknown' WHEN label = implied THEN 'agree' ELSE 'disagree' END AS outcome
        FROM e JOIN l USING (owner)""",
    ),
)
def j18(spark, sf):
    s = t.site(spark, sf).withColumn("owner", F.col("page_id") % 90)
    s = s.withColumn("implied", urls.url_rule_bucket(F.col("url"), F.col("domain"), URL_LABELS))
    slot = F.col("owner") % 4
    current = s.select("owner").distinct().withColumn(
        "label", F.when(slot == 0, "Blog").when(slot == 1, "Unknown").when(slot == 3, "Spam")
    )
    return chains.implied_label_outcome(s, current, "owner", "implied", "label")


@query(
    "j19_label_precedence",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'reviewed' END, CASE WHEN c_custkey % 3 = 0 THEN 'judged' END,
    CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS label, CASE WHEN c_custkey % 7 = 0 THEN 'review' WHEN c_custkey % 3 = 0
    THEN 'model' WHEN c_custkey % 2 = 0 THEN 'tag' END AS label_source FROM customer""",
)
def j19(spark, sf):
    k = F.col("c_custkey")
    layers = [
        ("review", F.when(k % 7 == 0, "reviewed")),
        ("model", F.when(k % 3 == 0, "judged")),
        ("tag", F.when(k % 2 == 0, F.col("c_mktsegment"))),
    ]
    return table(spark, sf, "customer").select("c_custkey", *chains.precedence(layers))


@query(
    "j20_match_on_page_key",
    f"""{CANON_SQL}, coded AS (SELECT key, arg_max(page_id % 2 = 0, page_id) AS human FROM canon WHERE page_id % 3 > 0 GROUP BY key),
    seen AS (SELECT key, min(page_id) AS page_id FROM canon GROUP BY key)
    SELECT key, page_id, human FROM seen JOIN coded USING (key)""",
)
def j20(spark, sf):
    key = urls.canonical_page_key(urls.domain_path(F.col("url"))).alias("key")
    pages = table(spark, sf, "pages").select("page_id", key)
    coded = pages.where("page_id % 3 > 0").withColumn("human", F.col("page_id") % 2 == 0)
    coded = upsert.last_per_key(coded, ["key"], ["page_id"]).select("key", "human")
    first = upsert.first_per_key(pages, ["key"], ["page_id"])
    return first.join(coded, "key").select("key", "page_id", "human")


@query(
    "j21_entity_winner",
    with_views(
        "entity race",
        """+ w AS (SELECT district, party FROM (SELECT district, party, sum(votes) AS v FROM race WHERE yr = 1996 GROUP BY ALL)
            QUALIFY rank() OVER (PARTITION BY district ORDER BY v DESC) = 1)
        SELECT entity_id, grp, party AS winner FROM entity JOIN w ON district = state""",
    ),
)
def j21(spark, sf):
    from almanac.operators.elections import winners

    votes = t.race(spark, sf).where("yr = 1996").groupBy("district", "party").agg(F.sum("votes").alias("votes"))
    won = winners(votes, ["district"], "votes").select(F.col("district").alias("state"), F.col("party").alias("winner"))
    return t.entity(spark, sf).join(won, "state").select("entity_id", "grp", "winner")


@query(
    "j22_phrase_scores",
    f"WITH {CENTROID_SQL} SELECT vec_id, CAST(phrase AS BIGINT) AS phrase, round(score, 6) AS score FROM sims WHERE score >= 0.2",
)
def j22(spark, sf):
    found = materialise(phrases(spark, sf), "phrases")
    scores = search.phrase_scores(table(spark, sf, "embeddings"), "vec_id", "embedding", found, "label", "phrase", 0.2)
    return scores.withColumn("score", F.round("score", 6))


@query(
    "j23_compound_key_match",
    """WITH f AS (SELECT user_id, event_type, event_id, CASE WHEN value > 60 THEN 'Implicit' WHEN value > 40 THEN 'Embedded'
        WHEN value > 20 THEN 'Explicit' END AS framing FROM events),
    k AS (SELECT user_id, event_type, arg_max(framing, event_id) AS framing FROM f WHERE framing IS NOT NULL GROUP BY ALL)
    SELECT event_id, k.framing FROM events JOIN k USING (user_id, event_type)""",
)
def j23(spark, sf):
    v = F.col("value")
    framing = F.when(v > 60, "Implicit").when(v > 40, "Embedded").when(v > 20, "Explicit")
    e = table(spark, sf, "events")
    coded = e.select(
        F.col("user_id").alias("site"), F.lower(F.trim(F.concat(F.lit(" "), F.upper("event_type")))).alias("keyword"),
        "event_id", framing.alias("framing"),
    ).where(F.col("framing").isNotNull())
    lookup = upsert.last_per_key(coded, ["site", "keyword"], ["event_id"]).drop("event_id")
    chunks = e.select("event_id", F.col("user_id").alias("site"), F.lower("event_type").alias("keyword"))
    return chunks.join(lookup, ["site", "keyword"]).select("event_id", "framing")

"""Queries for aggregation (A), windows (W), sorting and sampling (L) and sets (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import aggregates as agg
from almanac.operators import elections, ranks, sampling, text, upsert
from almanac.plans import tables as t
from almanac.plans.registry import query
from almanac.plans.scalar_plans import PART_RULES, PART_RULE_SQL
from almanac.plans.tables import table, with_views
from almanac.plans.text_plans import LEXICON, ROLLUP_SQL, SPANS_SQL

CATS = ["click", "error", "purchase", "signup"]


def rounded(df, *cols, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- A ---------------------------------------------------------------------


@query(
    "a01_filtered_counts",
    """SELECT lang, count(*) AS pages, count(*) FILTER (n_chars > 2000) AS long_pages,
    count(*) FILTER (contains(text, 'that')) AS mentions FROM documents GROUP BY lang""",
)
def a01(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("pages"), F.count_if(F.col("n_chars") > 2000).alias("long_pages"),
        F.count_if(F.col("text").contains("that")).alias("mentions"),
    )


@query(
    "a02_share_active_by_region",
    with_views(
        "entity",
        """SELECT state, count(*) AS n, count(o.o_custkey) AS n_active, round(count(o.o_custkey) / count(*), 6) AS share,
        count(*) < 60 AS low_sample FROM entity LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 480000) o
        ON o_custkey = entity_id GROUP BY state""",
    ),
)
def a02(spark, sf):
    acted = table(spark, sf, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("entity_id"))
    return rounded(agg.share_active(t.entity(spark, sf), acted, "state", "entity_id", low=60), "share")


@query(
    "a02_unplaced_count",
    """SELECT count(*) FILTER (c_acctbal < 0) AS dropped FROM customer""",
)
def a02_dropped(spark, sf):
    placed = t.entity(spark, sf).withColumn("state", F.when(F.col("c_acctbal") >= 0, F.col("state")))
    return agg.unplaced_count(placed, "state")


def event_users(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("entity_id")).distinct()


MATRIX_SQL = """users AS (SELECT DISTINCT user_id AS entity_id FROM events),
    m AS (SELECT u.entity_id, count(*) FILTER (category = 'click') AS click, count(*) FILTER (category = 'error') AS error,
        count(*) FILTER (category = 'purchase') AS purchase, count(*) FILTER (category = 'signup') AS signup
        FROM users u LEFT JOIN action USING (entity_id) GROUP BY u.entity_id)"""


def matrix(spark, sf):
    return agg.count_matrix(t.action(spark, sf), event_users(spark, sf), "entity_id", "category", CATS)


@query("a03_category_matrix", with_views("action", f"+ {MATRIX_SQL} SELECT * FROM m"))
def a03(spark, sf):
    return matrix(spark, sf)


FRAMING_SQL = """CASE WHEN value > 60 THEN 'Implicit' WHEN value > 30 THEN 'Embedded' ELSE 'Explicit' END"""
FRAMINGS = ["Implicit", "Explicit", "Embedded"]


def framed(spark, sf):
    v = F.col("value")
    return t.action(spark, sf).withColumn("framing", F.when(v > 60, "Implicit").when(v > 30, "Embedded").otherwise("Explicit"))


@query(
    "a04_framing_matrix",
    with_views(
        "action",
        f"""+ users AS (SELECT DISTINCT user_id AS entity_id FROM events), f AS (SELECT entity_id, {FRAMING_SQL} AS framing FROM action)
        SELECT entity_id, count(*) FILTER (framing = 'Implicit') AS "Implicit", count(*) FILTER (framing = 'Explicit') AS "Explicit",
        count(*) FILTER (framing = 'Embedded') AS "Embedded" FROM users LEFT JOIN f USING (entity_id) GROUP BY entity_id""",
    ),
)
def a04(spark, sf):
    return agg.count_matrix(framed(spark, sf), event_users(spark, sf), "entity_id", "framing", FRAMINGS)


COUNTS_SQL = """cnt AS (SELECT c_custkey AS entity_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders
        ON o_custkey = c_custkey AND o_orderpriority <> '1-URGENT' GROUP BY 1),
    z AS (SELECT entity_id, n, ln(1 + n) AS log_n, (ln(1 + n) - (SELECT avg(ln(1 + n)) FROM cnt))
        / (SELECT stddev_pop(ln(1 + n)) FROM cnt) AS zscore FROM cnt)"""


def order_counts(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    o = table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_custkey").alias("entity_id"))
    counts = o.groupBy("entity_id").agg(F.count("*").alias("n"))
    return base.join(counts, "entity_id", "left").na.fill({"n": 0})


@query("a05_outliers", f"""WITH {COUNTS_SQL} SELECT entity_id, n, round(log_n, 6) AS log_n, round(zscore, 6) AS zscore,
    abs(zscore) > 2.5 AS is_outlier FROM z""")
def a05(spark, sf):
    return rounded(agg.find_outliers(order_counts(spark, sf), limit=2.5), "log_n", "zscore")


@query("a06_active_denominator", f"""WITH {COUNTS_SQL} SELECT entity_id FROM z WHERE abs(zscore) <= 2.5
    AND entity_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    AND entity_id IN (SELECT o_custkey FROM orders)""")
def a06(spark, sf):
    sites = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_custkey").alias("site_id"), (F.col("c_acctbal") < 0).alias("has_error")
    )
    pages = table(spark, sf, "orders").select(F.col("o_custkey").alias("site_id"))
    active = agg.active_entities(sites, pages, "entity_id", "site_id")
    return agg.denominator(active, agg.find_outliers(order_counts(spark, sf), limit=2.5), "entity_id")


ACTION_RULES = PART_RULES + (("rest", ("",)),)


@query(
    "a07_actions_view",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('X_', l_returnflag, '_', p_name) AS category,
        p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus <> 'O')
    SELECT l_orderkey, l_linenumber, l_partkey, p_name AS action, replace({PART_RULE_SQL.format('p_name')}, '??UNMAPPED', 'rest')
    AS bucket, CASE n_name WHEN 'NATION_2' THEN 'NATION_1' ELSE n_name END AS grp FROM l JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal >= 0""",
)
def a07(spark, sf):
    labels = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("entity_id"),
        F.concat(F.lit("X_"), "l_returnflag", F.lit("_"), "p_name").alias("category"),
        F.when(F.col("l_linestatus") == "O", "late").otherwise("").alias("error"),
    )
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "entity_id")
    entities = s.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        "entity_id", F.col("n_name").alias("grp")
    )
    view = agg.actions_view(labels, entities, ACTION_RULES, s.where("s_acctbal < 0"), merge={"NATION_2": "NATION_1"})
    return view.select("l_orderkey", "l_linenumber", "l_partkey", "action", "bucket", "grp")


def race_rows(spark, sf):
    r = t.race(spark, sf)
    return r.select(
        F.regexp_extract("district", r"(\d+)", 1).alias("district"), F.lit("xx").alias("state"), F.col("yr").alias("year"),
        F.when(F.col("mode") == "5-LOW", "").otherwise(F.col("mode")).alias("mode"), F.lit(None).cast("string").alias("stage"),
        F.when(F.col("party") == "BUILDING", "0").otherwise("100").alias("totalvotes"),
        F.col("party").alias("candidate"), "party", F.col("votes").cast("string").alias("candidatevotes"),
        F.concat_ws("|", "district", "yr", "mode", "party").alias("seq"),
    )


@query(
    "a08_election_candidates",
    with_views(
        "race",
        """SELECT concat('XX-', regexp_extract(district, '(\\d+)', 1)) AS district_id, yr AS year, 'gen' AS stage,
        CASE WHEN mode = '5-LOW' THEN 'total' ELSE mode END AS mode, party AS candidate, lower(party) AS party,
        votes AS candidatevotes, CASE WHEN party <> 'BUILDING' THEN round(votes / 100.0::DOUBLE, 6) END AS vote_share FROM race""",
    ),
)
def a08(spark, sf):
    return elections.normalise_races(race_rows(spark, sf), "seq")[1]


@query(
    "a08_election_races",
    with_views(
        "race",
        """SELECT concat('XX-', regexp_extract(district, '(\\d+)', 1)) AS district_id, yr AS year, 'gen' AS stage,
        CASE WHEN mode = '5-LOW' THEN 'total' ELSE mode END AS mode,
        CAST(CASE WHEN arg_min(party, concat_ws('|', district, yr, mode, party)) = 'BUILDING' THEN 0 ELSE 100 END AS BIGINT) AS totalvotes
        FROM race GROUP BY ALL""",
    ),
)
def a08_races(spark, sf):
    return elections.normalise_races(race_rows(spark, sf), "seq")[0]


@query(
    "a09_two_party_share",
    with_views(
        "race",
        """+ s AS (SELECT district, yr, mode, sum(votes) FILTER (party = 'BUILDING') AS dem, sum(votes) FILTER (party = 'MACHINERY') AS rep
            FROM race GROUP BY ALL)
        SELECT district, yr, mode, CAST(dem AS BIGINT) AS dem, CAST(rep AS BIGINT) AS rep, round(dem / (dem + rep), 6) AS share,
        CASE WHEN dem / (dem + rep) > 0.5 THEN 'BUILDING' ELSE 'MACHINERY' END AS winner FROM s WHERE dem + rep > 0""",
    ),
)
def a09(spark, sf):
    out = elections.two_party_share(t.race(spark, sf), ["district", "yr", "mode"], "party", "votes", "BUILDING", "MACHINERY")
    return rounded(out, "share")


CLICK_SQL = """users AS (SELECT c_custkey AS entity_id FROM customer),
    m AS (SELECT u.entity_id, count(*) FILTER (category = 'click') AS click, count(*) FILTER (category = 'error') AS error,
        count(*) FILTER (category = 'purchase') AS purchase, count(*) FILTER (category = 'signup') AS signup,
        count(DISTINCT category) AS types FROM users u LEFT JOIN action USING (entity_id) GROUP BY u.entity_id),
    s AS (SELECT *, click + error + purchase + signup AS n FROM m)"""


def customer_matrix(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    return agg.count_matrix(t.action(spark, sf), ids, "entity_id", "category", CATS)


@query(
    "a10_overview",
    with_views(
        "action",
        f"""+ {CLICK_SQL} SELECT count(*) AS n_all, count(*) FILTER (n > 0) AS n_active,
        round(100.0 * count(*) FILTER (n > 0) / count(*), 6) AS pct_active,
        round(196.0 * sqrt((count(*) FILTER (n > 0) / count(*)) * (1 - count(*) FILTER (n > 0) / count(*)) / count(*)), 6) AS pct_ci95,
        round(avg(n), 6) AS mean_all, round(avg(n) FILTER (n > 0), 6) AS mean_active,
        round(1.96 * stddev_samp(n) FILTER (n > 0) / sqrt(count(*) FILTER (n > 0)), 6) AS mean_active_ci95,
        round(avg(types) FILTER (n > 0), 6) AS types_active, round(avg(types), 6) AS types_all FROM s""",
    ),
)
def a10(spark, sf):
    types = t.action(spark, sf).groupBy("entity_id").agg(F.countDistinct("category").alias("types"))
    out = agg.overview(customer_matrix(spark, sf), types, "entity_id", CATS)
    return rounded(out, *[c for c in out.columns if not c.startswith("n_")])


@query(
    "a11_category_table",
    with_views(
        "action",
        f"""+ {CLICK_SQL}, l AS (UNPIVOT (SELECT entity_id, click, error, purchase, signup FROM m) ON click, error, purchase, signup
            INTO NAME category VALUE n)
        SELECT category, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, count(*) FILTER (n > 0) AS n_with,
        round(100.0 * count(*) FILTER (n > 0) / count(*), 6) AS pct_with, CAST(sum(n) AS BIGINT) AS total FROM l GROUP BY category""",
    ),
)
def a11(spark, sf):
    return rounded(agg.category_table(customer_matrix(spark, sf), "entity_id", CATS), "mean", "sd", "pct_with")


def per_entity(spark, sf):
    total = F.col("click") + F.col("error") + F.col("purchase") + F.col("signup")
    return customer_matrix(spark, sf).withColumn("n", total).join(t.entity(spark, sf), "entity_id")


@query(
    "a12_group_table",
    with_views(
        "action entity",
        f"""+ {CLICK_SQL} SELECT grp, count(*) AS n_all, count(*) FILTER (n > 0) AS n_active,
        round(100.0 * count(*) FILTER (n > 0) / count(*), 6) AS pct_active,
        round(100.0 * sqrt((count(*) FILTER (n > 0) / count(*)) * (1 - count(*) FILTER (n > 0) / count(*)) / count(*)), 6) AS pct_sd,
        round(avg(n), 6) AS mean_all, round(stddev_samp(n), 6) AS sd_all, round(avg(n) FILTER (n > 0), 6) AS mean_active,
        round(coalesce(stddev_samp(n) FILTER (n > 0) / sqrt(count(*) FILTER (n > 0)), 0), 6) AS sem_active
        FROM s JOIN entity USING (entity_id) GROUP BY grp""",
    ),
)
def a12(spark, sf):
    out = agg.group_table(per_entity(spark, sf), "grp").drop("ci95_all", "pct_ci95")
    return rounded(out, "pct_active", "pct_sd", "mean_all", "sd_all", "mean_active", "sem_active")


@query(
    "a13_composition",
    with_views(
        "action entity",
        f"""+ {CLICK_SQL}, j AS (SELECT * FROM s JOIN entity USING (entity_id))
        SELECT grp, 'active' AS over, round(avg(click), 6) AS click, round(avg(error), 6) AS error, round(avg(purchase), 6) AS purchase,
        round(avg(signup), 6) AS signup FROM j WHERE n > 0 GROUP BY grp
        UNION ALL SELECT grp, 'all', round(avg(click), 6), round(avg(error), 6), round(avg(purchase), 6), round(avg(signup), 6)
        FROM j GROUP BY grp""",
    ),
)
def a13(spark, sf):
    m = per_entity(spark, sf)
    parts = [agg.composition(m, "grp", CATS, only).withColumn("over", F.lit(n)) for n, only in (("active", True), ("all", False))]
    return rounded(parts[0].unionByName(parts[1]), *CATS)


@query(
    "a14_own_shares",
    with_views(
        "action",
        f"""+ {CLICK_SQL} SELECT entity_id, round(click / n, 6) AS click, round(error / n, 6) AS error,
        round(purchase / n, 6) AS purchase, round(signup / n, 6) AS signup FROM s WHERE n > 0""",
    ),
)
def a14(spark, sf):
    return rounded(agg.own_shares(customer_matrix(spark, sf), "entity_id", CATS), *CATS)


@query(
    "a14_relative_mix",
    with_views(
        "action entity",
        f"""+ {CLICK_SQL} SELECT grp, round(sum(click) / nullif(sum(n), 0), 6) AS click, round(sum(error) / nullif(sum(n), 0), 6) AS error,
        round(sum(purchase) / nullif(sum(n), 0), 6) AS purchase, round(sum(signup) / nullif(sum(n), 0), 6) AS signup
        FROM s JOIN entity USING (entity_id) GROUP BY grp""",
    ),
)
def a14_mix(spark, sf):
    return rounded(agg.relative_mix(per_entity(spark, sf), "grp", CATS), *CATS)


@query(
    "a15_prevalence",
    with_views(
        "entity",
        """SELECT region, grp, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY region) AS DOUBLE), 6) AS share
        FROM entity GROUP BY region, grp""",
    ),
)
def a15(spark, sf):
    return rounded(agg.prevalence(t.entity(spark, sf), "grp", "region"), "share")


FRAMED_SQL = f"""f AS (SELECT entity_id, category, {FRAMING_SQL} AS framing, grp, region FROM action JOIN entity USING (entity_id))"""


@query(
    "a16_framing_by_group",
    with_views(
        "action entity",
        f"""+ {FRAMED_SQL} SELECT grp, region, framing, category, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM entity e
        WHERE e.grp = f.grp AND e.region = f.region) AS DOUBLE), 6) AS per_entity FROM f GROUP BY grp, region, framing, category""",
    ),
)
def a16(spark, sf):
    base = t.entity(spark, sf).select("entity_id", "grp", "region")
    return rounded(agg.rate_table(framed(spark, sf), base, "entity_id", ["framing", "category"], ["grp", "region"]), "per_entity")


@query(
    "a16_framing_table",
    with_views(
        "action entity",
        f"""+ {FRAMED_SQL} SELECT framing, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM entity) AS DOUBLE), 6) AS per_entity
        FROM f GROUP BY framing""",
    ),
)
def a16_table(spark, sf):
    base = t.entity(spark, sf).select("entity_id")
    return rounded(agg.rate_table(framed(spark, sf), base, "entity_id", ["framing"], []), "per_entity")


@query(
    "a17_state_group_stats",
    with_views(
        "action entity",
        f"""+ {CLICK_SQL} SELECT state, count(*) AS n_all, count(*) FILTER (n > 0) AS n_active, round(avg(n), 6) AS mean_all,
        round(coalesce(1.96 * stddev_samp(n) / sqrt(count(*)), 0), 6) AS ci95_all
        FROM s JOIN entity USING (entity_id) WHERE region IN ('ASIA', 'EUROPE') GROUP BY state""",
    ),
)
def a17(spark, sf):
    rows = per_entity(spark, sf).where(F.col("region").isin("ASIA", "EUROPE"))
    out = agg.group_table(rows, "state").select("state", "n_all", "n_active", "mean_all", "ci95_all")
    return rounded(out, "mean_all", "ci95_all")


@query(
    "a18_spread_family",
    """SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS sem,
    round(1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS ci95,
    round(sqrt(avg((c_acctbal > 0)::INT) * (1 - avg((c_acctbal > 0)::INT)) / count(*)), 6) AS share_sd,
    round(1.96 * sqrt(avg((c_acctbal > 0)::INT) * (1 - avg((c_acctbal > 0)::INT)) / count(*)), 6) AS share_ci95
    FROM customer GROUP BY c_mktsegment""",
)
def a18(spark, sf):
    x, k, n = F.col("c_acctbal"), F.count_if(F.col("c_acctbal") > 0), F.count("*")
    out = table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        agg.sd_mean(x).alias("sd"), agg.sem(x).alias("sem"), agg.ci95_mean(x).alias("ci95"),
        agg.sd_share(k, n).alias("share_sd"), agg.ci95_share(k, n).alias("share_ci95"),
    )
    return rounded(out, "sd", "sem", "ci95", "share_sd", "share_ci95")


@query(
    "a19_tier_table",
    """WITH t AS (SELECT CASE WHEN o_totalprice / 5 <= 25000 THEN 'close' WHEN o_totalprice / 5 <= 50000 THEN 'medium' ELSE 'far' END
        AS tier, o_custkey FROM orders)
    SELECT v.tier, count(o_custkey) AS n, round(avg(o_custkey), 6) AS mean FROM (VALUES ('close'), ('medium'), ('far')) v(tier)
    LEFT JOIN t USING (tier) GROUP BY v.tier""",
)
def a19(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.col("o_totalprice") / 5)
    return rounded(agg.tier_table(o, "m", "o_custkey"), "mean")


@query(
    "a20_mean_similarity",
    """WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
    c AS (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM q), m AS (SELECT i, avg(x) AS m FROM c GROUP BY i),
    u AS (SELECT list(m / (SELECT sqrt(sum(m * m)) FROM m) ORDER BY i) AS p FROM m)
    SELECT label, round(avg(list_dot_product(v, p)), 6) AS mean_sim, count(*) AS n_pages FROM q, u GROUP BY label""",
)
def a20(spark, sf):
    from almanac.operators import search

    e = table(spark, sf, "embeddings")
    q = search.mean_vector(e, "embedding").first()[0]  # one vector
    sim = search.query_similarity(F.col("embedding"), q)
    out = e.groupBy("label").agg(F.avg(sim).alias("mean_sim"), F.count("*").alias("n_pages"))
    return rounded(out, "mean_sim")


@query("a21_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 4")
def a21(spark, sf):
    return agg.value_counts(table(spark, sf, "part"), "p_type", 4)


@query(
    "a22_dominant_value",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""",
)
def a22(spark, sf):
    return agg.dominant_value(table(spark, sf, "events"), "user_id", "event_type")


@query(
    "a23_cohort_report",
    """WITH w AS (SELECT c_custkey, o_orderkey AS site FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'),
    p AS (SELECT l_orderkey AS site, count(*) AS pages, count(*) FILTER (l_returnflag <> 'R') AS txt FROM lineitem WHERE l_linenumber > 4
        GROUP BY 1),
    r AS (SELECT c_custkey, count(DISTINCT site) AS n_sites, CAST(coalesce(sum(pages), 0) AS BIGINT) AS n_pages,
        CAST(coalesce(sum(txt), 0) AS BIGINT) AS n_text FROM w LEFT JOIN p USING (site) GROUP BY 1)
    SELECT c_custkey, n_sites, n_pages, n_text, CASE WHEN c_custkey % 11 = 0 THEN 'judged but undecided' WHEN n_sites = 0 THEN 'no site'
    WHEN n_pages = 0 THEN 'site never read' WHEN n_text = 0 THEN 'no text' ELSE 'ready to judge' END AS reason FROM r""",
)
def a23(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 11 == 0).alias("judged"))
    s = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("site")
    )
    p = table(spark, sf, "lineitem").where("l_linenumber > 4").select(
        F.col("l_orderkey").alias("site"), F.when(F.col("l_returnflag") != "R", "x").alias("txt")
    )
    return agg.cohort_report(c, s, p, "c_custkey", "site", "txt", "judged").drop("judged")


@query(
    "a24_histogram",
    """WITH r AS (SELECT min(o_totalprice) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
    SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 39)), 38) AS INTEGER) AS bin, count(*) AS n FROM orders, r
    WHERE o_totalprice <= hi GROUP BY 1""",
)
def a24(spark, sf):
    return agg.histogram(table(spark, sf, "orders"), "o_totalprice")


@query(
    "a24_five_numbers",
    """SELECT o_orderpriority, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
    round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS high
    FROM orders GROUP BY o_orderpriority""",
)
def a24_box(spark, sf):
    return rounded(agg.five_numbers(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), "q1", "median", "q3")


@query(
    "a25_listed_urls",
    with_views("site", "SELECT domain, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls, count(DISTINCT url) AS n FROM site GROUP BY domain"),
)
def a25(spark, sf):
    found = agg.listed_values(t.site(spark, sf), "domain", "url")
    return found.select("domain", F.array_join("items", " ").alias("urls"), F.size("items").cast("bigint").alias("n"))


@query(
    "a26_crawl_outcome",
    with_views(
        "site",
        """+ m AS (SELECT domain, sum(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 0 + (page_id % 2) END) AS saved, count(*) AS failed,
            min(CASE WHEN page_id % 4 = 0 THEN 'timeout' END) AS err FROM site GROUP BY domain),
        p AS (SELECT DISTINCT domain FROM site WHERE page_id % 5 = 0)
        SELECT domain, CAST(saved AS BIGINT) AS saved, failed, saved = 0 AND domain NOT IN (FROM p) AS has_error,
        CASE WHEN saved = 0 AND domain NOT IN (FROM p) THEN coalesce(err, 'no pages saved') ELSE '' END AS error_text FROM m""",
    ),
)
def a26(spark, sf):
    s = t.site(spark, sf).select("page_id", "domain")
    k = F.col("page_id")
    manifest = s.select(
        "domain", F.when(k % 3 == 0, 0).otherwise(k % 2).alias("pages_saved"), F.lit(1).alias("pages_failed"),
        F.when(k % 4 == 0, "timeout").alias("error_text"),
    )
    return agg.crawl_outcome(manifest, s.where("page_id % 5 = 0"), "domain")


@query(
    "a27_best_rate_by_winner",
    with_views(
        "race",
        """+ v AS (SELECT district, party, sum(votes) AS votes FROM race GROUP BY ALL),
        w AS (SELECT district, party, CAST(votes AS BIGINT) AS votes FROM v x WHERE votes = (SELECT max(votes) FROM v y WHERE y.district = x.district)),
        r AS (SELECT n_name AS district, avg(c_acctbal) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
        SELECT district, round(m, 6) AS mean_rate, party, votes FROM w JOIN r USING (district)""",
    ),
)
def a27(spark, sf):
    votes = t.race(spark, sf).groupBy("district", "party").agg(F.sum("votes").alias("votes"))
    rates = t.entity(spark, sf).select(F.col("state").alias("district"), "c_acctbal")
    return rounded(elections.best_rate_by_winner(rates, votes, "district", "c_acctbal", "votes"), "mean_rate")


@query(
    "a28_entities_per_framing",
    with_views(
        "action",
        f"""SELECT framing, count(DISTINCT entity_id) AS entities, count(*) AS chunks
        FROM (SELECT entity_id, {FRAMING_SQL} AS framing FROM action) GROUP BY framing""",
    ),
)
def a28(spark, sf):
    return agg.entities_per_framing(framed(spark, sf), "framing", "entity_id")


@query(
    "a29_dimension",
    """SELECT l_suppkey, l_linenumber, arg_min(l_returnflag, (l_orderkey, l_partkey, l_quantity)) AS flag
    FROM lineitem GROUP BY ALL""",
)
def a29(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.struct("l_orderkey", "l_partkey", "l_quantity").alias("seq")
    )
    return agg.dimension(rows, ["l_suppkey", "l_linenumber"], ["flag"], "seq")


@query(
    "a30_supported_rate",
    with_views(
        "site",
        """SELECT domain, count(*) AS n, round(avg((length(html) > 2500)::INT), 6) AS rate FROM site GROUP BY domain HAVING count(*) >= 5
        ORDER BY avg((length(html) > 2500)::INT) DESC, domain LIMIT 15""",
    ),
)
def a30(spark, sf):
    return rounded(agg.supported_rate(t.site(spark, sf), "domain", F.length("html") > 2500), "rate")


# ---- W ---------------------------------------------------------------------


@query(
    "w01_winner_by_votes",
    with_views(
        "race",
        """SELECT district, yr, mode, party, votes, CASE WHEN party IN ('BUILDING', 'HOUSEHOLD') THEN 'Dem' WHEN party = 'MACHINERY' THEN 'Rep' END
        AS side FROM race QUALIFY rank() OVER (PARTITION BY district, yr, mode ORDER BY votes DESC) = 1""",
    ),
)
def w01(spark, sf):
    won = elections.winners(t.race(spark, sf), ["district", "yr", "mode"], "votes")
    return won.withColumn("side", elections.party_side(F.col("party"), ("building", "household"), ("machinery",)))


SHARE_SQL = """+ s AS (SELECT district, yr, mode, party, CASE WHEN votes % 4 = 0 THEN NULL ELSE votes END AS v FROM race)"""


def with_null_shares(spark, sf):
    return t.race(spark, sf).select("district", "yr", "mode", "party", F.when(F.col("votes") % 4 != 0, F.col("votes")).alias("v"))


@query(
    "w02_winner_by_share",
    with_views("race", f"""{SHARE_SQL} SELECT * FROM s QUALIFY rank() OVER (PARTITION BY district, yr, mode ORDER BY v DESC NULLS FIRST) = 1"""),
)
def w02(spark, sf):
    return elections.winners(with_null_shares(spark, sf), ["district", "yr", "mode"], "v")


@query(
    "w02_winner_no_nulls_no_ties",
    with_views(
        "race",
        f"""{SHARE_SQL} SELECT * FROM s WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY district, yr, mode
        ORDER BY v DESC, party) = 1""",
    ),
)
def w02_one(spark, sf):
    return elections.winners(with_null_shares(spark, sf), ["district", "yr", "mode"], "v", "one", True, ["party"])


@query(
    "w03_neighbouring_spans",
    f"""WITH {SPANS_SQL} SELECT doc_id, s AS "start", e AS "end", lag(e) OVER (PARTITION BY doc_id ORDER BY s) AS prev_end,
    lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS next_start FROM spans""",
)
def w03(spark, sf):
    from pyspark.sql import Window

    spans = text.keyword_spans(table(spark, sf, "documents"), "doc_id", "text", LEXICON)
    order = Window.partitionBy("doc_id").orderBy("start")
    out = spans.select(
        "doc_id", "start", "end", F.lag("end").over(order).alias("prev_end"), F.lead("start").over(order).alias("next_start")
    )
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("start", "end", "prev_end", "next_start")])


@query(
    "w04_running_budget",
    """SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS BIGINT) AS used FROM documents""",
)
def w04(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    bounds = ranks.order_bounds(docs, "doc_id")
    return ranks.running_total(docs, ["source"], "doc_id", F.col("n_chars"), "used", bounds).drop("n_chars")


@query(
    "w05_average_rank",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, rank() OVER (ORDER BY l_quantity) AS r,
        count(*) OVER (PARTITION BY l_quantity) AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, r + (c - 1) / 2 AS rank FROM r""",
)
def w05(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ranks.with_average_rank(rows, "l_quantity")


@query(
    "w06_first_and_last",
    """SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type
    FROM events GROUP BY user_id""",
)
def w06(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    first = upsert.first_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("first_type"))
    last = upsert.last_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"))
    return first.join(last, "user_id")


# ---- L ---------------------------------------------------------------------


@query("l01_top_sites", f"""WITH {SPANS_SQL}, r AS ({ROLLUP_SQL}) SELECT source, pages_with_hits, spans FROM r
    ORDER BY pages_with_hits DESC, source LIMIT 10""")
def l01(spark, sf):
    roll = text.site_rollup(table(spark, sf, "documents"), "source", "text", LEXICON)
    return roll.orderBy(F.desc("pages_with_hits"), "source").limit(10).select("source", "pages_with_hits", "spans")


@query(
    "l02_sample_per_group",
    """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source
    ORDER BY md5(doc_id || ':42'), doc_id) <= 5""",
)
def l02(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.seeded_sample_per_group(docs, "source", "doc_id", 5)


@query(
    "l03_seeded_order",
    """SELECT doc_id, CAST(row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS INTEGER) AS position FROM documents
    QUALIFY position <= 50""",
)
def l03(spark, sf):
    return sampling.seeded_order(table(spark, sf, "documents").select("doc_id"), "doc_id", 50, 7)


@query(
    "l04_report_order",
    """SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal < 0, c_mktsegment, lower(c_name), c_custkey) AS BIGINT) AS position
    FROM customer""",
)
def l04(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") < 0).alias("blank"), "c_mktsegment", F.lower("c_name").alias("low")
    )
    return sampling.numbered_report(c, F.col("blank"), "c_mktsegment", "low", "c_custkey").select("c_custkey", "position")


@query(
    "l05_cohort_sample",
    with_views(
        "site",
        """+ a AS (SELECT page_id % 100 AS owner, url, length(html) AS n FROM site),
        pool AS (SELECT DISTINCT owner FROM a WHERE n > 2000 AND owner NOT IN (SELECT owner FROM a WHERE contains(url, 'blog'))),
        pick AS (SELECT owner FROM pool ORDER BY md5(owner || ':42'), owner LIMIT 20),
        u AS (SELECT owner, url, 0 AS r, 'short' AS c FROM a WHERE n < 1500 UNION ALL SELECT owner, url, 1, 'secure' FROM a
            WHERE starts_with(url, 'https') AND n % 3 = 0 UNION ALL SELECT owner, url, 2, 'sample' FROM a WHERE n > 2000 AND owner IN (FROM pick))
        SELECT owner, url, string_agg(c, '+' ORDER BY r) AS cohorts, min(r) AS priority FROM u GROUP BY owner, url""",
    ),
)
def l05(spark, sf):
    a = t.site(spark, sf).select((F.col("page_id") % 100).alias("owner"), "url", F.length("html").alias("n"))
    cohorts = [
        ("short", a.where("n < 1500")),
        ("secure", a.where(F.col("url").startswith("https") & (F.col("n") % 3 == 0))),
        ("sample", a.where("n > 2000")),
    ]
    return sampling.cohort_sample(cohorts, "sample", 20, a.where(F.col("url").contains("blog")), "owner", "url")


@query(
    "l06_stratified_split",
    """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY substr(md5(doc_id || ':42'), 1, 13), doc_id) AS n,
        count(*) OVER (PARTITION BY toxic) AS size FROM labels)
    SELECT doc_id, toxic, CASE WHEN n <= floor(size * 0.6 + 1e-9) THEN 'train' WHEN n <= floor(size * 0.8 + 1e-9) THEN 'valid' ELSE 'test' END AS split FROM r""",
)
def l06(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return sampling.stratified_split(lab, "toxic", "doc_id", [("train", 0.6), ("valid", 0.2), ("test", 0.2)])


@query(
    "l06_undersample",
    """SELECT doc_id, quality FROM (SELECT doc_id, 1 - quality AS quality FROM labels) WHERE quality = 1 UNION ALL
    (SELECT doc_id, 1 - quality AS quality FROM labels WHERE quality = 1 ORDER BY md5(doc_id || ':42'), doc_id
     LIMIT (SELECT CAST(floor(count(*) * 0.75 / 0.25) AS BIGINT) FROM labels WHERE quality = 0))""",
)
def l06_under(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("quality"))
    return sampling.undersample(lab, "quality", "doc_id", 0.25)


# ---- U ---------------------------------------------------------------------


def keyed(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.where("quality = 1").select("doc_id"), lab.where("toxic = 1").select("doc_id")


@query(
    "u01_set_operations",
    """SELECT 'union' AS op, doc_id FROM labels WHERE quality = 1 OR toxic = 1
    UNION ALL SELECT 'both', doc_id FROM labels WHERE quality = 1 AND toxic = 1
    UNION ALL SELECT 'first_only', doc_id FROM labels WHERE quality = 1 AND toxic = 0""",
)
def u01(spark, sf):
    a, b = keyed(spark, sf)
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "first_only": a.subtract(b)}
    named = [df.select(F.lit(n).alias("op"), "doc_id") for n, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "u02_domain_overlap",
    with_views("site", "SELECT domain FROM site WHERE page_id % 2 = 0 INTERSECT SELECT domain FROM site WHERE page_id % 3 = 0"),
)
def u02(spark, sf):
    s = t.site(spark, sf)
    return s.where("page_id % 2 = 0").select("domain").intersect(s.where("page_id % 3 = 0").select("domain"))


@query(
    "u03_concatenate_parts",
    """SELECT c_custkey AS id, c_name AS name, CASE WHEN s_suppkey IS NULL THEN 'left' ELSE 'both' END AS part FROM customer
    LEFT JOIN supplier ON s_suppkey = c_custkey + 20 UNION ALL SELECT s_suppkey - 20, s_name, 'right' FROM supplier
    WHERE s_suppkey - 20 NOT IN (SELECT c_custkey FROM customer)""",
)
def u03(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") - 20).alias("id"), F.col("s_name").alias("name"))
    both = c.join(s.select("id"), "id", "left_semi").withColumn("part", F.lit("both"))
    left = c.join(s, "id", "left_anti").withColumn("part", F.lit("left"))
    right = s.join(c, "id", "left_anti").withColumn("part", F.lit("right"))
    return both.unionByName(left).unionByName(right)

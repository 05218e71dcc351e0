"""The given tables, and the stand-in views that give them the shape of the data model.

Each view exists twice: as a DataFrame function and as SQL text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.urls import normal_domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIEW_SQL = {
    "geo": """SELECT vec_id AS id, 24.0 + 25.0*(CAST(embedding[1] AS DOUBLE)+1)/2 AS lat,
       -125.0 + 59.0*(CAST(embedding[2] AS DOUBLE)+1)/2 AS lon, label FROM embeddings""",
    "site": r"""SELECT page_id, url, html,
       regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') AS domain FROM pages""",
    "entity": """SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS grp, n_name AS state,
       r_name AS region, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
    "race": """SELECT n_name AS district, CAST(year(o_orderdate) AS INT) AS yr, o_orderpriority AS mode,
       c_mktsegment AS party, count(*) AS votes FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "action": """SELECT event_id, user_id AS entity_id, event_type AS category, ts, value
       FROM events WHERE event_type <> 'view'""",
    "rating": """SELECT d.doc_id, l.quality AS a, l.toxic AS b, CAST(d.n_chars > 500 AS INT) AS c,
       d.source, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "label_text": "SELECT p_partkey AS id, concat('NA_', p_type, '_', p_name) AS raw FROM part",
}


def with_views(names: str, body: str) -> str:
    """SQL text with the named stand-in views in front."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names.split())
    return f"WITH {ctes}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().lstrip('+')}"


def geo(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.lit(24.0) + F.lit(25.0) * (e[0].cast("double") + 1) / 2).alias("lat"),
        (F.lit(-125.0) + F.lit(59.0) * (e[1].cast("double") + 1) / 2).alias("lon"),
        "label",
    )


def site(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", "html", normal_domain(F.col("url")).alias("domain"))


def entity(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("entity_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("grp"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("region"),
            "c_acctbal",
        )
    )


def race(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .groupBy(
            F.col("n_name").alias("district"),
            F.year("o_orderdate").alias("yr"),
            F.col("o_orderpriority").alias("mode"),
            F.col("c_mktsegment").alias("party"),
        )
        .agg(F.count("*").alias("votes"))
    )


def action(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .where(F.col("event_type") != "view")
        .select("event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("category"), "ts", "value")
    )


def rating(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id",
        F.col("quality").alias("a"),
        F.col("toxic").alias("b"),
        (F.col("n_chars") > 500).cast("int").alias("c"),
        "source",
        "lang",
    )


def label_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("NA_"), "p_type", F.lit("_"), "p_name").alias("raw")
    )

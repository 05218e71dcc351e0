"""File sources and sinks.  Text inputs are read as strings and typed by the caller with ``try_cast``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from almanac.functions.values import blank_to_null


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with every column a string; a given column list saves the inference pass."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, encoding=encoding, multiLine=False, escape='"')


def write_csv(df: DataFrame, path: str, order: Sequence[str | Column] = ()) -> None:
    """Sorted CSV report with a header per file; parts are range-sorted, so no task holds the whole report."""
    (df.orderBy(*order) if order else df).write.csv(path, header=True, escape='"')


def read_json_lines(spark: SparkSession, path: str, schema: str, fields: dict[str, str]) -> DataFrame:
    """JSON lines with nested fields flattened; unreadable and blank lines are skipped."""
    parsed = (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    )
    return parsed.where(F.col("j").isNotNull() & F.col("j._bad").isNull()).select(*[F.col(f"j.{p}").alias(n) for n, p in fields.items()])


def write_report(df: DataFrame, path: str) -> None:
    """One-row summary as nested JSON; any other number of rows is an error, and nothing is written."""
    found = df.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"a report has one row, not {'several' if found else 'none'}")
    df.sparkSession.createDataFrame(found, df.schema).write.json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lower-case lines."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("value")).where("value <> ''").distinct()


def read_quoted_list(spark: SparkSession, path: str) -> list[str]:
    """Entries of a keyword file of quoted, comma-separated strings, in order; short by nature, so a plain list."""
    body = spark.read.text(path, wholetext=True)
    return body.select(F.regexp_extract_all("value", F.lit('"([^"]+)"'), 1).alias("k")).first()["k"]


def read_padded(spark: SparkSession, path: str, names: Sequence[str], sep: str = "|") -> DataFrame:
    """Separated lines; missing trailing fields are blank, further ones are dropped."""
    parts = F.split("value", f"\\Q{sep}\\E")
    cols = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return spark.read.text(path).where("value <> ''").select(*cols)


def read_coding_sheet(
    spark: SparkSession, path: str, header_path: str | None = None, link: int = 2, first: int = 4, encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Wide coding sheet with two header rows -> (link, category, label) per TRUE cell.

    The upper header names a category once for several columns, the lower one names the label.
    """
    raw = spark.read.csv(path, encoding=encoding, header=False, escape='"')
    top = (spark.read.csv(header_path, encoding=encoding, header=False, escape='"') if header_path else raw).take(2)
    category, cells = "", []
    for i in range(first, len(top[0])):
        category = (top[0][i] or "").strip() or category
        cells.append(
            F.struct(F.lit(category).alias("category"), F.lit((top[1][i] or "").strip()).alias("label"), F.col(f"_c{i}").alias("mark"))
        )
    rows = raw.where(F.trim(f"_c{link}").startswith("http"))
    long = rows.select(F.trim(f"_c{link}").alias("link"), F.explode(F.array(*cells)).alias("c"))
    return long.where(F.upper(F.trim("c.mark")) == "TRUE").select("link", "c.category", "c.label")


def _of_known_sites(files: DataFrame, root: str, sites: DataFrame, domain: str) -> DataFrame:
    """Adds domain (first part of a file's path below ``root``) and ``file`` (that path); files of unknown domains are dropped."""
    rest = F.regexp_extract(F.col("_metadata.file_path"), "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/(.*)$", 1)
    path = F.coalesce(F.try_url_decode(rest), rest)
    top = F.regexp_replace(F.split(path, "/")[0], "^[A-Za-z_]+=", "")
    return files.select(F.lower(top).alias(domain), path.alias("file"), "value").join(sites.select(domain).distinct(), domain)


def read_html_tree(spark: SparkSession, root: str, sites: DataFrame, domain: str = "domain") -> DataFrame:
    """Pages of a directory tree of one file each: the first part of the path is the domain; unknown domains are dropped."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return _of_known_sites(files, root, sites, domain).select(domain, F.col("file").alias("page_path"), F.col("value").alias("html"))


def write_page_bundles(pages: DataFrame, root: str, domain: str = "domain") -> None:
    """Pages (domain, page_path, html) as a tree of one folder per domain, in files of many pages: one JSON line each."""
    pages.select(domain, "page_path", "html").write.partitionBy(domain).json(root)


def read_page_bundles(spark: SparkSession, root: str, sites: DataFrame, domain: str = "domain") -> DataFrame:
    """``read_html_tree`` of a tree whose files hold many pages, as ``write_page_bundles`` makes it: files are opened and listed
    per domain and writer, not per page, and large ones are cut."""
    lines = spark.read.text(root, recursiveFileLookup=True)
    page = F.from_json("value", "page_path string, html string", {"maxStringLen": str(2**31 - 1)})
    return _of_known_sites(lines, root, sites, domain).select(domain, page.alias("_page")).select(domain, "_page.page_path", "_page.html")


def read_matrix(docs: DataFrame, body: str, carry: Sequence[str] = ()) -> DataFrame:
    """JSON matrices (row 0 names the columns) -> one map per data row; a column per name can be taken from it."""
    rows = F.from_json(body, "array<array<string>>")
    names = F.get(F.col("_m"), F.lit(0))
    data = F.slice(F.col("_m"), F.lit(2), F.greatest(F.size("_m") - 1, F.lit(0)))
    out = docs.select(*carry, rows.alias("_m")).where(F.size("_m") > 1)
    return out.select(*carry, F.posexplode(F.transform(data, lambda r: F.map_from_arrays(names, r))).alias("row", "cells"))


ELEMENTS = (
    "elements array<struct<type:string, id:bigint, lat:double, lon:double, center:struct<lat:double, lon:double>, "
    "tags:map<string, string>>>"
)


def read_elements(docs: DataFrame, body: str) -> DataFrame:
    """Map elements of nested JSON documents: place from the node or its centre, website from three tags, nameless dropped."""
    parsed = docs.select(F.explode(F.from_json(body, ELEMENTS)["elements"]).alias("e"))
    tags = F.col("e.tags")
    node = F.col("e.type") == "node"
    site = F.coalesce(*[blank_to_null(tags[k]) for k in ("website", "contact:website", "url")], F.lit(""))
    return parsed.where(blank_to_null(tags["name"]).isNotNull()).select(
        tags["name"].alias("name"), site.alias("website"),
        F.coalesce(tags["addr:city"], F.lit("")).alias("city"), F.coalesce(tags["addr:state"], F.lit("")).alias("state"),
        F.when(node, F.col("e.lat")).otherwise(F.col("e.center.lat")).alias("lat"),
        F.when(node, F.col("e.lon")).otherwise(F.col("e.center.lon")).alias("lon"),
        F.col("e.type").alias("kind"), F.col("e.id").alias("id"),
    )

"""Secrets told from examples by who else holds them.

Texts give candidates: assigned values, access keys and hex runs (the base, whose spans always stay), and any other long
token of mixed characters.  A candidate's hash is then counted over the whole corpus: how many distinct owners and
repositories hold it.  What several owners hold is a copied example; what looks random and stays with one owner looks
like a live credential.  Live tokens outside the base add their spans.

Offsets are summed inside the row from the lengths of matches and of the pieces between them, so no text is shuffled:
only hashes with their places move, and ownership is aggregated before it meets them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import let
from almanac.session import materialise


def either_case(word: str) -> str:
    """ASCII letters in either case, spelled out: engines fold other letters into (?i) differently."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # of one run only the first start can reach the length, so the bound may stand inside
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
TOKEN_KIND = KINDS.index("live")

PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234|abcd"
LEAST_DISTINCT = 8  # different characters of a value that looks random
COPIED_OWNERS, COPIED_REPOS = 3, 6  # from so many on, a value is a copied example
RUN = 256  # steps summed at a time


def running_sums(steps: Column, run: int = RUN) -> Column:
    """Inclusive running sums of an array, in runs, so that many steps cost little more than their number."""
    add = lambda a, v: a + v
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), add)
    last = F.floor((F.size(steps) - 1) / run).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(steps, k * run + 1, F.lit(run)))

    def summed(parts: Column) -> Column:
        return let(
            F.transform(parts, total),
            lambda totals: F.flatten(
                F.transform(
                    parts,
                    lambda part, k: let(
                        total(F.slice(totals, F.lit(1), k)),
                        lambda base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i + 1))),
                    ),
                )
            ),
        )

    return F.when(F.size(steps) > 0, let(runs, summed)).otherwise(F.array().cast("array<bigint>"))


def looks_random(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT
    return different & ~F.regexp_like(value, F.lit(PLACEHOLDER))


def mixed(value: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.regexp_like(value, F.lit(c)) for c in ("[A-Z]", "[a-z]", "[0-9]")])


def spans(text: Column, kind: int, pattern: str, value: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, hash, looks); ``keep`` judges the value of a match."""

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)).cast("bigint") + F.length(m))
        return let(
            steps,
            lambda s: let(
                running_sums(s),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"),
                        value(m).alias("value"),
                    ),
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = let(found, lambda f: let(F.when(F.size(f) > 0, F.split(text, pattern, -1)), lambda gaps: placed(f, gaps)))
    kept = F.filter(made, lambda m: keep(m["value"]))
    return F.transform(
        kept,
        lambda m: F.struct(m["start"], m["kind"], m["end"], F.sha2(m["value"], 256).alias("hash"), looks_random(m["value"]).alias("looks")),
    )


def candidates(docs: DataFrame, doc_id: str, text: str, owner: Column, repo: Column) -> DataFrame:
    """key, doc_id, owner, repo, base and tokens (arrays of spans) of every row; written, so the keys stay."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = lambda m: m
    any_value = lambda v: F.lit(True)
    base = F.concat(
        spans(body, 0, ASSIGN, lambda m: F.regexp_extract(m, ASSIGN, 2), lambda v: F.length(v) >= ASSIGN_LEAST),
        spans(body, 1, ACCESS, whole, any_value),
        spans(body, 2, HEX, whole, any_value),
    )
    tokens = spans(body, TOKEN_KIND, TOKEN, whole, lambda v: mixed(v) & looks_random(v))
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"), named(owner).alias("owner"),
        named(repo).alias("repo"), F.array_sort(base).alias("base"), tokens.alias("tokens"),
    )
    return materialise(rows, "secret_candidates")


def ownership(held: DataFrame) -> DataFrame:
    """hash, owners, repos: by how many distinct owners and repositories each candidate is held."""
    distinct = held.select("hash", "owner", "repo").distinct()
    return distinct.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))


def verdict(owners: Column, repos: Column, looks: Column) -> Column:
    """example, live or unsure."""
    copied = (owners >= COPIED_OWNERS) | (repos >= COPIED_REPOS)
    return F.when(copied, "example").when(looks & (owners == 1), "live").otherwise("unsure")


def judged(found: DataFrame) -> DataFrame:
    """key, start, kind, end, hash, owners, repos, verdict and added: one row per candidate of ``candidates``.

    A token is added if it is live and overlaps no base span.
    """
    held = found.select("key", "owner", "repo", F.explode(F.concat("base", "tokens")).alias("c")).select("key", "owner", "repo", "c.*")
    counts = materialise(ownership(held), "ownership")  # a read table, so Spark can split a crowded hash of the other side
    rows = held.join(counts, "hash").withColumn("verdict", verdict(F.col("owners"), F.col("repos"), F.col("looks")))
    is_base = F.col("kind") < TOKEN_KIND
    up, down = (Window.partitionBy("key").orderBy(o("start"), o("kind")) for o in (F.asc, F.desc))
    before = Window.unboundedPreceding
    reach = F.max(F.when(is_base, F.col("end"))).over(up.rowsBetween(before, -1))
    next_start = F.min(F.when(is_base, F.col("start"))).over(down.rowsBetween(before, -1))
    rows = rows.withColumn("_reach", reach).withColumn("_next", next_start)
    apart = (F.coalesce("_reach", F.col("start")) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    added = ~is_base & (F.col("verdict") == "live") & apart
    return rows.select("key", "start", "kind", "end", "hash", "owners", "repos", "verdict", added.alias("added"))


def _written(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def scan(docs: DataFrame, doc_id: str, text: str, owner: Column, repo: Column) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of every row.

    A null text is empty; rows that repeat or share an id stay rows of their own and count once for their repository.
    Null owners are one owner, null repositories one repository.  An empty table gives no rows; other columns are ignored.
    """
    found = candidates(docs, doc_id, text, owner, repo)
    rows = judged(found)
    counted = (F.col("kind") < TOKEN_KIND) | F.col("added")
    told = rows.groupBy("key").agg(
        F.collect_list(F.when(F.col("added"), F.struct("start", "kind", "end"))).alias("more"),  # bounded by the text
        F.count_if(counted & (F.col("verdict") == "live")).alias("n_live"),
        F.count_if(counted & (F.col("verdict") == "example")).alias("n_example"),
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    places = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    every = F.when(F.size("more") > 0, F.array_sort(F.concat(places, F.col("more")))).otherwise(places)
    none = F.lit(0).cast("bigint")
    return found.join(told, "key", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_example", none).alias("n_example"),
    )

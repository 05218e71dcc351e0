"""Race and candidate tables, winners and party shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.addresses import district_id
from almanac.operators.upsert import first_per_key

# Party names that count for one side.
DEMOCRATIC = (
    "democrat", "democratic", "democratic-farmer-labor", "democratic-farm-labor", "democratic-nonpartisan league",
    "democratic-npl",
)
REPUBLICAN = ("republican",)


def truth(col: Column, accepted: Sequence[str] = ("true", "1", "yes")) -> Column:
    return F.lower(F.coalesce(col.cast("string"), F.lit(""))).isin(*accepted)


def normalise_races(rows: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Race rows (first per district, year, stage and mode) and candidate rows with a vote share.

    Expects the text columns state, district, year, stage, mode, totalvotes, candidate, party, candidatevotes.
    """
    text = lambda c, d: F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)))
    whole = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double").cast("bigint"), F.lit(0))
    clean = rows.select(
        seq,
        district_id(F.col("state"), F.trim(F.col("district").cast("string"))).alias("district_id"),
        F.col("year").cast("int").alias("year"),
        text("stage", "gen").alias("stage"), text("mode", "total").alias("mode"),
        whole("totalvotes").alias("totalvotes"), "candidate", F.lower("party").alias("party"), whole("candidatevotes").alias("candidatevotes"),
    )
    key = ["district_id", "year", "stage", "mode"]
    races = first_per_key(clean.select(seq, *key, "totalvotes"), key, [seq]).drop(seq)
    share = F.round(F.col("candidatevotes") / F.nullif(F.col("totalvotes"), F.lit(0)), 6)
    return races, clean.select(*key, "candidate", "party", "candidatevotes", share.alias("vote_share"))


def winners(
    candidates: DataFrame, race: Sequence[str], score: str, ties: str = "all", reject_nulls: bool = False, ids: Sequence[str] = ()
) -> DataFrame:
    """Candidates that rank first in their race.

    Nulls rank first under a falling sort, as in the source database, unless rejected.
    ``ties="one"`` keeps one row per race (the smallest by ``ids``).
    """
    df = candidates.where(F.col(score).isNotNull()) if reject_nulls else candidates
    order = Window.partitionBy(*race).orderBy(F.col(score).desc_nulls_first(), *(ids if ties == "one" else ()))
    place = F.row_number() if ties == "one" else F.rank()
    return df.withColumn("_rank", place.over(order)).where(F.col("_rank") == 1).drop("_rank")


def party_side(party: Column, dem: Sequence[str] = DEMOCRATIC, rep: Sequence[str] = REPUBLICAN) -> Column:
    p = F.lower(F.trim(party))
    return F.when(p.isin(*dem), "Dem").when(p.isin(*rep), "Rep")


def two_party_share(candidates: DataFrame, by: Sequence[str], party: str, votes: str, dem: str, rep: str) -> DataFrame:
    """First party's share of the two-party vote; uncontested races drop out since a missing sum stays null."""
    d = F.sum(F.when(F.col(party) == dem, F.col(votes))).alias("dem")
    r = F.sum(F.when(F.col(party) == rep, F.col(votes))).alias("rep")
    out = candidates.groupBy(*by).agg(d, r).where(F.col("dem") + F.col("rep") > 0)
    share = F.col("dem") / (F.col("dem") + F.col("rep"))
    return out.withColumn("share", share).withColumn("winner", F.when(share > 0.5, dem).otherwise(rep))


def best_rate_by_winner(rates: DataFrame, candidates: DataFrame, district: str, rate: str, share: str) -> DataFrame:
    """Average rate per district beside the candidate with the top share; the maximum is a windowed one."""
    top = F.max(share).over(Window.partitionBy(district))
    won = candidates.withColumn("_top", top).where(F.col(share) == F.col("_top")).drop("_top")
    per = rates.groupBy(district).agg(F.avg(rate).alias("mean_rate"))
    return per.join(won, district)

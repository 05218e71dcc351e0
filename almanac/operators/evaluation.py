"""Agreement of labels with human truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.addresses import lookup
from almanac.operators.sampling import seeded_sample


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    t, p = truth, predicted
    return df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )


def binary_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 when undefined), accuracy and kappa from the four counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    out = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    out = out.withColumn("f1", _ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))
    out = out.withColumn("accuracy", _ratio(tp + tn, n))
    chance = _ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return out.withColumn("kappa", _ratio(F.col("accuracy") - chance, 1 - chance))


def kappa_strength(kappa: Column) -> Column:
    return (
        F.when(kappa >= 0.80, "almost perfect").when(kappa >= 0.60, "substantial").when(kappa >= 0.40, "moderate")
        .when(kappa >= 0.20, "fair").otherwise("slight")
    )


def cohen_kappa(df: DataFrame, a: str, b: str, labels: Sequence | None = None) -> DataFrame:
    """Two raters, any number of labels; expected agreement from the marginals."""
    rows = df if labels is None else df.where(F.col(a).isin(*labels) & F.col(b).isin(*labels))
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    margin = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}"))
    chance = margin("a").join(margin("b"), "label").agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).scalar()
    total = F.sum("n").cast("double")
    out = cells.agg(
        F.sum("n").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / total).alias("observed"),
        (F.coalesce(F.max(chance), F.lit(0.0)) / (total * total)).alias("expected"),
    )
    k = F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).otherwise(1.0)
    return out.withColumn("kappa", k).withColumn("strength", kappa_strength(F.col("kappa")))


def confusion_matrix(df: DataFrame, a: str, b: str, labels: Sequence) -> DataFrame:
    """Counts of b's labels per label of a, and the share where b agrees."""
    cells = [F.count_if(F.col(b) == v).alias(f"b_{v}") for v in labels]
    agree = F.count_if(F.col(a) == F.col(b))
    return df.where(F.col(a).isin(*labels) & F.col(b).isin(*labels)).groupBy(a).agg(*cells, (agree / F.count("*")).alias("recall"))


def fleiss_kappa(df: DataFrame, raters: Sequence[str], labels: Sequence) -> DataFrame:
    """Agreement of several raters on the same items; items with an invalid label drop out.

    Label counts per item are taken inside the row, so one aggregate is enough.
    """
    k = len(raters)
    valid = df
    for r in raters:
        valid = valid.where(F.col(r).isin(*labels))
    counts = []
    for v in labels:
        c = F.lit(0)
        for r in raters:
            c = c + (F.col(r) == v).cast("int")
        counts.append(c)
    squares = F.lit(0)
    for c in counts:
        squares = squares + c * c
    sums = valid.agg(F.count("*").alias("n"), F.avg((squares - k) / (k * (k - 1))).alias("p_bar"), *[F.sum(c).alias(f"_c{i}") for i, c in enumerate(counts)])
    chance = F.lit(0.0)
    for i in range(len(labels)):
        chance = chance + F.pow(F.col(f"_c{i}") / (F.col("n") * k), 2)
    out = sums.select("n", "p_bar", chance.alias("p_e"))
    return out.withColumn("kappa", (F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")))


def recall_per_category(df: DataFrame, categories: Sequence[str], predicted: Column) -> DataFrame:
    """Of the items coded with a category, how many the filter kept."""
    marked = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("coded")) for c in categories])
    long = df.select(F.explode(marked).alias("m"), predicted.alias("hit")).where("m.coded")
    return long.groupBy(F.col("m.category").alias("category")).agg(
        F.count("*").alias("n"), F.count_if("hit").alias("found"), (F.count_if("hit") / F.count("*")).alias("recall")
    )


def set_agreement(
    pages: DataFrame, first: DataFrame, second: DataFrame, page: str, label: str, coarse: Mapping[str, str] | None = None
) -> DataFrame:
    """How two label sets of each page relate: both_none, first_only, second_only, agree_overlap or disjoint.

    Sets are compared by counting (page, label) rows, so no page collects its labels.
    """
    at = (lambda d: d.withColumn(label, lookup(F.col(label), coarse))) if coarse else (lambda d: d)
    a = at(first.select(page, label)).distinct().withColumn("_a", F.lit(1))
    b = at(second.select(page, label)).distinct().withColumn("_b", F.lit(1))
    per = a.join(b, [page, label], "full_outer").groupBy(page).agg(
        F.count("_a").alias("na"), F.count("_b").alias("nb"), F.count(F.col("_a") + F.col("_b")).alias("both")
    )
    out = pages.select(page).distinct().join(per, page, "left").na.fill(0, ["na", "nb", "both"])
    bucket = (
        F.when((F.col("na") == 0) & (F.col("nb") == 0), "both_none").when(F.col("nb") == 0, "first_only")
        .when(F.col("na") == 0, "second_only").when(F.col("both") > 0, "agree_overlap").otherwise("disjoint")
    )
    return out.select(page, "na", "nb", bucket.alias("bucket"))


def agreement_summary(per_page: DataFrame) -> DataFrame:
    agree, both = F.count_if(F.col("bucket") == "agree_overlap"), F.count_if(F.col("bucket").isin("agree_overlap", "disjoint"))
    none = F.count_if(F.col("bucket") == "both_none")
    return per_page.agg(
        F.count("*").alias("n"), agree.alias("agree"), (agree / F.count("*")).alias("share"),
        ((agree + none) / F.count("*")).alias("share_with_none"), F.try_divide(agree, both).alias("share_both_coded"),
    )


def disagreement_sample(df: DataFrame, truth: Column, predicted: Column, key: str, n: int, kind: str, seed: int = 42) -> DataFrame:
    """Seeded sample of false positives (``fp``) or false negatives (``fn``)."""
    wrong = ~truth & predicted if kind == "fp" else truth & ~predicted
    return seeded_sample(df.where(wrong), key, n, seed).withColumn("kind", F.lit(kind))


def outcome_rates(df: DataFrame, truth: str, positive: Column) -> DataFrame:
    """How often a run says positive, negative or nothing, by truth."""
    return df.groupBy(truth).agg(
        F.count("*").alias("n"), F.avg(positive.cast("int")).alias("positive_rate"), F.avg((~positive).cast("int")).alias("negative_rate")
    )


def truth_map(codes: DataFrame, key: str, seq: str, marks: Sequence[str]) -> DataFrame:
    """Key -> positive when any mark is true; the last row per key wins."""
    positive = F.lit(False)
    for m in marks:
        positive = positive | (F.upper(F.trim(F.coalesce(F.col(m).cast("string"), F.lit("")))) == "TRUE")
    return codes.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max_by(positive, seq).alias("positive"))

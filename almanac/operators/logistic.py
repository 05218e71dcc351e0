"""Unpenalised logistic regression by Newton steps on sufficient statistics: one aggregate of the rows a step.

Several models are fitted in the same passes, each on its own part of the rows (the folds of a cross-validation).  Only the
gradient and the information matrix of each, as many numbers as columns squared, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.dist import chi2_p, normal_two_sided
from almanac.operators.ranks import row_number_within
from almanac.operators.sampling import hash_order
from almanac.operators.statistics import standardise
from almanac.session import materialise

STEPS, STILL = 25, 1e-10


@dataclass(frozen=True)
class Fit:
    """Coefficients (the constant first) and their covariance."""

    beta: np.ndarray
    covariance: np.ndarray

    def probability(self, x: Sequence[Column]) -> Column:
        score = F.lit(float(self.beta[0]))
        for b, c in zip(self.beta[1:], x, strict=True):
            score = score + F.lit(float(b)) * c
        return 1.0 / (1.0 + F.exp(-score))


def newton(rows: DataFrame, y: Column, x: Sequence[Sequence[Column]], of: Sequence[Column], steps: int = STEPS) -> list[Fit]:
    """One fit per condition in ``of``, on the rows that meet it and its own columns ``x``.

    Starts at zero and ends when no coefficient of any model moves any more; a direction that the rows do not decide
    (collinear columns) takes the smallest step.
    """
    width = len(x[0]) + 1
    fits = [Fit(np.zeros(width), np.zeros((width, width))) for _ in of]
    for _ in range(steps):
        sums = []
        for m, (fit, columns, mine) in enumerate(zip(fits, x, of, strict=True)):
            each = [F.lit(1.0), *columns]
            p = fit.probability(columns)
            add = lambda v, name, mine=mine: F.sum(F.when(mine, v)).alias(name)
            sums += [add((y - p) * each[i], f"g{m}_{i}") for i in range(width)]
            sums += [add(p * (1.0 - p) * each[i] * each[j], f"h{m}_{i}_{j}") for i in range(width) for j in range(i + 1)]
        row = rows.agg(*sums).first()
        moved = 0.0
        for m, fit in enumerate(fits):
            gradient = np.array([row[f"g{m}_{i}"] or 0.0 for i in range(width)])
            information = np.array([[row[f"h{m}_{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(width)] for i in range(width)])
            covariance = np.linalg.pinv(information, rcond=1e-12)
            step = covariance @ gradient
            fits[m] = Fit(fit.beta + step, covariance)
            moved = max(moved, float(np.abs(step).max()))
        if moved <= STILL:
            break
    return fits


def logistic_fit(df: DataFrame, y: str, columns: Sequence[str]) -> tuple[Fit, DataFrame]:
    """The fit on z-scored columns, and the rows with z-scores and ``prediction``."""
    ready = materialise(standardise(df, columns), "standardised")
    x = [F.col(c) for c in columns]
    (fit,) = newton(ready, F.col(y).cast("double"), [x], [F.lit(True)])
    return fit, ready.withColumn("prediction", fit.probability(x))


def logistic_table(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Coefficient, standard error, p, odds ratio per standard deviation and its 95 % interval per feature."""
    fit, _ = logistic_fit(df, y, columns)
    names, order = [*columns, "const"], [*range(1, len(columns) + 1), 0]
    rows = []
    for name, i in zip(names, order, strict=True):
        b, se = float(fit.beta[i]), math.sqrt(max(0.0, float(fit.covariance[i, i])))
        p = normal_two_sided(b / se) if se else None
        rows.append((name, b, se, p, math.exp(b), math.exp(b - 1.96 * se), math.exp(b + 1.96 * se)))
    return df.sparkSession.createDataFrame(rows, "feature string, coef double, se double, p double, odds_ratio double, or_low double, or_high double")


def likelihood_ratio(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Log-likelihoods of the fitted and the constant model, their ratio test and McFadden's R2."""
    _, scored = logistic_fit(df, y, columns)
    eps = 1e-12
    t, p = F.col(y).cast("double"), F.col("prediction")
    p0 = F.avg(t)
    out = scored.agg(
        F.count("*").alias("n"), F.sum(t * F.ln(p + eps) + (1 - t) * F.ln(1 - p + eps)).alias("ll_full"),
        (F.sum(t) * F.ln(p0 + eps) + (F.count("*") - F.sum(t)) * F.ln(1 - p0 + eps)).alias("ll_null"),
    )
    out = out.withColumn("lr_chi2", 2 * (F.col("ll_full") - F.col("ll_null"))).withColumn("mcfadden", 1 - F.col("ll_full") / F.col("ll_null"))
    return out.withColumn("p", chi2_p("lr_chi2", F.lit(len(columns))))


def out_of_fold(df: DataFrame, y: str, columns: Sequence[str], key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(key, y, fold, prediction): folds are dealt inside each class by a seeded hash of the key, models are scaled and
    fitted without the fold they predict, all of them in the same passes."""
    dealt = row_number_within(df.withColumn("_o", hash_order(key, seed)), [y], "_o", "_n", ties=[key])
    dealt = materialise(dealt.withColumn("fold", (F.col("_n") % folds).cast("int")).drop("_o", "_n"), "folds")
    train = [F.col("fold") != f for f in range(folds)]
    stats = [g(F.when(t, F.col(c))).alias(f"{n}{f}_{c}") for f, t in enumerate(train) for c in columns for g, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    scale = dealt.agg(*stats).first()
    z = [[(F.col(c) - scale[f"m{f}_{c}"]) / scale[f"s{f}_{c}"] for c in columns] for f in range(folds)]
    fits = newton(dealt, F.col(y).cast("double"), z, train)
    told = F.lit(None).cast("double")
    for f, fit in enumerate(fits):
        told = F.when(F.col("fold") == f, fit.probability(z[f])).otherwise(told)
    return dealt.select(key, y, "fold", told.alias("prediction"))

"""Newton fits against a plain loop, and their predictions out of fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import logistic, modelling


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [3.0, 0.2] + [10.0, -1.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 * (x[:, 0] - 10) - 5 * (x[:, 1] + 1) + 0.3)))).astype(int)
    return x, y


def plain(x, y):
    z = np.c_[np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)]
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        info = (z * (p * (1 - p))[:, None]).T @ z
        b = b + np.linalg.solve(info, z.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(info))), p


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y int")


def test_table_equals_plain_newton(spark):
    x, y = data()
    beta, se, p = plain(x, y)
    got = {r["feature"]: r for r in logistic.logistic_table(frame(spark, x, y).repartition(5), "y", ["a", "b"]).collect()}
    for name, i in (("const", 0), ("a", 1), ("b", 2)):
        assert got[name]["coef"] == pytest.approx(beta[i]) and got[name]["se"] == pytest.approx(se[i])
        assert got[name]["odds_ratio"] == pytest.approx(np.exp(beta[i])) and got[name]["or_high"] == pytest.approx(np.exp(beta[i] + 1.96 * se[i]))
    ratio = logistic.likelihood_ratio(frame(spark, x, y), "y", ["a", "b"]).first()
    assert ratio["ll_full"] == pytest.approx((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def test_models_of_parts_are_fitted_together(spark):
    x, y = data()
    half = np.arange(400) % 2 == 0
    df = frame(spark, (x - x.mean(axis=0)) / x.std(axis=0), y)
    cols = [F.col("a"), F.col("b")]
    fits = logistic.newton(df, F.col("y").cast("double"), [cols] * 2, [F.col("id") % 2 == 0, F.col("id") % 2 == 1])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for fit, mine in zip(fits, (half, ~half)):
        a = np.c_[np.ones(mine.sum()), z[mine]]
        p = 1 / (1 + np.exp(-a @ fit.beta))
        assert np.abs(a.T @ (y[mine] - p)).max() < 1e-7  # the gradient vanishes
    both = df.withColumn("c", F.col("a"))  # collinear columns end with a finite answer
    (fit,) = logistic.newton(both, F.col("y").cast("double"), [[F.col("a"), F.col("c")]], [F.lit(True)])
    assert np.isfinite(fit.beta).all() and fit.beta[1] == pytest.approx(fit.beta[2])


def test_out_of_fold_predictions(spark):
    x, y = data()
    rows = logistic.out_of_fold(frame(spark, x, y), "y", ["a", "b"], "id").orderBy("id").collect()
    fold = np.array([r["fold"] for r in rows])
    for f in range(5):
        train = fold != f
        assert abs((fold == f).sum() - 80) <= 2 and abs(y[fold == f].mean() - y.mean()) < 0.02  # dealt inside each class
        beta, _, _ = plain(x[train], y[train])
        z = np.c_[np.ones((~train).sum()), (x[~train] - x[train].mean(axis=0)) / x[train].std(axis=0)]
        assert [r["prediction"] for r in rows if r["fold"] == f] == pytest.approx(1 / (1 + np.exp(-z @ beta)))
    told = modelling.cross_validate(frame(spark, x, y), "y", ["a", "b"], "id").first()
    p = np.array([r["prediction"] for r in rows])
    assert told["accuracy"] == pytest.approx(((p >= 0.5) == (y == 1)).mean()) and told["n"] == 400
    auc = ((p[y == 1][:, None] > p[y == 0][None]) + 0.5 * (p[y == 1][:, None] == p[y == 0][None])).mean()
    assert told["auc"] == pytest.approx(auc)

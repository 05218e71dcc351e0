"""Queries for evaluation (E) and modelling (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac import presets
from almanac.functions.geo import fit_zoom, mercator_pixel
from almanac.operators import clusters, elections, evaluation, logistic, modelling, sampling
from almanac.plans import tables as t
from almanac.plans.aggregate_plans import CATS, CLICK_SQL, per_entity, rounded
from almanac.plans.registry import query
from almanac.plans.statistics_plans import chi2_p_sql, normal_p_sql
from almanac.plans.tables import table, with_views
from almanac.session import materialise

# ---- E ---------------------------------------------------------------------

SCORES_SQL = """precision_ AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
        (tp + tn) / (tp + fp + fn + tn) AS accuracy, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / pow(tp + fp + fn + tn, 2) AS pe FROM k)"""
COUNTS_SQL = """k AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp,
        count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn FROM rating)"""


def scores(spark, sf):
    return evaluation.binary_scores(evaluation.confusion_counts(t.rating(spark, sf), F.col("a") == 1, F.col("b") == 1))


@query(
    "e01_filter_scores",
    with_views(
        "rating",
        f"""+ {COUNTS_SQL}, {SCORES_SQL} SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(accuracy, 6) AS accuracy FROM precision_""",
    ),
)
def e01(spark, sf):
    return rounded(scores(spark, sf).drop("kappa"), "precision", "recall", "f1", "accuracy")


@query("e02_binary_kappa", with_views("rating", f"+ {COUNTS_SQL}, {SCORES_SQL} SELECT round((accuracy - pe) / (1 - pe), 6) AS kappa FROM precision_"))
def e02(spark, sf):
    return scores(spark, sf).select(F.round("kappa", 6).alias("kappa"))


RATERS_SQL = """r AS (SELECT doc_id, ['x', 'y', 'z'][(a * 2 + c + doc_id % 2) % 3 + 1] AS l1, ['x', 'y', 'z'][(a * 2 + b + doc_id % 2) % 3 + 1] AS l2,
        ['x', 'y', 'z'][(a + b + c) % 3 + 1] AS l3 FROM rating)"""


def raters(spark, sf):
    pick = lambda e: F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (e % 3 + 1).cast("int"))
    a, b, c, odd = F.col("a"), F.col("b"), F.col("c"), F.col("doc_id") % 2
    return t.rating(spark, sf).select(
        "doc_id", pick(a * 2 + c + odd).alias("l1"), pick(a * 2 + b + odd).alias("l2"), pick(a + b + c).alias("l3"), "lang"
    )


@query(
    "e03_label_kappa",
    with_views(
        "rating",
        f"""+ {RATERS_SQL}, o AS (SELECT count(*) AS n, avg((l1 = l2)::INT) AS observed FROM r),
        m AS (SELECT sum(x.c * y.c) AS s FROM (SELECT l1 AS l, count(*)::DOUBLE AS c FROM r GROUP BY 1) x JOIN (SELECT l2 AS l, count(*)::DOUBLE AS c FROM r GROUP BY 1) y USING (l)),
        k AS (SELECT n, observed, s / (n * n::DOUBLE) AS expected FROM o, m)
        SELECT n, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa,
        CASE WHEN (observed - expected) / (1 - expected) >= 0.8 THEN 'almost perfect' WHEN (observed - expected) / (1 - expected) >= 0.6 THEN 'substantial'
        WHEN (observed - expected) / (1 - expected) >= 0.4 THEN 'moderate' WHEN (observed - expected) / (1 - expected) >= 0.2 THEN 'fair' ELSE 'slight' END AS strength FROM k""",
    ),
)
def e03(spark, sf):
    return rounded(evaluation.cohen_kappa(raters(spark, sf), "l1", "l2"), "observed", "expected", "kappa")


@query(
    "e04_confusion_matrix",
    with_views(
        "rating",
        f"""+ {RATERS_SQL} SELECT l1, count(*) FILTER (l2 = 'x') AS b_x, count(*) FILTER (l2 = 'y') AS b_y, count(*) FILTER (l2 = 'z') AS b_z,
        round(avg((l1 = l2)::INT), 6) AS recall FROM r GROUP BY l1""",
    ),
)
def e04(spark, sf):
    return rounded(evaluation.confusion_matrix(raters(spark, sf), "l1", "l2", ["x", "y", "z"]), "recall")


@query(
    "e05_fleiss_kappa",
    with_views(
        "rating",
        f"""+ {RATERS_SQL}, l AS (SELECT doc_id, unnest([l1, l2, l3]) AS v FROM r), c AS (SELECT doc_id, v, count(*) AS n FROM l GROUP BY ALL),
        p AS (SELECT avg(s) AS p_bar, count(*) AS n FROM (SELECT doc_id, (sum(n * n) - 3) / 6.0::DOUBLE AS s FROM c GROUP BY doc_id)),
        e AS (SELECT sum(pow(x / (SELECT count(*) FROM l)::DOUBLE, 2)) AS p_e FROM (SELECT count(*) AS x FROM l GROUP BY v))
        SELECT n, round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round((p_bar - p_e) / (1 - p_e), 6) AS kappa FROM p, e""",
    ),
)
def e05(spark, sf):
    return rounded(evaluation.fleiss_kappa(raters(spark, sf), ["l1", "l2", "l3"], ["x", "y", "z"]), "p_bar", "p_e", "kappa")


@query(
    "e06_recall_per_category",
    with_views(
        "rating",
        """SELECT 'a' AS category, count(*) AS n, count(*) FILTER (lang = 'en') AS found, round(avg((lang = 'en')::INT), 6) AS recall FROM rating WHERE a = 1
        UNION ALL SELECT 'b', count(*), count(*) FILTER (lang = 'en'), round(avg((lang = 'en')::INT), 6) FROM rating WHERE b = 1
        UNION ALL SELECT 'c', count(*), count(*) FILTER (lang = 'en'), round(avg((lang = 'en')::INT), 6) FROM rating WHERE c = 1""",
    ),
)
def e06(spark, sf):
    coded = t.rating(spark, sf).select(*[(F.col(c) == 1).alias(c) for c in "abc"], "lang")
    return rounded(evaluation.recall_per_category(coded, ["a", "b", "c"], F.col("lang") == "en"), "recall")


SETS_SQL = """a AS (SELECT DISTINCT user_id, event_type AS l FROM events WHERE value > 55),
    b AS (SELECT DISTINCT user_id, event_type AS l FROM events WHERE value < 1.2),
    pg AS (SELECT DISTINCT user_id FROM events)"""


def label_sets(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("l"), "value")
    return e.select("user_id"), e.where("value > 55"), e.where("value < 1.2")


def agreement_sql(a: str, b: str) -> str:
    return f"""ca AS (SELECT user_id, count(*) AS na FROM {a} GROUP BY 1), cb AS (SELECT user_id, count(*) AS nb FROM {b} GROUP BY 1),
    cc AS (SELECT user_id, count(*) AS nc FROM {a} JOIN {b} USING (user_id, l) GROUP BY 1),
    j AS (SELECT user_id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc FROM pg LEFT JOIN ca USING (user_id)
        LEFT JOIN cb USING (user_id) LEFT JOIN cc USING (user_id)),
    ag AS (SELECT user_id, na, nb, CASE WHEN na = 0 AND nb = 0 THEN 'both_none' WHEN nb = 0 THEN 'first_only' WHEN na = 0 THEN 'second_only'
        WHEN nc > 0 THEN 'agree_overlap' ELSE 'disjoint' END AS bucket FROM j)"""


@query("e07_set_agreement", f"WITH {SETS_SQL}, {agreement_sql('a', 'b')} SELECT * FROM ag")
def e07(spark, sf):
    return evaluation.set_agreement(*label_sets(spark, sf), "user_id", "l")


COARSE = {"click": "use", "view": "use", "purchase": "use", "signup": "join", "error": "fail"}
COARSE_SQL = "CASE l WHEN 'signup' THEN 'join' WHEN 'error' THEN 'fail' ELSE 'use' END"


@query(
    "e07_coarse_agreement",
    f"""WITH {SETS_SQL}, a2 AS (SELECT DISTINCT user_id, {COARSE_SQL} AS l FROM a), b2 AS (SELECT DISTINCT user_id, {COARSE_SQL} AS l FROM b),
    {agreement_sql('a2', 'b2')}
    SELECT count(*) AS n, count(*) FILTER (bucket = 'agree_overlap') AS agree, round(avg((bucket = 'agree_overlap')::INT), 6) AS share,
    round(avg((bucket IN ('agree_overlap', 'both_none'))::INT), 6) AS share_with_none,
    round(count(*) FILTER (bucket = 'agree_overlap') / count(*) FILTER (bucket IN ('agree_overlap', 'disjoint')), 6) AS share_both_coded FROM ag""",
)
def e07_coarse(spark, sf):
    out = evaluation.agreement_summary(evaluation.set_agreement(*label_sets(spark, sf), "user_id", "l", COARSE))
    return rounded(out, "share", "share_with_none", "share_both_coded")


@query(
    "e08_disagreement_sample",
    with_views(
        "rating",
        """(SELECT doc_id, 'fp' AS kind FROM rating WHERE a = 0 AND b = 1 ORDER BY md5(doc_id || ':42'), doc_id LIMIT 5) UNION ALL
        (SELECT doc_id, 'fn' FROM rating WHERE a = 1 AND b = 0 ORDER BY md5(doc_id || ':42'), doc_id LIMIT 20)""",
    ),
)
def e08(spark, sf):
    r = t.rating(spark, sf)
    a, b = F.col("a") == 1, F.col("b") == 1
    part = lambda kind, n: evaluation.disagreement_sample(r, a, b, "doc_id", n, kind).select("doc_id", "kind")
    return part("fp", 5).unionByName(part("fn", 20))


@query(
    "e09_outcome_rates",
    with_views(
        "rating",
        """SELECT a, count(*) AS n, round(avg(c), 6) AS positive_rate, round(avg(1 - c), 6) AS negative_rate FROM rating GROUP BY a""",
    ),
)
def e09(spark, sf):
    return rounded(evaluation.outcome_rates(t.rating(spark, sf), "a", F.col("c") == 1), "positive_rate", "negative_rate")


@query(
    "e10_truth_map",
    """SELECT user_id AS key, arg_max(event_type = 'error' OR value > 40, event_id) AS positive FROM events GROUP BY user_id""",
)
def e10(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), "event_id",
        F.when(F.col("event_type") == "error", " true").otherwise("FALSE").alias("m1"), (F.col("value") > 40).alias("m2"),
    )
    return evaluation.truth_map(e, "key", "event_id", ["m1", "m2"]).withColumn("key", F.col("key").cast("bigint"))


# ---- M ---------------------------------------------------------------------

ORDER = ["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"]


def raw_features(spark, sf):
    """Entities with at least one action, their counts, group and district lean."""
    votes = t.race(spark, sf).groupBy("district", "party").agg(F.sum("votes").alias("votes"))
    won = elections.winners(votes, ["district"], "votes", "one", ids=["party"]).select(
        F.col("district").alias("state"), elections.party_side(F.col("party"), ("building", "household"), ("machinery",)).alias("lean")
    )
    rows = per_entity(spark, sf).where("n > 0").join(won, "state", "left")
    return rows.select("entity_id", *CATS, "grp", "lean")


def features(spark, sf):
    return modelling.feature_table(raw_features(spark, sf), CATS, "grp", ORDER, "lean")


FEATURES = [*CATS, "total", "group_rank", "lean_score"]

FEATURE_SQL = """v AS (SELECT district, party, sum(votes) AS votes FROM race GROUP BY ALL),
        w AS (SELECT district AS state, party FROM v QUALIFY row_number() OVER (PARTITION BY district ORDER BY votes DESC, party) = 1),
        f AS (SELECT entity_id, click, error, purchase, signup, n AS total, CASE grp WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1
            WHEN 'HOUSEHOLD' THEN 2 WHEN 'FURNITURE' THEN 3 ELSE 4 END AS group_rank,
            CASE WHEN party IN ('BUILDING', 'HOUSEHOLD') THEN 1 WHEN party = 'MACHINERY' THEN -1 ELSE 0 END AS lean_score
            FROM s JOIN entity USING (entity_id) LEFT JOIN w USING (state) WHERE n > 0)"""


def _z(c: str) -> str:
    return f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6)"


@query(
    "m03_feature_table",
    with_views(
        "action entity race",
        f"""+ {CLICK_SQL}, {FEATURE_SQL}
        SELECT entity_id, {', '.join(f'{_z(c)} AS {c}' for c in FEATURES)} FROM f""",
    ),
)
def m03(spark, sf):
    return rounded(features(spark, sf).select("entity_id", *FEATURES), *FEATURES)


@query("m01_kmeans_sweep")
def m01(spark, sf):
    return clusters.sweep(features(spark, sf), FEATURES, enough=presets.SILHOUETTE_OK)[0]


@query("m01_cluster_profiles")
def m01_profiles(spark, sf):
    _, rows = clusters.sweep(features(spark, sf), FEATURES)
    return modelling.cluster_profiles(rows, CATS, "grp", "lean")


def _quality_sql() -> str:
    """All pairs of the feature rows, by two given clusterings."""
    x = f"[{', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()' for c in FEATURES)}]"
    centre = f"[{', '.join(f'avg(x[{i + 1}])' for i in range(len(FEATURES)))}]"
    return f"""+ {CLICK_SQL}, {FEATURE_SQL}, x AS (SELECT entity_id, {x} AS x, CAST(group_rank AS INT) AS g, CAST(lean_score + 1 AS INT) AS l FROM f),
        lab AS (SELECT 'by_group' AS clustering, entity_id, x, g AS c FROM x UNION ALL SELECT 'by_lean', entity_id, x, l FROM x),
        n AS (SELECT clustering, c, count(*) AS n, {centre} AS m FROM lab GROUP BY ALL),
        d AS (SELECT a.clustering, a.entity_id, a.c, b.c AS o, sum(list_distance(a.x, b.x)) AS s, sum(pow(list_distance(a.x, b.x), 2)) AS q
            FROM lab a JOIN lab b USING (clustering) GROUP BY ALL),
        ab AS (SELECT d.clustering, entity_id, max(s / nullif(n - 1, 0)) FILTER (o = d.c) AS a, min(s / n) FILTER (o <> d.c) AS b,
            max(q / nullif(n - 1, 0)) FILTER (o = d.c) AS qa, min(q / n) FILTER (o <> d.c) AS qb
            FROM d JOIN n ON n.clustering = d.clustering AND n.c = d.o GROUP BY ALL),
        sil AS (SELECT clustering, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette,
            avg(coalesce((qb - qa) / greatest(qa, qb), 0)) AS silhouette_sq FROM ab GROUP BY clustering),
        sp AS (SELECT lab.clustering, lab.c, any_value(m) AS m, avg(list_distance(x, m)) AS s FROM lab JOIN n USING (clustering, c) GROUP BY ALL),
        db AS (SELECT clustering, avg(w) AS davies_bouldin FROM (SELECT a.clustering, a.c, max((a.s + b.s) / list_distance(a.m, b.m)) AS w
            FROM sp a JOIN sp b ON a.clustering = b.clustering AND a.c <> b.c GROUP BY ALL) GROUP BY clustering)
        SELECT clustering, round(silhouette, 6) AS silhouette, round(silhouette_sq, 6) AS silhouette_sq, round(davies_bouldin, 6) AS davies_bouldin
        FROM sil JOIN db USING (clustering)"""


@query("m01_given_clusters", with_views("action entity race", _quality_sql()))
def m01_given(spark, sf):
    """Quality of two given clusterings of the feature rows; without a tolerance, so the mean distances are exact."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col("grp")) - 1, F.lit(-1)).cast("int")
    side = F.when(F.col("lean") == "Dem", 2).when(F.col("lean") == "Rep", 0).otherwise(1)
    rows = raw_features(spark, sf).select("entity_id", F.when(rank < 0, len(ORDER)).otherwise(rank).alias("by_group"), side.alias("by_lean"))
    rows = materialise(features(spark, sf).select("entity_id", *FEATURES).join(rows, "entity_id"), "features")
    found = clusters.quality(rows, FEATURES, ["by_group", "by_lean"], tolerance=0.0)
    out = [(name, q.silhouette, q.silhouette_sq, q.davies_bouldin) for name, q in found.items()]
    out = spark.createDataFrame(out, "clustering string, silhouette double, silhouette_sq double, davies_bouldin double")
    return rounded(out, "silhouette", "silhouette_sq", "davies_bouldin")


@query("m02_davies_bouldin")
def m02(spark, sf):
    return clusters.centre_quality(features(spark, sf), FEATURES)


def _pca_sql() -> str:
    """The two leading eigenvectors of the covariance by power iteration, the second after the first is taken out."""
    d = len(FEATURES)
    x = f"[{', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()' for c in FEATURES)}]"
    matrix = f"[{', '.join('[' + ', '.join(f'avg(x[{i + 1}] * x[{j + 1}])' for j in range(d)) + ']' for i in range(d))}]"
    start = f"[{', '.join(f'{1 + 0.37 * i}::DOUBLE' for i in range(d))}]"
    power = lambda name, of: f"""{name}_it AS (SELECT 0 AS k, {start} AS v, 0.0::DOUBLE AS size UNION ALL
            SELECT k + 1, list_transform(w, lambda z: z / sqrt(list_dot_product(w, w))), sqrt(list_dot_product(w, w))
            FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM {name}_it, {of} WHERE k < 1500)),
        {name}_raw AS (SELECT v, size FROM {name}_it WHERE k = 1500),
        {name} AS (SELECT size, CASE WHEN list_max(list_transform(v, lambda z: abs(z))) = list_max(v) THEN v
            ELSE list_transform(v, lambda z: -z) END AS v FROM {name}_raw)"""  # noqa: E731
    return f"""+ {CLICK_SQL}, {FEATURE_SQL}, x AS MATERIALIZED (SELECT entity_id, {x} AS x FROM f), cov AS (SELECT {matrix} AS m FROM x), {power('a', 'cov')},
        rest AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda z, j: z - size * v[i] * v[j])) AS m FROM cov, a), {power('b', 'rest')}
        SELECT entity_id, round(list_dot_product(x, a.v), 4) AS pc1, round(list_dot_product(x, b.v), 4) AS pc2 FROM x, a, b"""


@query("m04_pca_projection", with_views("action entity race", _pca_sql()).replace("WITH ", "WITH RECURSIVE ", 1))
def m04(spark, sf):
    out = modelling.pca_project(features(spark, sf).select("entity_id", *FEATURES), FEATURES).select("entity_id", "pc1", "pc2")
    return rounded(out, "pc1", "pc2", places=4)


def labelled_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"))
    return sampling.stratified_split(e, "y", "vec_id", [("train", 0.8), ("test", 0.2)])


@query("m04_pca_by_variance")
def m04_variance(spark, sf):
    rows = labelled_vectors(spark, sf)
    _, test, keep = modelling.pca_by_variance(rows.where("split = 'train'"), rows.where("split = 'test'"), "embedding")
    return test.select("vec_id", "y", "embedding", F.lit(keep).alias("kept"))


def outcome_rows(spark, sf):
    """Orders as a binary outcome with three numeric predictors."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", ((F.col("o_totalprice") + F.col("c_acctbal") * 10) > 260000).cast("int").alias("y"),
        F.col("c_acctbal").alias("balance"), F.month("o_orderdate").cast("double").alias("month"), F.col("c_nationkey").cast("double").alias("nation"),
    )


PREDICTORS = ["balance", "month", "nation"]
OUTCOME_SQL = """src AS (SELECT o_orderkey, CAST((o_totalprice + c_acctbal * 10) > 260000 AS INT) AS y, CAST(c_acctbal AS DOUBLE) AS balance,
        CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(c_nationkey AS DOUBLE) AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"""
NEWTON_STEPS = 9


def newton_sql(x: list[str], where: str = "true", models: str = "SELECT 0 AS m") -> str:
    """Newton steps over the rows ``z`` (y, the columns, what ``where`` asks for), from zero; the last are ``fit`` and ``info``.

    Each step sums gradient and information matrix and solves by a Cholesky factor written out in scalars.
    """
    d = range(len(x) + 1)
    term = lambda i: "1.0::DOUBLE" if i == 0 else x[i - 1]
    pairs = [(i, j) for i in d for j in range(i + 1)]
    ctes = [f"f0 AS (SELECT m, {', '.join(f'0.0::DOUBLE AS b{i}' for i in d)} FROM ({models}))"]
    factor, solve = [], []
    for j in d:
        inner = "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        factor.append(f"sqrt(h{j}_{j}{inner}) AS l{j}_{j}")
        for i in d[j + 1 :]:
            inner = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            factor.append(f"(h{i}_{j}{inner}) / l{j}_{j} AS l{i}_{j}")
    for i in d:
        solve.append(f"(g{i}{''.join(f' - l{i}_{k} * z{k}' for k in range(i))}) / l{i}_{i} AS z{i}")
    for i in reversed(d):
        solve.append(f"(z{i}{''.join(f' - l{k}_{i} * d{k}' for k in d[i + 1:])}) / l{i}_{i} AS d{i}")
    for s in range(NEWTON_STEPS):
        score = " + ".join(f"b{i} * {term(i)}" for i in d)
        sums = [f"sum((y - p) * {term(i)}) AS g{i}" for i in d] + [f"sum(p * (1 - p) * {term(i)} * {term(j)}) AS h{i}_{j}" for i, j in pairs]
        ctes.append(f"t{s} AS MATERIALIZED (SELECT m, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM z JOIN f{s} ON {where}) GROUP BY m)")
        ctes.append(
            f"f{s + 1} AS MATERIALIZED (SELECT f{s}.m, {', '.join(f'b{i} + d{i} AS b{i}' for i in d)} "
            f"FROM f{s} JOIN (SELECT m, {', '.join(factor + solve)} FROM t{s}) USING (m))"
        )
    inverse = []
    for i in d:
        inverse.append(f"1 / l{i}_{i} AS r{i}_{i}")
        inverse += [f"-({' + '.join(f'l{k}_{j} * r{j}_{i}' for j in range(i, k))}) / l{k}_{k} AS r{k}_{i}" for k in d[i + 1 :]]
    errors = [f"sqrt({' + '.join(f'r{k}_{i} * r{k}_{i}' for k in d[i:])}) AS se{i}" for i in d]
    ctes.append(f"info AS (SELECT m, {', '.join(factor + inverse + errors)} FROM t{NEWTON_STEPS - 1})")
    ctes.append(f"fit AS (SELECT * FROM f{NEWTON_STEPS})")
    return ", ".join(ctes)


def _scaled(over: str = "") -> str:
    return ", ".join(f"({c} - avg({c}) OVER ({over})) / stddev_pop({c}) OVER ({over}) AS {c}" for c in PREDICTORS)


def _logistic_sql() -> str:
    row = lambda name, i: f"SELECT '{name}' AS feature, b{i} AS b, se{i} AS se FROM fit JOIN info USING (m)"
    return f"""WITH {OUTCOME_SQL}, z AS MATERIALIZED (SELECT o_orderkey, y, {_scaled()} FROM src), {newton_sql(PREDICTORS)},
        r AS ({' UNION ALL '.join([row(c, i + 1) for i, c in enumerate(PREDICTORS)] + [row('const', 0)])})
        SELECT feature, round(b, 4) AS coef, round(se, 4) AS se, round({normal_p_sql('b / se')}, 4) AS p, round(exp(b), 4) AS odds_ratio,
        round(exp(b - 1.96 * se), 4) AS or_low, round(exp(b + 1.96 * se), 4) AS or_high FROM r"""


@query("m05_logistic_table", _logistic_sql())
def m05(spark, sf):
    out = logistic.logistic_table(outcome_rows(spark, sf), "y", PREDICTORS)
    return rounded(out, "coef", "se", "p", "odds_ratio", "or_low", "or_high", places=4)


def _ratio_sql() -> str:
    score = " + ".join(["b0", *[f"b{i + 1} * {c}" for i, c in enumerate(PREDICTORS)]])
    return f"""WITH {OUTCOME_SQL}, z AS MATERIALIZED (SELECT o_orderkey, y, {_scaled()} FROM src), {newton_sql(PREDICTORS)},
        l AS (SELECT count(*) AS n, sum(y * ln(p + 1e-12) + (1 - y) * ln(1 - p + 1e-12)) AS ll_full,
            sum(y) * ln(avg(y) + 1e-12) + (count(*) - sum(y)) * ln(1 - avg(y) + 1e-12) AS ll_null
            FROM (SELECT y, 1 / (1 + exp(-({score}))) AS p FROM z, fit)),
        c AS (SELECT *, 2 * (ll_full - ll_null) AS lr_chi2 FROM l)
        SELECT n, round(ll_full, 4) AS ll_full, round(ll_null, 4) AS ll_null, round(lr_chi2, 4) AS lr_chi2,
        round(1 - ll_full / ll_null, 4) AS mcfadden, round({chi2_p_sql('lr_chi2', len(PREDICTORS))}, 4) AS p FROM c"""


@query("x15_likelihood_ratio", _ratio_sql())
def x15(spark, sf):
    out = logistic.likelihood_ratio(outcome_rows(spark, sf), "y", PREDICTORS)
    return rounded(out, "ll_full", "ll_null", "lr_chi2", "mcfadden", "p", places=4)


def _folds_sql() -> str:
    mean_sd = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PREDICTORS)
    scaled = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in PREDICTORS)
    score = " + ".join(["b0", *[f"b{i + 1} * {c}" for i, c in enumerate(PREDICTORS)]])
    return f"""WITH {OUTCOME_SQL}, dealt AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(o_orderkey, ':0')), o_orderkey) % 5 AS fold FROM src),
        scale AS (SELECT f.m, {mean_sd} FROM range(5) f(m) JOIN dealt ON fold <> f.m GROUP BY f.m),
        z AS MATERIALIZED (SELECT scale.m AS of, o_orderkey, y, fold, {scaled} FROM dealt, scale),
        {newton_sql(PREDICTORS, 'z.of = m AND fold <> m', 'SELECT m FROM range(5) t(m)')},
        s AS (SELECT y, 1 / (1 + exp(-({score}))) AS p FROM z JOIN fit ON z.of = m AND fold = m),
        r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM s),
        a AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
            / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r)
        SELECT count(*) AS n, round(count(*) FILTER ((p >= 0.5) = (y = 1)) / count(*), 4) AS accuracy,
        round(greatest(avg(y), 1 - avg(y)), 4) AS baseline, round(any_value(auc), 4) AS auc FROM s, a"""


@query("m06_cross_validation", _folds_sql())
def m06(spark, sf):
    return rounded(modelling.cross_validate(outcome_rows(spark, sf), "y", PREDICTORS, "o_orderkey"), "accuracy", "baseline", "auc", places=4)


@query("m07_boosted_trees")
def m07(spark, sf):
    rows = labelled_vectors(spark, sf)
    train, test = (rows.where(F.col("split") == part) for part in ("train", "test"))
    scored, trees = modelling.boosted_trees(train, test, "embedding", "y", "vec_id")
    return scored.withColumn("trees", F.lit(trees))


SCORED_SQL = "sc AS (SELECT quality AS y, (n_chars % 997) / 1000.0::DOUBLE + quality * 0.1 AS score FROM labels JOIN documents USING (doc_id))"


def scored(spark, sf):
    score = (F.col("n_chars") % 997) / 1000.0 + F.col("quality") * 0.1
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("y"), score.alias("score"))


@query(
    "m08_threshold_sweep",
    f"""WITH {SCORED_SQL}, th AS (SELECT i AS step, CASE WHEN i = 199 THEN 0.99::DOUBLE ELSE 0.01 + i * (0.98 / 199.0::DOUBLE) END AS threshold FROM range(200) r(i)),
    c AS (SELECT step, threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp,
        count(*) FILTER (y = 1 AND score < threshold) AS fn FROM th, sc GROUP BY ALL)
    SELECT CAST(step AS INTEGER) AS step, round(threshold, 6) AS threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
    round(tp / (tp + fn), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def m08(spark, sf):
    return rounded(modelling.threshold_sweep(scored(spark, sf), "y", "score"), "threshold", "precision", "recall", "f1")


@query(
    "m09_roc_auc",
    f"""WITH {SCORED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM sc)
    SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""",
)
def m09(spark, sf):
    return rounded(modelling.roc_auc(scored(spark, sf), "y", "score"), "auc")


PIXEL_SQL = """px AS (SELECT id, lat, lon, (lon + 180.0) / 360.0 * 4096.0 AS x, (0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * 4096.0 AS y FROM geo),
    near AS (SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 100),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
    edge AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    reachable AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, e.b FROM reachable r JOIN edge e ON r.b = e.a),
    lab AS (SELECT a AS id, min(b) AS cluster FROM reachable GROUP BY a),
    border AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN lab ON lab.id = b WHERE a NOT IN (FROM core) GROUP BY a),
    dbscan AS (SELECT id, coalesce(lab.cluster, border.cluster, -1) AS cluster FROM px LEFT JOIN lab USING (id) LEFT JOIN border USING (id))"""


def clustered(spark, sf):
    zoom = fit_zoom(1100, 700, (24.0, 49.0), (-125.0, -66.0))
    x, y = mercator_pixel(F.col("lat"), F.col("lon"), zoom)
    pixels = t.geo(spark, sf).select("id", "lat", "lon", "label", x.alias("x"), y.alias("y"))
    return pixels, modelling.density_clusters(pixels, "id", "x", "y", 10.0, 3, 4096.0)


@query("m10_density_clusters", with_views("geo", f"+ {PIXEL_SQL} SELECT id, cluster FROM dbscan").replace("WITH ", "WITH RECURSIVE ", 1))
def m10(spark, sf):
    return clustered(spark, sf)[1]


@query(
    "m10_bubble_table",
    with_views(
        "geo",
        f"""+ {PIXEL_SQL}, n AS (SELECT id, cluster, lat, lon, label % 4 AS n FROM dbscan JOIN geo USING (id))
        SELECT cluster, count(*) AS n, count(*) FILTER (n > 0) AS n_with_action, round(100.0 * count(*) FILTER (n > 0) / count(*), 1) AS pct_with_action,
        round(avg(n), 2) AS mean_actions, round(avg(lat), 4) AS centroid_lat, round(avg(lon), 4) AS centroid_lon FROM n GROUP BY cluster""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def m10_bubbles(spark, sf):
    pixels, labels = clustered(spark, sf)
    members = pixels.withColumn("n", F.col("label") % 4).join(labels, "id")
    return modelling.bubble_table(members, "cluster", "lat", "lon", "n")

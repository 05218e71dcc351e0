"""Queries for statistics (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import aggregates as agg
from almanac.operators import nearest
from almanac.operators import shuffles
from almanac.operators import statistics as st
from almanac.plans import tables as t
from almanac.plans.aggregate_plans import CATS, CLICK_SQL, COUNTS_SQL, FRAMING_SQL, customer_matrix, framed, order_counts, per_entity, rounded
from almanac.plans.join_plans import KNN_SQL
from almanac.plans.registry import query
from almanac.plans.tables import table, with_views

# Tail probabilities in plain SQL: Simpson sums of the densities.
_STEPS = 2000
_SIMPSON = f"(CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def normal_p_sql(z: str) -> str:
    area = f"list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {_SIMPSON} * exp(-pow(least(abs({z}), 12) * i / {_STEPS}.0, 2) / 2)))"
    return f"greatest(0, 1 - 2 * least(abs({z}), 12) / {_STEPS}.0 / 3 / sqrt(2 * pi()) * {area})"


def chi2_p_sql(x: str, df: int) -> str:
    if df % 2 == 0:
        terms = " + ".join(f"pow({x} / 2, {i}) / {max(1, __import__('math').factorial(i))}" for i in range(df // 2))
        return f"exp(-{x} / 2) * ({terms})"
    out, odd = normal_p_sql(f"sqrt({x})"), 1
    for r in range(1, (df - 1) // 2 + 1):
        odd *= 2 * r - 1
        out += f" + 2 * exp(-{x} / 2) / sqrt(2 * pi()) * pow({x}, {r - 0.5}) / {odd}"
    return f"({out})"


def t_p_sql(tv: str, df: str) -> str:
    c = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    area = f"list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {_SIMPSON} * pow(1 + pow(least(abs({tv}), 30) * i / {_STEPS}.0, 2) / {df}, -({df} + 1) / 2.0)))"
    return f"greatest(0, 1 - 2 * least(abs({tv}), 30) / {_STEPS}.0 / 3 * {c} * {area})"


@query(
    "x01_friedman",
    with_views(
        "action",
        f"""+ {CLICK_SQL}, l AS (UNPIVOT (SELECT entity_id, click, error, purchase, signup FROM m) ON click, error, purchase, signup INTO NAME c VALUE v),
        r AS (SELECT entity_id, c, rank() OVER (PARTITION BY entity_id ORDER BY v) + (count(*) OVER (PARTITION BY entity_id, v) - 1) / 2.0::DOUBLE AS r,
            count(*) OVER (PARTITION BY entity_id, v) AS same FROM l),
        col AS (SELECT c, sum(r) AS rs, sum(same * same - 1) AS ties, count(*) AS n FROM r GROUP BY c),
        q AS (SELECT CAST(max(n) AS BIGINT) AS n, (12.0::DOUBLE / (max(n) * 4 * 5) * sum(rs * rs) - 3 * max(n) * 5) / (1 - sum(ties) / (max(n) * 4.0::DOUBLE * 15)) AS chi2 FROM col)
        SELECT n AS n_subjects, CAST(3 AS INTEGER) AS df, round(chi2, 6) AS chi2, round({chi2_p_sql('chi2', 3)}, 6) AS p FROM q""",
    ),
)
def x01(spark, sf):
    return rounded(st.friedman(customer_matrix(spark, sf), CATS), "chi2", "p")


def ranked_sql(rows: str) -> str:
    """Average ranks of (grp, v) rows, rank sums and the tie term."""
    return f"""rows_ AS ({rows}), rk AS (SELECT grp, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM rows_),
    g AS (SELECT grp, count(*) AS n, sum(r) AS rs, avg(v) AS mean FROM rk GROUP BY grp),
    tie AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties, CAST(sum(c) AS DOUBLE) AS nn FROM (SELECT count(*) AS c FROM rows_ GROUP BY v))"""


KRUSKAL_SQL = f"""h AS (SELECT (12 / (max(nn) * (max(nn) + 1)) * sum(rs * rs / n) - 3 * (max(nn) + 1)) / (1 - max(ties) / (pow(max(nn), 3) - max(nn))) AS h,
            CAST(max(nn) AS BIGINT) AS nn, count(*) AS k FROM g, tie WHERE n > 1)
        SELECT round(h, 6) AS "H", CAST(k - 1 AS INTEGER) AS df, k AS n_groups, nn AS n_total, round(CASE k
        {' '.join(f"WHEN {d + 1} THEN {chi2_p_sql('h', d)}" for d in range(1, 8))} END, 6) AS p FROM h"""


ENTITY_N_SQL = f"{COUNTS_SQL}, e AS (SELECT grp, region, n AS v FROM entity JOIN cnt USING (entity_id))"


def entity_counts(spark, sf):
    return t.entity(spark, sf).join(order_counts(spark, sf), "entity_id")


@query(
    "x02_kruskal",
    with_views(
        "entity",
        f"""+ {ENTITY_N_SQL}, {ranked_sql('SELECT grp, v FROM e')},
        {KRUSKAL_SQL}""",
    ),
)
def x02(spark, sf):
    return rounded(st.kruskal(entity_counts(spark, sf), "grp", "n"), "H", "p")


def u_sql(prefix: str = "") -> str:
    """U test columns from a (n1, rs1, n2), ties and nn."""
    return """SELECT *, rs1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u,
        (greatest(rs1 - n1 * (n1 + 1) / 2.0::DOUBLE, n1 * n2 - (rs1 - n1 * (n1 + 1) / 2.0::DOUBLE)) - n1 * n2 / 2.0::DOUBLE - 0.5)
        / sqrt(n1 * n2 / 12.0::DOUBLE * ((nn + 1) - ties / (nn * (nn - 1)))) AS z"""


@query(
    "x03_mann_whitney",
    with_views(
        "entity",
        f"""+ {ENTITY_N_SQL}, {ranked_sql("SELECT grp, v FROM e WHERE grp IN ('BUILDING', 'MACHINERY')")},
        a AS ({u_sql()} FROM (SELECT x.n AS n1, x.rs AS rs1, x.mean AS mean1, y.n AS n2, y.mean AS mean2, ties, nn FROM g x, g y, tie
            WHERE x.grp = 'BUILDING' AND y.grp = 'MACHINERY'))
        SELECT n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, u AS "U", round(z, 6) AS z, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial,
        round({normal_p_sql('z')}, 6) AS p FROM a""",
    ),
)
def x03(spark, sf):
    out = st.mann_whitney(entity_counts(spark, sf), "grp", "n", "BUILDING", "MACHINERY").drop("group1", "group2")
    return rounded(out, "mean1", "mean2", "z", "rank_biserial", "p")


WILCOXON_SQL = """d AS (SELECT click - error AS d FROM m WHERE click <> error),
    wr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
    wt AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY abs(d))),
    ws AS (SELECT count(*) AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS stat FROM wr),
    wz AS (SELECT n, stat, (stat - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48) AS z FROM ws, wt)"""


@query(
    "x04_wilcoxon",
    with_views("action", f"+ {CLICK_SQL}, {WILCOXON_SQL} SELECT stat, round(z, 6) AS z, n, round({normal_p_sql('z')}, 6) AS p FROM wz"),
)
def x04(spark, sf):
    return rounded(st.wilcoxon(customer_matrix(spark, sf), "click", "error"), "z", "p")


@query(
    "x05_pairwise",
    with_views(
        "entity",
        f"""+ {ENTITY_N_SQL}, k AS (SELECT DISTINCT grp FROM e), pr AS (SELECT a.grp AS a, b.grp AS b FROM k a JOIN k b ON a.grp < b.grp),
        pool AS (SELECT a, b, grp, v, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS r
            FROM pr JOIN e ON grp IN (a, b)),
        s AS (SELECT a, b, count(*) FILTER (grp = a) AS n1, count(*) FILTER (grp = b) AS n2, sum(r) FILTER (grp = a) AS rs1,
            avg(v) FILTER (grp = a) AS mean1, avg(v) FILTER (grp = b) AS mean2, CAST(count(*) AS DOUBLE) AS nn FROM pool GROUP BY a, b),
        ti AS (SELECT a, b, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT a, b, count(*) AS c FROM pool GROUP BY a, b, v) GROUP BY a, b),
        q AS ({u_sql()} FROM s JOIN ti USING (a, b)), p AS (SELECT *, CASE WHEN z <= 0 THEN 1 ELSE {normal_p_sql('z')} END AS p FROM q)
        SELECT a AS group1, b AS group2, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, u AS "U", round(z, 6) AS z,
        round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, round(p, 6) AS p, round(least(p * 10, 1), 6) AS p_bonf, least(p * 10, 1) < 0.05 AS sig FROM p""",
    ),
)
def x05(spark, sf):
    out = st.pairwise(entity_counts(spark, sf), "grp", "n")
    return rounded(out, "mean1", "mean2", "z", "rank_biserial", "p", "p_bonf")


@query(
    "x05_pairwise_paired",
    with_views(
        "action",
        f"""+ {CLICK_SQL}, pr AS (SELECT 'click' AS group1, 'error' AS group2, click - error AS d FROM m
            UNION ALL SELECT 'click', 'purchase', click - purchase FROM m UNION ALL SELECT 'click', 'signup', click - signup FROM m
            UNION ALL SELECT 'error', 'purchase', error - purchase FROM m UNION ALL SELECT 'error', 'signup', error - signup FROM m
            UNION ALL SELECT 'purchase', 'signup', purchase - signup FROM m),
        r AS (SELECT *, rank() OVER (PARTITION BY group1, group2 ORDER BY abs(d))
            + (count(*) OVER (PARTITION BY group1, group2, abs(d)) - 1) / 2.0::DOUBLE AS r FROM pr WHERE d <> 0),
        sm AS (SELECT group1, group2, count(*) AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS stat FROM r GROUP BY ALL),
        ti AS (SELECT group1, group2, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT group1, group2, count(*) AS c FROM r
            GROUP BY group1, group2, abs(d)) GROUP BY ALL),
        z AS (SELECT *, (stat - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48) AS z FROM sm JOIN ti USING (group1, group2)),
        p AS (SELECT *, {normal_p_sql('z')} AS p FROM z)
        SELECT group1, group2, stat, round(z, 6) AS z, n, round(p, 6) AS p, round(least(p * 6, 1), 6) AS p_bonf, least(p * 6, 1) < 0.05 AS sig FROM p""",
    ),
)
def x05_paired(spark, sf):
    return rounded(st.pairwise_paired(customer_matrix(spark, sf), CATS), "z", "p", "p_bonf")


def dunn_sql() -> str:
    return f"""dz AS (SELECT x.grp AS group1, y.grp AS group2, x.n AS n1, y.n AS n2, x.mean AS mean1, y.mean AS mean2, (x.rs / x.n - y.rs / y.n)
            / sqrt((nn * (nn + 1) / 12 - ties / (12 * (nn - 1))) * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)) AS z FROM g x JOIN g y ON x.grp < y.grp, tie),
        dp AS (SELECT *, {normal_p_sql('z')} AS p FROM dz),
        dr AS (SELECT *, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS scaled FROM dp),
        dunn AS (SELECT *, least(1, min(scaled) OVER (ORDER BY p DESC)) AS p_adj FROM dr)
        SELECT group1, group2, n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(z, 6) AS z, round(p, 6) AS p,
        round(p_adj, 6) AS p_adj, p_adj < 0.05 AS sig FROM dunn"""


@query("x06_dunn", with_views("entity", f"+ {ENTITY_N_SQL}, {ranked_sql('SELECT grp, v FROM e')}, {dunn_sql()}"))
def x06(spark, sf):
    return rounded(st.dunn(entity_counts(spark, sf), "grp", "n"), "mean1", "mean2", "z", "p", "p_adj")


@query(
    "x07_adjusted_p",
    """WITH p AS (SELECT p_partkey, p_retailprice / 30000.0 AS p FROM part), m AS (SELECT count(*) AS m FROM p),
    r AS (SELECT *, p * m / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS s FROM p, m)
    SELECT p_partkey, round(least(1, min(s) OVER (ORDER BY p DESC)), 6) AS bh, round(least(1, p * m), 6) AS bonf FROM r""",
)
def x07(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 30000.0).alias("p"))
    bh = st.adjust(p, "p").select("p_partkey", F.round("p_adj", 6).alias("bh"))
    bonf = st.adjust(p, "p", "bonferroni").select("p_partkey", F.round("p_adj", 6).alias("bonf"))
    return bh.join(bonf, "p_partkey")


@query(
    "x08_spearman",
    f"""WITH {COUNTS_SQL}, j AS (SELECT n, c_acctbal AS b FROM cnt JOIN customer ON c_custkey = entity_id),
    r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM j),
    c AS (SELECT count(*) AS n, corr(x, y) AS rho FROM r), q AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c),
    p AS (SELECT *, {t_p_sql('t', '(n - 2)')} AS p FROM q)
    SELECT n, round(rho, 6) AS rho, round(p, 6) AS p, round(least(p * 7, 1), 6) AS p_bonf FROM p""",
)
def x08(spark, sf):
    rows = order_counts(spark, sf).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("entity_id"))
    return rounded(st.spearman(rows, "n", "c_acctbal", 7).select("n", "rho", "p", "p_bonf"), "rho", "p", "p_bonf")


@query(
    "x09_correlation",
    f"""WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r, regr_slope(l_extendedprice, l_quantity) AS slope,
        regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem),
    q AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
    SELECT n, round(r, 6) AS r, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round({t_p_sql('t', '(n - 2)')}, 6) AS p FROM q""",
)
def x09(spark, sf):
    out = st.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(rounded(out, "r", "p"), "slope", "intercept", places=4).select("n", "r", "slope", "intercept", "p")


@query(
    "x10_two_by_two",
    with_views(
        "rating",
        f"""+ k AS (SELECT count(*) FILTER (a = 1 AND c = 1) AS a, count(*) FILTER (a = 1 AND c = 0) AS b, count(*) FILTER (a = 0 AND c = 1) AS c,
            count(*) FILTER (a = 0 AND c = 0) AS d FROM rating),
        x AS (SELECT a, b, c, d, (a + b + c + d) * pow(a * d - b * c, 2) / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS chi2,
            (a + 0.5) * (d + 0.5) / CAST((b + 0.5) * (c + 0.5) AS DOUBLE) AS o,
            sqrt(1 / (a + 0.5::DOUBLE) + 1 / (b + 0.5::DOUBLE) + 1 / (c + 0.5::DOUBLE) + 1 / (d + 0.5::DOUBLE)) AS se FROM k)
        SELECT a, b, c, d, round(chi2, 6) AS chi2, round(sqrt(chi2 / (a + b + c + d)) * CASE WHEN a / (a + b) >= c / (c + d) THEN 1 ELSE -1 END, 6) AS phi,
        round(o, 6) AS odds_ratio, round(exp(ln(o) - 1.96 * se), 6) AS or_low, round(exp(ln(o) + 1.96 * se), 6) AS or_high,
        round({normal_p_sql('sqrt(chi2)')}, 6) AS p FROM x""",
    ),
)
def x10(spark, sf):
    out = st.two_by_two(t.rating(spark, sf), F.col("a") == 1, F.col("c") == 1)
    return rounded(out, "chi2", "phi", "odds_ratio", "or_low", "or_high", "p")


@query("x11_bootstrap_interval")
def x11(spark, sf):
    return st.bootstrap_interval(order_counts(spark, sf), "n", reps=10_000)


def spatial(spark, sf):
    g = t.geo(spark, sf)
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[2].cast("double").alias("x"), F.col("label").cast("double").alias("y")
    )
    edges = nearest.knn_join(g, g, "id", "lat", "lon", 8, exclude_self=True)
    edges = edges.select("id", "neighbour", F.lit(0.125).alias("weight"))
    return e, edges


LEE_SQL = f"""+ {KNN_SQL}, v AS (SELECT vec_id AS id, CAST(embedding[3] AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM embeddings),
    zz AS (SELECT id, (x - (SELECT avg(x) FROM v)) / (SELECT stddev_pop(x) FROM v) AS x, (y - (SELECT avg(y) FROM v)) / (SELECT stddev_pop(y) FROM v) AS y FROM v),
    lag AS (SELECT knn.id, sum(x / 8) AS wx, sum(y / 8) AS wy FROM knn JOIN zz ON zz.id = neighbour GROUP BY knn.id),
    j AS (SELECT zz.id, x, y, wx, wy FROM zz JOIN lag USING (id))"""


@query(
    "x12_lees_l",
    with_views(
        "geo",
        f"""{LEE_SQL} SELECT count(*) AS n, round(sum(wx * wy) / count(*), 6) AS lees_l, round(sum(x * wx) / sum(x * x), 6) AS morans_i_x,
        round(sum(y * wy) / sum(y * y), 6) AS morans_i_y FROM j""",
    ),
)
def x12(spark, sf):
    v, edges = spatial(spark, sf)
    return rounded(st.lees_l(v, edges, "x", "y"), "lees_l", "morans_i_x", "morans_i_y")


@query("x12_local_lees_l", with_views("geo", f"{LEE_SQL} SELECT id, round(wx * wy, 6) AS local_l FROM j"))
def x12_local(spark, sf):
    v, edges = spatial(spark, sf)
    return rounded(st.local_lees_l(v, edges, "x", "y"), "local_l")


@query("x13_morans_i", with_views("geo", f"{LEE_SQL} SELECT round(sum(y * wy) / sum(y * y), 6) AS morans_i FROM j"))
def x13(spark, sf):
    v, edges = spatial(spark, sf)
    return st.lees_l(v, edges, "x", "y").select(F.round("morans_i_y", 6).alias("morans_i"))


PERMUTATIONS = 9_999


def _feistel_sql(source: str, n: str = "n") -> str:
    """One pass of the keyed network over the column ``v`` of ``source``, round by round; keys are in the list ``k``."""
    sql = f"SELECT *, v // b AS l, v % b AS r FROM {source}"
    for i in range(shuffles.SHUFFLE_ROUNDS):
        to, of, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        sql = f"SELECT * REPLACE (({to} + ({of} * k[{2 * i + 1}] + k[{2 * i + 2}]) % {shuffles.SHUFFLE_PRIME}) % {side} AS {to}) FROM ({sql})"
    return f"SELECT rep, nth, l * b + r AS v, k, a, b, n FROM ({sql})"


def _keys_sql() -> str:
    one = lambda r, at: f"CAST('0x' || substr(md5('0:' || rep || ':{r}'), {at}, 7) AS BIGINT)"
    return ", ".join(f"{one(r, 1)} + 1, {one(r, 8)}" for r in range(shuffles.SHUFFLE_ROUNDS))


@query(
    "x14_permutation_test",
    with_views(
        "geo",
        f"""{LEE_SQL}, coef AS (SELECT neighbour AS id, sum(wx / 8) AS c FROM knn JOIN j USING (id) GROUP BY neighbour),
        num AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS nth, y, coalesce(c, 0) AS c FROM j LEFT JOIN coef USING (id)),
        size AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) + 1 AS BIGINT) AS a FROM (SELECT count(*) AS n FROM num))),
        keys AS MATERIALIZED (SELECT rep, [{_keys_sql()}] AS k FROM range(1, {PERMUTATIONS + 1}) t(rep)),
        start AS (SELECT rep, nth, nth AS v, k, a, b, n FROM num, keys, size),
        walk AS ({_feistel_sql('start')} UNION ALL ({_feistel_sql('(SELECT * FROM walk WHERE v >= n)')})),
        perm AS (SELECT rep, sum(num.c * other.y) / any_value(n) AS l FROM walk JOIN num USING (nth) JOIN num other ON other.nth = v WHERE v < n GROUP BY rep),
        obs AS (SELECT sum(wx * wy) / count(*) AS obs FROM j)
        SELECT round(max(obs), 6) AS lees_l, round(avg(l), 6) AS perm_mean, round(stddev_pop(l), 6) AS perm_sd,
        round((max(obs) - avg(l)) / stddev_pop(l), 6) AS z, (count(*) FILTER (l >= obs) + 1) / CAST({PERMUTATIONS + 1} AS DOUBLE) AS p_one_sided,
        (count(*) FILTER (abs(l) >= abs(obs)) + 1) / CAST({PERMUTATIONS + 1} AS DOUBLE) AS p_two_sided FROM perm, obs""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def x14(spark, sf):
    v, edges = spatial(spark, sf)
    return rounded(st.permutation_test(v, edges, "x", "y", perms=PERMUTATIONS), "lees_l", "perm_mean", "perm_sd", "z")


@query(
    "x16_mardia",
    """WITH z AS (SELECT (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders) AS z FROM orders),
    m AS (SELECT count(*) AS n, pow(avg(z * z * z), 2) AS skewness, avg(pow(z, 4)) AS kurtosis FROM z)
    SELECT n, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(n * skewness / 6, 4) AS skew_stat,
    round((kurtosis - 3) / sqrt(24.0::DOUBLE / n), 4) AS kurt_z FROM m""",
)
def x16(spark, sf):
    out = st.mardia(table(spark, sf, "orders"), ["o_totalprice"]).drop("skew_p", "kurt_p")
    return rounded(rounded(out, "skewness", "kurtosis"), "skew_stat", "kurt_z", places=4)


def _mardia_sql() -> str:
    """All pairs of distinct rows, weighted: the mean cubes and squares of their Mahalanobis products."""
    names = {"x": "l_quantity", "y": "l_discount", "z": "l_tax"}
    cov = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    # the inverse by cofactors
    inverse = {
        "xx": "yy * zz - yz * yz", "xy": "xz * yz - xy * zz", "xz": "xy * yz - xz * yy", "yy": "xx * zz - xz * xz",
        "yz": "xy * xz - xx * yz", "zz": "xx * yy - xy * xy",
    }
    det = "xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)"
    product = " + ".join(f"i{min(a, b)}{max(a, b)} * a.{a} * b.{b}" for a in "xyz" for b in "xyz")
    return f"""WITH rows AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {a}' for a, c in names.items())} FROM lineitem),
        s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {cov} FROM rows),
        inv AS (SELECT {', '.join(f'({v}) / ({det}) AS i{k}' for k, v in inverse.items())} FROM s),
        d AS (SELECT x - mx AS x, y - my AS y, z - mz AS z, count(*) AS w, any_value(n) AS n FROM rows, s GROUP BY ALL),
        pairs AS (SELECT sum(CAST(a.w AS DOUBLE) * b.w * pow({product}, 3)) / any_value(CAST(a.n AS DOUBLE) * a.n) AS skewness FROM d a, d b, inv),
        own AS (SELECT any_value(n) AS n, sum(a.w * pow({product.replace('b.', 'a.')}, 2)) / any_value(n) AS kurtosis FROM d a, inv),
        m AS (SELECT n, skewness, kurtosis, n * skewness / 6 AS skew_stat, (kurtosis - 15) / sqrt(120.0::DOUBLE / n) AS kurt_z FROM pairs, own)
        SELECT n, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(skew_stat, 4) AS skew_stat, round(kurt_z, 4) AS kurt_z,
        round({chi2_p_sql('skew_stat', 10)}, 4) AS skew_p, round({normal_p_sql('kurt_z')}, 4) AS kurt_p FROM m"""


@query("x16_mardia_joint", _mardia_sql())
def x16_joint(spark, sf):
    out = st.mardia(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(rounded(out, "skewness", "kurtosis"), "skew_stat", "kurt_z", "skew_p", "kurt_p", places=4)


@query(
    "x17_tukey_outliers",
    f"""WITH {COUNTS_SQL}, q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b, quantile_cont(ln(1 + n), 0.25) AS la,
        quantile_cont(ln(1 + n), 0.75) AS lb FROM cnt)
    SELECT entity_id, n < a - 1.5 * (b - a) OR n > b + 1.5 * (b - a) AS raw_15, n < a - 3 * (b - a) OR n > b + 3 * (b - a) AS raw_30,
    ln(1 + n) < la - 1.5 * (lb - la) OR ln(1 + n) > lb + 1.5 * (lb - la) AS log_15 FROM cnt, q""",
)
def x17(spark, sf):
    c = order_counts(spark, sf)
    flag = lambda name, **kw: agg.tukey_outliers(c, "n", **kw).select("entity_id", F.col("is_outlier").alias(name))
    out = flag("raw_15").join(flag("raw_30", multiplier=3.0), "entity_id")
    return out.join(flag("log_15", log=True), "entity_id")


@query(
    "x18_share_tests",
    with_views(
        "action entity",
        f"""+ {CLICK_SQL}, {ranked_sql('SELECT grp, click / CAST(n AS DOUBLE) AS v FROM s JOIN entity USING (entity_id) WHERE n > 0')},
        {KRUSKAL_SQL}""",
    ),
)
def x18(spark, sf):
    shares = agg.own_shares(per_entity(spark, sf), "entity_id", CATS, ["grp"])
    return rounded(st.kruskal(shares, "grp", "click"), "H", "p")


@query(
    "x18_share_posthoc",
    with_views(
        "action entity",
        f"""+ {CLICK_SQL}, {ranked_sql('SELECT grp, click / CAST(n AS DOUBLE) AS v FROM s JOIN entity USING (entity_id) WHERE n > 0')}, {dunn_sql()}""",
    ),
)
def x18_posthoc(spark, sf):
    shares = agg.own_shares(per_entity(spark, sf), "entity_id", CATS, ["grp"])
    return rounded(st.dunn(shares, "grp", "click"), "mean1", "mean2", "z", "p", "p_adj")


@query(
    "x19_party_effect_by_framing",
    with_views(
        "action entity",
        f"""+ f AS (SELECT entity_id, {FRAMING_SQL} AS framing FROM action), fr AS (SELECT * FROM (VALUES ('Implicit'), ('Explicit'), ('Embedded')) v(framing)),
        c AS (SELECT e.entity_id, e.grp, fr.framing, count(f.entity_id) AS v FROM entity e CROSS JOIN fr LEFT JOIN f ON f.entity_id = e.entity_id AND f.framing = fr.framing
            WHERE grp IN ('BUILDING', 'MACHINERY') GROUP BY ALL),
        r AS (SELECT framing, grp, v, rank() OVER (PARTITION BY framing ORDER BY v) + (count(*) OVER (PARTITION BY framing, v) - 1) / 2.0::DOUBLE AS r FROM c),
        s AS (SELECT framing, count(*) FILTER (grp = 'BUILDING') AS n1, count(*) FILTER (grp = 'MACHINERY') AS n2, sum(r) FILTER (grp = 'BUILDING') AS rs1,
            CAST(count(*) AS DOUBLE) AS nn FROM r GROUP BY framing),
        ti AS (SELECT framing, sum(CAST(k AS DOUBLE) * k * k - k) AS ties FROM (SELECT framing, count(*) AS k FROM r GROUP BY framing, v) GROUP BY framing),
        q AS ({u_sql()} FROM s JOIN ti USING (framing)), p AS (SELECT *, CASE WHEN z <= 0 THEN 1 ELSE {normal_p_sql('z')} END AS p FROM q)
        SELECT framing, n1, n2, u AS "U", round(z, 6) AS z, round(p, 6) AS p, round(least(p * 3, 1), 6) AS p_bonf FROM p""",
    ),
)
def x19(spark, sf):
    framings = ["Implicit", "Explicit", "Embedded"]
    members = t.entity(spark, sf)
    m = agg.count_matrix(framed(spark, sf), members, "entity_id", "framing", framings).join(members, "entity_id")
    long = m.unpivot(["entity_id", "grp"], framings, "framing", "n")
    out = st.mann_whitney(long, "grp", "n", "BUILDING", "MACHINERY", by=["framing"])
    out = out.withColumn("p_bonf", st.bonferroni(F.col("p"), F.lit(3)))
    return rounded(out.select("framing", "n1", "n2", "U", "z", "p", "p_bonf"), "z", "p", "p_bonf")

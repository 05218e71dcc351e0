"""Queries for the column functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import addresses, geo, labels, names, pages, urls, values
from almanac.operators import rollups
from almanac.plans import tables as t
from almanac.plans.registry import query
from almanac.plans.tables import table, with_views
from almanac.presets import FILL_STOP_WORDS
from almanac.session import spread

# ---- names -----------------------------------------------------------------

NORMAL_SQL = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query("f01_normal_name", f"SELECT doc_id, {NORMAL_SQL.format('text')} AS norm FROM documents")
def f01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.normal_name(F.col("text")).alias("norm"))


@query(
    "f02_name_tokens",
    f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(
        string_split({NORMAL_SQL.format("concat(p_type, ' of the ', p_name)")}, ' '),
        lambda x: x NOT IN {('', *FILL_STOP_WORDS)}))), ' ') AS tokens FROM part""",
)
def f02(spark, sf):
    full = names.normal_name(F.concat("p_type", F.lit(" of the "), "p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.array_sort(names.name_tokens(full, FILL_STOP_WORDS)), " ").alias("tokens")
    )


@query(
    "f03_names_match",
    """WITH p AS (SELECT p_partkey AS k, lower(concat(p_type, ' ', p_name)) AS n FROM part),
    s AS (SELECT a.k, a.n AS na, b.n AS nb, list_distinct(string_split(a.n, ' ')) AS ta,
                 list_distinct(string_split(b.n, ' ')) AS tb FROM p a JOIN p b ON b.k = a.k + 1),
    r AS (SELECT k, na, nb, len(list_intersect(ta, tb)) / CAST(greatest(len(ta), len(tb)) AS DOUBLE) AS share FROM s)
    SELECT k, round(share, 6) AS share, (na = nb OR share >= 0.65) AS is_match FROM r""",
)
def f03(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), names.normal_name(F.concat_ws(" ", "p_type", "p_name")).alias("n")
    )
    nxt = p.select((F.col("k") - 1).alias("k"), F.col("n").alias("m"))
    return p.join(nxt, "k").select(
        "k",
        F.round(names.token_share(names.name_tokens(F.col("n"), FILL_STOP_WORDS), names.name_tokens(F.col("m"), FILL_STOP_WORDS)), 6).alias("share"),
        names.names_match(F.col("n"), F.col("m"), FILL_STOP_WORDS).alias("is_match"),
    )


STATE_PAIR_SQL = """SELECT entity_id, CASE WHEN c_acctbal < 0 THEN '' ELSE state END AS l,
    CASE grp WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN lower(state) WHEN 'HOUSEHOLD' THEN state
    ELSE region END AS r FROM entity"""


@query(
    "f04_state_compatible",
    with_views(
        "entity",
        f"""SELECT entity_id, CASE WHEN l = '' THEN true WHEN r = '' THEN false
        ELSE upper(l) = upper(r) END AS ok FROM ({STATE_PAIR_SQL})""",
    ),
)
def f04(spark, sf):
    left = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("state"))
    right = (
        F.when(F.col("grp") == "BUILDING", "")
        .when(F.col("grp") == "MACHINERY", F.lower("state"))
        .when(F.col("grp") == "HOUSEHOLD", F.col("state"))
        .otherwise(F.col("region"))
    )
    return t.entity(spark, sf).select("entity_id", names.state_compatible(left, right).alias("ok"))


# ---- URLs ------------------------------------------------------------------


@query(
    "f05_normal_domain",
    r"""SELECT page_id, rtrim(lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '')), '/')
    AS domain FROM pages""",
)
def f05(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normal_domain(F.col("url")).alias("domain"))


@query(
    "f06_strict_domain",
    r"""WITH u AS (SELECT page_id, replace(url, '://', '://user@') AS v FROM pages)
    SELECT page_id, regexp_replace(split_part(split_part(regexp_extract(lower(v), '^[a-z]+://([^/?#]*)', 1), '@', 2),
    ':', 1), '^www\.', '') AS domain FROM u""",
)
def f06(spark, sf):
    noisy = F.replace("url", F.lit("://"), F.lit("://user@"))
    return table(spark, sf, "pages").select("page_id", urls.strict_domain(noisy).alias("domain"))


PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
HOST_SQL = r"regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '')"
DOMAIN_PATH_SQL = f"""CASE WHEN ltrim({PATH_SQL}, '/') = '' THEN {HOST_SQL}
    ELSE concat({HOST_SQL}, '/', ltrim({PATH_SQL}, '/')) END"""


@query("f07_domain_path", f"SELECT page_id, {DOMAIN_PATH_SQL} AS key FROM pages")
def f07(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.domain_path(F.col("url")).alias("key"))


CANON_SQL = f"""WITH a AS (SELECT page_id, rtrim(rtrim(lower({DOMAIN_PATH_SQL}), '/'), '.,-_~') AS p FROM pages),
    b AS (SELECT page_id, CASE WHEN regexp_matches(p, '/index\\.html?$')
        THEN rtrim(rtrim(regexp_replace(p, '/index\\.html?$', ''), '/'), '.,-_~') ELSE p END AS p FROM a),
    canon AS (SELECT page_id, CASE WHEN regexp_matches(p, '\\.(html|htm|php|asp|aspx|cfm|shtml)$')
        THEN rtrim(rtrim(regexp_replace(p, '\\.(html|htm|php|asp|aspx|cfm|shtml)$', ''), '/'), '.,-_~')
        ELSE p END AS key FROM b)"""


@query("f08_canonical_page_key", f"{CANON_SQL} SELECT page_id, key FROM canon")
def f08(spark, sf):
    key = urls.canonical_page_key(urls.domain_path(F.col("url")))
    return table(spark, sf, "pages").select("page_id", key.alias("key"))


@query(
    "f09_agreement_page_key",
    f"""SELECT page_id, concat(lower({HOST_SQL}), regexp_replace(regexp_replace(rtrim(url_decode(lower({PATH_SQL})), '/'),
    '\\.html?$', ''), '/index$', '')) AS key FROM pages""",
)
def f09(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.agreement_page_key(F.col("url")).alias("key"))


@query(
    "f10_path_variants",
    f"""WITH k AS (SELECT page_id, {DOMAIN_PATH_SQL} AS b FROM pages)
    SELECT DISTINCT page_id, unnest([b, rtrim(b, '/'), rtrim(b, '/') || '/index.html', rtrim(b, '/') || '.html'])
    AS variant FROM k""",
)
def f10(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.explode(urls.path_variants(urls.domain_path(F.col("url")))).alias("variant")
    )


@query(
    "f21_internal_links",
    r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1)) AS h FROM pages)
    SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), split_part(trim(h), '#', 1)) AS link,
    count(*) AS n FROM l WHERE starts_with(h, '/') AND NOT regexp_matches(lower(h), '[^/.][^/]*\.(pdf|jpg|jpeg|png|gif|svg|webp|mp3|mp4|zip|doc|docx|xls|xlsx|ppt|pptx|css|js|ico|woff|woff2|ttf|eot|map)$')
    GROUP BY ALL""",
)
def f21(spark, sf):
    links = table(spark, sf, "pages").select(
        "page_id", F.explode(urls.internal_links(F.col("html"), F.col("url"))).alias("link")
    )
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(
    "f22_storage_key",
    f"""WITH a AS (SELECT page_id, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q,
        trim({PATH_SQL}, '/') AS p0 FROM pages),
    b AS (SELECT page_id, q, regexp_replace(CASE WHEN p0 = '' THEN 'index' ELSE p0 END,
        '[^a-zA-Z0-9/._-]', '_', 'g') AS p FROM a)
    SELECT page_id, concat(rtrim(regexp_replace(p, '\\.html$', ''), '/'),
        CASE WHEN q = '' THEN '' ELSE '_' || left(md5(q), 8) END, '.html') AS key FROM b""",
)
def f22(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.storage_key(F.col("url")).alias("key"))


URL_RULES = (("spam", "junk"), ("blog", "blog"), (r"\.example\.org", "org"), ("/(?:fr|es|de)/", "foreign"))


@query(
    "f32_url_rule_bucket",
    with_views(
        "site",
        r"""SELECT page_id, CASE WHEN regexp_matches(x, 'spam') THEN 'junk' WHEN regexp_matches(x, 'blog') THEN 'blog'
        WHEN regexp_matches(x, '\.example\.org') THEN 'org' WHEN regexp_matches(x, '/(?:fr|es|de)/') THEN 'foreign'
        END AS bucket FROM (SELECT page_id, lower(concat(domain, ' ', url)) AS x FROM site)""",
    ),
)
def f32(spark, sf):
    return t.site(spark, sf).select(
        "page_id", urls.url_rule_bucket(F.col("url"), F.col("domain"), URL_RULES).alias("bucket")
    )


PLATFORMS = ("spam-farm.example.org", "blog.ththan.example.net", "example.com")


@query(
    "f33_is_platform",
    with_views(
        "site",
        """SELECT page_id, (contains(url, 'spam-farm.example.org') OR contains(url, 'blog.ththan.example.net')
        OR contains(url, 'example.com')) AS platform FROM site""",
    ),
)
def f33(spark, sf):
    return t.site(spark, sf).select(
        "page_id", urls.is_platform(F.col("url"), F.col("domain"), PLATFORMS).alias("platform")
    )


@query(
    "f34_duplicate_flag",
    with_views(
        "site",
        """+ d AS (SELECT domain, count(DISTINCT page_id % 7) AS owners, count(*) AS n FROM site GROUP BY domain)
        SELECT page_id, domain, CASE WHEN NOT contains(domain, '.') THEN 'malformed'
        WHEN domain = 'spam-farm.example.org' THEN 'platform' WHEN owners > 1 THEN 'shared'
        WHEN n > 1 THEN 'variants' ELSE 'no' END AS flag, owners FROM site JOIN d USING (domain)""",
    ),
)
def f34(spark, sf):
    s = t.site(spark, sf).select("page_id", "domain", (F.col("page_id") % 7).alias("owner"))
    return rollups.duplicate_domains(s, "domain", "owner", ("spam-farm.example.org",)).select(
        "page_id", "domain", "flag", "owners"
    )


@query(
    "f35_content_retag",
    with_views(
        "site",
        """+ f AS (SELECT domain, bool_or(contains(lower(url), 'than')) AS n1, bool_or(contains(lower(url), 'blog')) AS n2,
            bool_or(contains(lower(html), 'thereble')) AS c1, bool_or(contains(lower(html), 'nicht')) AS c2
            FROM site GROUP BY domain)
        SELECT domain, CASE WHEN c2 THEN 'two' WHEN c1 THEN 'one' WHEN n2 THEN 'two' WHEN n1 THEN 'one' END AS label,
        CASE WHEN c2 OR c1 THEN 'content' WHEN n2 OR n1 THEN 'name' END AS source FROM f""",
    ),
)
def f35(spark, sf):
    return rollups.content_retag(
        t.site(spark, sf),
        "domain",
        name_cols=["url"],
        text_col="html",
        rules=[("one", ["than"], ["thereble"]), ("two", ["blog"], ["nicht"])],
    )


@query(
    "f38_page_priority",
    f"""SELECT page_id, CAST(CASE WHEN length(k) - length(replace(k, '/', '')) <= 1 OR k LIKE '%/index.html'
        THEN 5 ELSE 0 END + CASE WHEN contains(k, 'our-') THEN 2 ELSE 0 END + CASE WHEN contains(k, 'en/') THEN 2 ELSE 0 END
        AS INTEGER) AS score FROM (SELECT page_id, lower({DOMAIN_PATH_SQL}) AS k FROM pages)""",
)
def f38(spark, sf):
    key = urls.domain_path(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.page_priority(key, ("our-", "en/")).alias("score"))


# ---- addresses -------------------------------------------------------------

STATE_LIST_SQL = "[" + ", ".join(f"'{c}'" for _, c, _ in addresses.STATES) + "]"
NAME_LIST_SQL = "[" + ", ".join(f"'{n}'" for n, _, _ in addresses.STATES) + "]"


@query(
    "f11_formatted_address",
    f"""WITH a AS (SELECT c_custkey AS k, {STATE_LIST_SQL}[c_nationkey + 1] AS st, {NAME_LIST_SQL}[c_nationkey + 1] AS nm,
        c_mktsegment AS city FROM customer)
    SELECT k, CASE k % 3 WHEN 2 THEN NULL ELSE city END AS city, CASE k % 3 WHEN 2 THEN NULL ELSE st END AS state FROM a""",
)
def f11(spark, sf):
    st = F.element_at(F.array(*[F.lit(c) for _, c, _ in addresses.STATES]), F.col("c_nationkey") + 1)
    nm = F.element_at(F.array(*[F.lit(n) for n, _, _ in addresses.STATES]), F.col("c_nationkey") + 1)
    street = F.concat(F.col("c_name"), F.lit(" St, "), F.col("c_mktsegment"), F.lit(", "))
    k = F.col("c_custkey")
    text = (
        F.when(k % 3 == 0, F.concat(street, st, F.lit(" 12345-6789, USA")))
        .when(k % 3 == 1, F.concat(street, nm, F.lit(", USA")))
        .otherwise(F.concat(street, F.lit("Elsewhere")))
    )
    parsed = addresses.formatted_address(text)
    return table(spark, sf, "customer").select(
        k.alias("k"), parsed["city"].alias("city"), parsed["state"].alias("state")
    )


@query(
    "f12_directory_address",
    f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'St. ' || c_mktsegment ELSE '' END AS city,
    CASE WHEN c_custkey % 2 = 0 THEN {STATE_LIST_SQL}[c_nationkey + 1] ELSE '' END AS state FROM customer""",
)
def f12(spark, sf):
    st = F.element_at(F.array(*[F.lit(c) for _, c, _ in addresses.STATES]), F.col("c_nationkey") + 1)
    k = F.col("c_custkey")
    text = F.when(
        k % 2 == 0, F.concat(F.lit("12 Main, St. "), F.col("c_mktsegment"), F.lit(", "), st, F.lit(", 12345, US"))
    ).otherwise(F.concat(F.lit("no place, "), F.lower(st)))
    parsed = addresses.directory_address(text)
    return table(spark, sf, "customer").select(
        k.alias("k"), parsed["city"].alias("city"), parsed["state"].alias("state")
    )


@query(
    "f13_name_place_hint",
    f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 < 2 THEN 'Port ' || c_mktsegment END AS city,
    CASE WHEN c_custkey % 3 = 0 THEN {STATE_LIST_SQL}[c_nationkey + 1] END AS state FROM customer""",
)
def f13(spark, sf):
    st = F.element_at(F.array(*[F.lit(c) for _, c, _ in addresses.STATES]), F.col("c_nationkey") + 1)
    k, place = F.col("c_custkey"), F.concat(F.lit("House of Port "), F.col("c_mktsegment"))
    name = F.when(k % 3 == 0, F.concat(place, F.lit(", "), F.lower(st))).when(k % 3 == 1, place).otherwise(F.col("c_name"))
    hint = addresses.name_place_hint(name)
    return table(spark, sf, "customer").select(k.alias("k"), hint["city"].alias("city"), hint["state"].alias("state"))


@query(
    "f14_address_candidates",
    """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS addr,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS city,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('N', c_nationkey) END AS st FROM customer),
    q AS (SELECT k, list_filter([addr || ', ' || city || ', ' || st, addr || ', ' || st, addr],
        lambda x: x IS NOT NULL) AS c FROM a WHERE addr <> ''),
    u AS (SELECT k, c, unnest(range(1, len(c) + 1)) AS rank FROM q)
    SELECT k, CAST(rank AS INTEGER) AS rank, c[rank] AS candidate FROM u""",
)
def f14(spark, sf):
    k = F.col("c_custkey")
    addr = F.when(k % 5 == 0, "Not  listed").otherwise(F.concat("c_name", F.lit(" , ")))
    addr = F.when(k % 5 == 0, addr).otherwise(F.concat("c_name", F.lit(",")))
    city = F.when(k % 3 != 0, F.col("c_mktsegment"))
    st = F.when(k % 4 != 0, F.concat(F.lit("N"), "c_nationkey"))
    c = table(spark, sf, "customer").select(k.alias("k"), F.posexplode(addresses.address_candidates(addr, city, st)))
    return c.select("k", (F.col("pos") + 1).alias("rank"), F.col("col").alias("candidate"))


FIPS_SQL = "MAP {" + ", ".join(f"'{f}': '{c}'" for _, c, f in addresses.STATES) + "}"


@query(
    "f15_district_id",
    f"""SELECT c_custkey AS k, concat(coalesce(({FIPS_SQL})[lpad(CAST(c_nationkey AS VARCHAR), 2, '0')],
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0')), '-', CASE WHEN c_custkey % 4 = 0 THEN '0'
        ELSE CAST(c_custkey % 53 AS VARCHAR) END) AS by_fips,
    concat(c_mktsegment, '-', CAST(c_custkey % 53 AS VARCHAR)) AS by_code FROM customer""",
)
def f15(spark, sf):
    k = F.col("c_custkey")
    number = F.when(k % 4 == 0, "at large").otherwise((k % 53).cast("string"))
    decimal = F.concat((k % 53).cast("string"), F.lit(".0"))
    return table(spark, sf, "customer").select(
        k.alias("k"),
        addresses.district_id(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), number, True).alias("by_fips"),
        addresses.district_id(F.lower("c_mktsegment"), decimal).alias("by_code"),
    )


@query(
    "f16_tract_geoid",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, concat(lpad(CAST(l_linenumber AS VARCHAR), 2, '0'),
        lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0'), lpad(CAST(l_partkey AS VARCHAR), 6, '0')) AS geoid FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, geoid, left(geoid, 2) AS state_fips, substr(geoid, 3, 3) AS county_fips,
    substr(geoid, 6) AS tract, left(geoid, 5) AS county FROM g""",
)
def f16(spark, sf):
    geoid = addresses.tract_geoid(
        F.col("l_linenumber").cast("string"),
        (F.col("l_suppkey") % 1000).cast("string"),
        F.col("l_partkey").cast("string"),
    )
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", geoid.alias("geoid"))
        .select("*", addresses.tract_parts(F.col("geoid")).alias("p"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "geoid", "p.*")
    )


# ---- values ----------------------------------------------------------------


@query(
    "f17_clean_int_sum",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_quantity - 25) * 100000 AS BIGINT) AS x,
        CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_suppkey AS BIGINT) END AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x >= -1000000 THEN x END AS a, y AS b,
    CASE WHEN x >= -1000000 OR y IS NOT NULL THEN coalesce(CASE WHEN x >= -1000000 THEN x END, 0) + coalesce(y, 0) END AS total
    FROM r""",
)
def f17(spark, sf):
    a = values.clean_int(((F.col("l_quantity") - 25) * 100000).cast("bigint").cast("string"))
    b = values.clean_int(F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_suppkey").cast("string")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"), values.sum_present([a, b]).alias("total")
    )


def _lang_sql() -> str:
    v = "CASE WHEN (l_partkey + {i}) % 3 = 0 THEN NULL ELSE (l_suppkey * {i}) % 97 END"
    out = []
    for name, (lo, hi) in values.LANGUAGE_GROUPS.items():
        parts = ", ".join(v.format(i=i) for i in range(lo, hi + 1))
        out.append(f"CAST(list_sum(list_filter([{parts}], lambda x: x IS NOT NULL)) AS BIGINT) AS {name}")
    return "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(out) + " FROM lineitem"


@query("f18_language_groups", _lang_sql())
def f18(spark, sf):
    var = {
        i: F.when((F.col("l_partkey") + i) % 3 == 0, "-666666666").otherwise(((F.col("l_suppkey") * i) % 97).cast("string"))
        for i in range(1, 27)
    }
    groups = [c.alias(n) for n, c in values.language_groups(var).items()]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *groups)


COMMUTING_SQL = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in values.COMMUTING_LABELS.items()) + "}"


@query(
    "f19_commuting_code",
    f"""SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_size END AS code,
    CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE ({COMMUTING_SQL})[p_size] END AS label
    FROM part WHERE p_size % 7 <> 0""",
)
def f19(spark, sf):
    raw = F.when(F.col("p_brand") == "Brand#1", " ").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    geoid = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    geoid = F.when(F.col("p_size") % 7 == 0, F.substring(geoid, 1, 10)).otherwise(geoid)
    code = values.commuting_code(raw)
    return (
        table(spark, sf, "part")
        .where(F.length(geoid) == 11)
        .select("p_partkey", code.alias("code"), values.commuting_label(code).alias("label"))
    )


@query(
    "f24_plausible_date",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 2027
    THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def f24(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 4 == 2, F.date_format(d, "yyyyMMdd"))
        .otherwise(F.date_format(d, "yyyy-MM-dd 'noon'"))
    )
    return table(spark, sf, "orders").select("o_orderkey", values.plausible_date(text).alias("day"))


@query(
    "f23_page_date",
    """WITH d AS (SELECT page_id, DATE '1990-01-01' + CAST((page_id * 131) % 9000 AS INTEGER) AS a,
        DATE '1990-01-01' + CAST((page_id * 57) % 9000 AS INTEGER) AS b FROM pages)
    SELECT page_id, greatest(CASE WHEN year(a) >= 1995 THEN strftime(a, '%Y-%m-%d') END,
    CASE WHEN year(b) >= 1995 THEN strftime(b, '%Y-%m-%d') END) AS day FROM d""",
)
def f23(spark, sf):
    day = lambda m: F.date_format(
        F.date_add(F.lit("1990-01-01").cast("date"), ((F.col("page_id") * m) % 9000).cast("int")), "yyyy-MM-dd"
    )
    html = F.concat(
        F.lit('<meta content="'), day(131), F.lit('" property="article:modified_time">'),
        F.lit('<script type="application/ld+json">{"x": [{"datePublished": "'), day(57),
        F.lit('T10:00:00+02:00"}]}</script><script type="application/ld+json">{"dateModified": "2020-01-01",}</script>'),
        F.col("html"),
    )
    return table(spark, sf, "pages").select("page_id", pages.page_date(html).alias("day"))


@query(
    "f25_best_dated_source",
    """WITH d AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS x,
        strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS y FROM orders),
    c AS (SELECT k, CASE WHEN k % 2 = 0 THEN x END AS meta, CASE WHEN k % 3 = 0 THEN y END AS feed,
        CASE WHEN k % 5 = 0 THEN x END AS wp, CASE WHEN k % 7 = 0 THEN y END AS http FROM d)
    SELECT k, coalesce(greatest(meta, feed, wp), http) AS day, CASE WHEN meta = greatest(meta, feed, wp) THEN 'meta'
    WHEN feed = greatest(meta, feed, wp) THEN 'feed' WHEN wp = greatest(meta, feed, wp) THEN 'wp'
    WHEN http IS NOT NULL THEN 'http_header' END AS source FROM c""",
)
def f25(spark, sf):
    k = F.col("o_orderkey")
    x = F.date_format("o_orderdate", "yyyy-MM-dd")
    y = F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")
    best = values.best_dated_source(
        [("meta", F.when(k % 2 == 0, x)), ("feed", F.when(k % 3 == 0, y).otherwise("")), ("wp", F.when(k % 5 == 0, x))],
        ("http_header", F.when(k % 7 == 0, y)),
    )
    return table(spark, sf, "orders").select(k.alias("k"), best["date"].alias("day"), best["source"].alias("source"))


# ---- page text -------------------------------------------------------------


def _quick_text_sql() -> str:
    e = "html"
    for tag in ("script", "style", "noscript", "head"):
        e = rf"regexp_replace({e}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    e = f"regexp_replace({e}, '(?s)<!--.*?-->', ' ', 'g')"
    e = f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "''"),
                 ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        e = f"replace({e}, '{a}', '{b}')"
    return rf"SELECT page_id, trim(regexp_replace({e}, '[ \t\n\r\f]+', ' ', 'g')) AS content_text FROM pages"


@query("f20_quick_text", _quick_text_sql())
def f20_quick(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.quick_text(F.col("html")).alias("content_text"))


def _node_text_sql() -> str:
    e = "coalesce(html, '')"
    for tag in ("script", "style", "noscript", "head"):
        e = rf"regexp_replace({e}, '(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)', '<>', 'g')"
    e = rf"regexp_replace({e}, '(?s)<!--.*?(?:-->|\z)', '<>', 'g')"
    node = "n"
    for a, b in pages.ENTITIES:
        node = "replace({}, '{}', '{}')".format(node, a, b.replace("'", "''"))
    node = rf"regexp_replace({node}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
    nodes = rf"list_transform(string_split_regex({e}, '(?s)</?[a-zA-Z!?][^>]*>|<>'), lambda n: {node})"
    return f"SELECT page_id, array_to_string(list_filter({nodes}, lambda n: n <> ''), ' ') AS content_text FROM pages"


@query("f20_page_text", _node_text_sql())
def f20(spark, sf):
    return pages.page_text(spread(table(spark, sf, "pages")).select("page_id", "html"))


# ---- labels ----------------------------------------------------------------

PART_RULES = (("metal", ("steel", "anodized")), ("small parts", ("ring", "gasket", "econ")), ("devices", ("widget", "gadget")))
PART_RULE_SQL = """CASE WHEN {0} IN ('', 'other', 'na', 'n/a') THEN 'Other'
    WHEN contains({0}, 'steel') OR contains({0}, 'anodized') THEN 'metal'
    WHEN contains({0}, 'ring') OR contains({0}, 'gasket') OR contains({0}, 'econ') THEN 'small parts'
    WHEN contains({0}, 'widget') OR contains({0}, 'gadget') THEN 'devices' ELSE '??UNMAPPED' END"""


@query("f26_pure_label", with_views("label_text", "SELECT id, string_split(raw, '_')[-1] AS pure FROM label_text"))
def f26(spark, sf):
    return t.label_text(spark, sf).select("id", labels.pure_label(F.col("raw")).alias("pure"))


@query(
    "f27_rule_bucket",
    with_views(
        "label_text",
        f"SELECT id, {PART_RULE_SQL.format('s')} AS bucket FROM "
        "(SELECT id, lower(trim(string_split(raw, '_')[-1])) AS s FROM label_text)",
    ),
)
def f27(spark, sf):
    bucket = labels.rule_bucket(labels.pure_label(F.col("raw")), PART_RULES)
    return t.label_text(spark, sf).select("id", bucket.alias("bucket"))


@query(
    "f28_major_category",
    with_views(
        "label_text",
        f"""SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE nullif({PART_RULE_SQL.format('s')}, '??UNMAPPED') END AS major
        FROM (SELECT id, lower(trim(string_split(raw, '_')[-1])) AS s FROM label_text)""",
    ),
)
def f28(spark, sf):
    raw = F.when(F.col("id") % 10 == 0, "N/A").when(F.col("id") % 5 == 0, "").otherwise(F.col("raw"))
    return t.label_text(spark, sf).select("id", labels.major_category(raw, PART_RULES).alias("major"))


@query(
    "f29_canonical_label",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN initcap_(c_mktsegment)
    ELSE 'Unknown' END AS label FROM customer""".replace("initcap_(c_mktsegment)",
    "concat(upper(left(c_mktsegment, 1)), lower(substr(c_mktsegment, 2)))"),
)
def f29(spark, sf):
    noisy = F.concat(F.lit(' "'), F.col("c_mktsegment"), F.lit('." '))
    return table(spark, sf, "customer").select(
        "c_custkey", labels.canonical_label(noisy, ("Building", "Household"), "Unknown").alias("label")
    )


TAXONOMY = ("small ring of steel", "red widget", "red", "large gadget", "economy", "bolt")


@query(
    "f30_taxonomy_match",
    """WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name
        WHEN p_partkey % 3 = 1 THEN string_split(p_name, ' ')[1] ELSE lower(p_type) END AS n FROM part),
    c AS (SELECT * FROM (VALUES (0, 'small ring of steel'), (1, 'red widget'), (2, 'red'), (3, 'large gadget'),
        (4, 'economy'), (5, 'bolt')) v(i, c)),
    s AS (SELECT n, i, c, 1 - levenshtein(n, c) / CAST(greatest(length(n), length(c)) AS DOUBLE) AS ratio
        FROM (SELECT DISTINCT n FROM l), c),
    q AS (SELECT n, i, c, ratio, CASE WHEN n = c THEN 1 WHEN starts_with(c, n) THEN 2 WHEN starts_with(n, c) THEN 3
        WHEN ratio >= 0.6 THEN 4 END AS tier FROM s),
    b AS (SELECT n, c AS entry, tier, row_number() OVER (PARTITION BY n ORDER BY tier,
        CASE tier WHEN 2 THEN length(c) WHEN 3 THEN -length(c) WHEN 4 THEN -ratio ELSE 0 END, i) AS rn
        FROM q WHERE tier IS NOT NULL)
    SELECT p_partkey, entry, CAST(tier AS INTEGER) AS tier FROM l LEFT JOIN b ON l.n = b.n AND rn = 1""",
)
def f30(spark, sf):
    k = F.col("p_partkey")
    raw = F.concat(
        F.lit("Group_"),
        F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.split("p_name", " ")[0]).otherwise(F.col("p_type")),
    )
    noisy = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return labels.taxonomy_match(noisy, "raw", TAXONOMY).select("p_partkey", "entry", "tier")


SEGMENT_MAP = {"building": "Works", "machinery": "Works", "household": "Home"}


@query(
    "f31_mapped_label",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Works'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Home' ELSE 'Unknown' END AS label FROM customer WHERE c_custkey % 3 <> 1""",
)
def f31(spark, sf):
    raw = F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_mktsegment"))
    src = F.when(F.col("c_custkey") % 3 == 0, "tag").when(F.col("c_custkey") % 3 == 1, "review")
    return (
        table(spark, sf, "customer")
        .where(labels.owned_by(src, "tag"))
        .select("c_custkey", labels.mapped_or_unknown(raw, SEGMENT_MAP).alias("label"))
    )


VERDICTS = {"BUILDING": "Works", "HOUSEHOLD": "Home"}


@query(
    "f36_review_verdict",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'delete' WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
    THEN 'label' ELSE 'skip' END AS action, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING'
    THEN 'Works' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Home' END AS label FROM customer""",
)
def f36(spark, sf):
    notes = F.when(F.col("c_custkey") % 4 == 0, "please Remove, closed").when(F.col("c_custkey") % 4 == 1, "removed")
    v = labels.review_verdict(F.col("c_mktsegment"), notes, VERDICTS)
    return table(spark, sf, "customer").select("c_custkey", v["action"].alias("action"), v["label"].alias("label"))


@query(
    "f37_feature_type",
    """WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
    g AS (SELECT event_id, ['forest','landfill','industrial','military','residential','quarry'][k % 6 + 1] AS landuse,
        ['mine','factory','slaughterhouse','other'][k % 4 + 1] AS industrial,
        CASE WHEN k % 11 = 0 THEN 'primary' END AS highway FROM k),
    c AS (SELECT event_id, CASE WHEN highway = 'primary' THEN 'highway_primary' WHEN landuse = 'military' THEN 'military'
        WHEN industrial = 'slaughterhouse' THEN 'abattoir' WHEN landuse = 'landfill' THEN 'landfill'
        WHEN landuse = 'quarry' OR industrial = 'mine' THEN 'env_hazard'
        WHEN landuse = 'industrial' OR industrial = 'factory' THEN 'industrial'
        WHEN landuse = 'forest' THEN 'green_space' END AS feature FROM g)
    SELECT event_id, feature FROM c WHERE feature IS NOT NULL""",
)
def f37(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda vals: F.element_at(F.array(*map(F.lit, vals)), k % len(vals) + 1)
    tags = F.create_map(
        F.lit("landuse"), pick(["forest", "landfill", "industrial", "military", "residential", "quarry"]),
        F.lit("industrial"), pick(["mine", "factory", "slaughterhouse", "other"]),
        F.lit("highway"), F.when(k % 11 == 0, "primary"),
    )
    return (
        table(spark, sf, "events")
        .select("event_id", labels.feature_type(tags).alias("feature"))
        .where(F.col("feature").isNotNull())
    )


# ---- geometry and numbers ---------------------------------------------------

HAV_SQL = """12742.0 * asin(sqrt(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1}))
    * pow(sin(radians({3} - {2}) / 2), 2)))"""


@query(
    "f39_haversine",
    with_views(
        "geo",
        f"""SELECT a.id, round({HAV_SQL.format('a.lat', 'b.lat', 'a.lon', 'b.lon')}, 6) AS km
        FROM geo a JOIN geo b ON b.id = a.id + 1""",
    ),
)
def f39(spark, sf):
    g = t.geo(spark, sf)
    nxt = g.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return g.join(nxt, "id").select("id", F.round(km, 6).alias("km"))


@query(
    "f40_grid_cell",
    with_views(
        "geo",
        """SELECT CAST(floor(lat / 0.5) AS BIGINT) AS gi, CAST(floor(lon / 0.5) AS BIGINT) AS gj, count(*) AS n
        FROM geo GROUP BY ALL""",
    ),
)
def f40(spark, sf):
    gi, gj = geo.grid_cell(F.col("lat"), F.col("lon"), 0.5)
    return t.geo(spark, sf).groupBy(gi.alias("gi"), gj.alias("gj")).agg(F.count("*").alias("n"))


@query(
    "f41_mercator_pixel",
    with_views(
        "geo",
        """SELECT id, round((lon + 180.0) / 360.0 * 4096.0, 6) AS px,
        round((0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * 4096.0, 6) AS py FROM geo""",
    ),
)
def f41(spark, sf):
    zoom = geo.fit_zoom(1100, 700, (24.0, 49.0), (-125.0, -66.0))
    px, py = geo.mercator_pixel(F.col("lat"), F.col("lon"), zoom)
    return t.geo(spark, sf).select("id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(
    "f42_transforms",
    """SELECT event_id, round(ln(1 + abs(value)), 6) AS log1p_v, round(log10(abs(value) / 1000 + 0.01), 6) AS log_km
    FROM events""",
)
def f42(spark, sf):
    v = F.abs("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(F.log1p(v), 6).alias("log1p_v"), F.round(values.log_km(v / 1000), 6).alias("log_km")
    )


@query(
    "f43_distance_tier",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 1250 <= 25000 THEN 'close'
    WHEN l_quantity * 1250 <= 50000 THEN 'medium' ELSE 'far' END AS tier FROM lineitem""",
)
def f43(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values.distance_tier(F.col("l_quantity") * 1250).alias("tier")
    )


@query(
    "f44_merge_values",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'BUILDING' ELSE c_mktsegment END AS grp FROM customer",
)
def f44(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", values.merge_values(F.col("c_mktsegment"), {"MACHINERY": "BUILDING"}).alias("grp")
    )


@query(
    "f45_map_points",
    with_views(
        "geo",
        """SELECT id, lat, lon, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'BUILDING' ELSE c_mktsegment END AS grp
        FROM geo JOIN customer ON c_custkey = id WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal >= 0""",
    ),
)
def f45(spark, sf):
    points = (
        t.geo(spark, sf)
        .join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("id"))
        .select("id", F.when(F.col("c_acctbal") >= 0, F.col("lat")).alias("lat"), "lon", F.col("c_mktsegment").alias("grp"))
    )
    return rollups.map_points(points, "lat", "lon", "grp", unknown="FURNITURE", merge={"MACHINERY": "BUILDING"})


@query(
    "f46_size_factor",
    with_views(
        "entity",
        """+ s AS (SELECT state, count(*) AS n FROM entity GROUP BY state)
        SELECT state, n, round(greatest(sqrt(n / CAST((SELECT max(n) FROM s) AS DOUBLE)), 0.12), 6) AS factor FROM s""",
    ),
)
def f46(spark, sf):
    s = t.entity(spark, sf).groupBy("state").agg(F.count("*").alias("n"))
    largest = s.select(F.max("n")).scalar()
    return s.select("state", "n", F.round(values.size_factor(F.col("n"), largest), 6).alias("factor"))

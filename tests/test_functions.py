"""Column functions against plain Python or hand-made values."""

import re
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from almanac import presets
from almanac.functions import addresses, geo, labels, names, pages, urls, values


def each(spark, rows, schema, **cols):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()


def test_normal_name_equals_nfd_rule(spark):
    rows = ["Café  Ñandú", "école", "Straße-1", "İstanbul K", "  A.B ", "Łódź", "Ạ̣x", "日本 1", ""]

    def rule(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower()
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", s)).strip()

    got = each(spark, rows, "s string", n=names.normal_name(F.col("s")))
    assert [r.n for r in got] == [rule(s) for s in rows]


def test_name_match_rule(spark):
    stop = presets.FILL_STOP_WORDS
    rows = [("hill house", "house of the hill"), ("a b c", "a b d"), ("the center", "the center"), ("the center", "of"), ("x y z", "x y q")]
    got = each(spark, rows, "a string, b string", m=names.names_match(F.col("a"), F.col("b"), stop), s=names.token_share(names.name_tokens(F.col("a"), stop), names.name_tokens(F.col("b"), stop)))
    assert [r.m for r in got] == [True, False, True, False, True]
    assert got[3].s is None


def test_url_keys(spark):
    rows = ["https://www.Ex.org:80/A/", "ex.org/", "http://u@www.ex.org:8/x?y#z", "WWW.EX.ORG"]
    got = each(spark, rows, "u string", d=urls.normal_domain(F.col("u")), s=urls.strict_domain(F.col("u")), k=urls.domain_path(F.col("u")))
    assert [r.d for r in got] == ["ex.org:80", "ex.org", "u@www.ex.org:8", "www.ex.org"]
    assert [r.s for r in got] == ["ex.org", "ex.org", "ex.org", "ex.org"]
    assert [r.k for r in got] == ["Ex.org:80/A/", "", "u@www.ex.org:8/x", ""]


def test_canonical_page_key(spark):
    rows = ["Ex.org/a/index.html", "ex.org/a/", "ex.org/a.PHP?x=1", "ex.org/a.-_", "ex.org/a/index.htm#t", "ex.org/a.b"]
    got = each(spark, rows, "u string", k=urls.canonical_page_key(F.col("u")))
    assert [r.k for r in got] == ["ex.org/a", "ex.org/a", "ex.org/a", "ex.org/a", "ex.org/a", "ex.org/a.b"]


def test_agreement_key_and_variants(spark):
    rows = ["http://www.ex.org/A%20b/index.html", "ex.org", "http://ex.org/index", "http://ex.org/x+y.htm/"]
    got = each(spark, rows, "u string", k=urls.agreement_page_key(F.col("u")), v=urls.path_variants(F.col("u")))
    assert [r.k for r in got] == ["ex.org/a b", "ex.org", "ex.org", "ex.org/x+y"]
    assert got[1].v == ["ex.org", "ex.org/index.html", "ex.org.html"]


@pytest.mark.parametrize("base", ["http://ex.org/a/b?q=1", "https://ex.org", "http://ex.org/a/b/"])
def test_links_resolve_like_urljoin(spark, base):
    hrefs = ["c", "../d", "/e/./f", "?z", "//other.org/x", "http://ex.org/g#h", "./", "..", "i/../j", "/k/.."]
    got = each(spark, [(base, h) for h in hrefs], "b string, h string", u=urls.resolve_link(F.col("b"), F.col("h")))
    assert [r.u for r in got] == [urljoin(base, h).split("#")[0] for h in hrefs]


def test_internal_links(spark):
    html = """<a class=x href="/p.html">1</a><A HREF='q'>2</A><a href="#t">3</a><a href=mailto:x@y>4</a><a href="/i.PDF">5</a>
    <a href="http://other.org/">6</a><a href="http://www.ex.org/r#u">7</a><a name="z">8</a>"""
    got = each(spark, [(html, "http://ex.org/a/b")], "h string, u string", l=urls.internal_links(F.col("h"), F.col("u")))
    assert got[0].l == ["http://ex.org/p.html", "http://ex.org/a/q", "http://www.ex.org/r"]


def test_storage_key(spark):
    rows = ["http://ex.org/", "http://ex.org/a b/c.pdf?x=1", "http://ex.org/a/.html"]
    got = each(spark, rows, "u string", k=urls.storage_key(F.col("u")))
    assert got[0].k == "index.html" and re.fullmatch(r"a_b/c_[0-9a-f]{8}\.html", got[1].k)


def test_addresses(spark):
    rows = ["1 A St, Paris, TX 75460, USA", "Rural, Bend, Oregon", "Somewhere in Ohio", "Toronto, Canada"]
    got = each(spark, rows, "a string", p=addresses.formatted_address(F.col("a")))
    assert [(r.p.city, r.p.state) for r in got] == [("Paris", "TX"), ("Bend", "OR"), ("", "OH"), (None, None)]
    hint = each(spark, ["House of Fountain Hills AZ", "Friends of Bend,", "Nothing"], "n string", h=addresses.name_place_hint(F.col("n")))
    assert [(r.h.city, r.h.state) for r in hint] == [("Fountain Hills", "AZ"), ("Bend", None), (None, None)]


def test_sentinels_and_sums(spark):
    got = each(spark, [("-666666666", "3"), ("x", None), ("-5", "7")], "a string, b string", a=values.clean_int(F.col("a")),
               s=values.sum_present([values.clean_int(F.col("a")), values.clean_int(F.col("b"))]))
    assert [(r.a, r.s) for r in got] == [(None, 3), (None, None), (-5, 2)]


def test_dates(spark):
    rows = ["Tue, 05 Mar 2019 10:00:00 GMT", "2019-03-05T23:00:00-05:00", "1990-01-01", "2030-01-01", "20190305", "5 Mar 2019 x", "2019-13-40", "junk", ""]
    got = each(spark, rows, "d string", d=values.plausible_date(F.col("d")))
    assert [r.d for r in got] == ["2019-03-05", "2019-03-05", None, None, "2019-03-05", "2019-03-05", None, None, None]


def test_best_date_ties_to_first(spark):
    rows = [("2020-01-01", "2020-01-01", "", "2021-01-01"), ("", "", "", "2019-05-05"), ("", "2020-01-01", "2021-01-01", "")]
    best = values.best_dated_source([("meta", F.col("a")), ("feed", F.col("b")), ("wp", F.col("c"))], ("http", F.col("d")))
    got = each(spark, rows, "a string, b string, c string, d string", b=best)
    assert [(r.b.date, r.b.source) for r in got] == [("2020-01-01", "meta"), ("2019-05-05", "http"), ("2021-01-01", "wp")]


def test_page_dates(spark):
    html = """<script type="application/ld+json">{"@graph":[{"dateModified":"2018-02-03T00:00:00Z"}]}</script>
    <script type='application/ld+json'>{"datePublished":"2024-01-01", broken</script><meta name="Date" content="2017-01-01">
    <meta content="2019-06-07" itemprop="dcterms.modified"><meta name="author" content="2025-01-01">"""
    assert each(spark, [html], "h string", d=pages.page_date(F.col("h")))[0].d == "2019-06-07"


def test_page_text(spark):
    html = "<html><head><title>T</title></head><body> a &amp; b<p>c  d</p><script>x<y</script><!-- n --><noscript>q</noscript>e\x00</body>"
    df = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    got = {r.id: r.content_text for r in pages.page_text(df).collect()}
    assert got == {1: "a & b c  d e", 2: ""}


def test_ordered_rules_first_bucket_wins(spark):
    rows = ["Plant rain garden near community garden for native birds", "N/A", "", "Other", "mystery", "x_y_Provides Fresh Vegetables"]
    bucket = labels.rule_bucket(labels.pure_label(F.col("s")), presets.CATEGORY_RULES)
    got = each(spark, rows, "s string", b=bucket, m=labels.major_category(F.col("s"), presets.CATEGORY_RULES))
    assert [r.b for r in got] == ["Water", "Other", "Other", "Other", labels.UNMAPPED, "Kitchen"]
    assert [r.m for r in got] == ["Water", None, None, "Other", None, "Kitchen"]
    with pytest.raises(Exception, match="no bucket rule"):
        each(spark, ["mystery"], "s string", b=labels.require_mapped(bucket))


def test_review_verdict(spark):
    rows = [("Reform", ""), ("reform", ""), ("Reform", "REMOVE it"), ("progressive", "removed"), ("", None)]
    got = each(spark, rows, "v string, n string", r=labels.review_verdict(F.col("v"), F.col("n"), presets.VERDICTS))
    assert [(r.r.action, r.r.label) for r in got] == [
        ("label", "Reform"), ("skip", None), ("delete", None), ("label", "Non-Denominational Progressive"), ("skip", None)
    ]


def test_feature_rules(spark):
    rows = [({"landuse": "industrial", "industrial": "slaughterhouse"},), ({"industrial": "warehouse"},), ({"leisure": "park"},), ({"amenity": "pub"},)]
    got = each(spark, rows, "t map<string,string>", k=labels.feature_type(F.col("t")))
    assert [r.k for r in got] == ["abattoir", "industrial", "green_space", None]


def test_taxonomy_tiers(spark):
    df = spark.createDataFrame([("A_red widget",), ("A_red w",), ("A_red widget extra",), ("A_rad widgat",), ("N/A",), ("A_zzz",)], "raw string")
    got = {r.raw: (r.entry, r.tier) for r in labels.taxonomy_match(df, "raw", ["red widget", "red widget large", "blue"]).collect()}
    assert got["A_red widget"] == ("red widget", 1) and got["A_red w"] == ("red widget", 2) and got["A_red widget extra"] == ("red widget", 3)
    assert got["A_rad widgat"] == ("red widget", 4) and got["N/A"] == (None, None) and got["A_zzz"] == (None, None)


def test_grid_later_box_replaces_points(spark):
    pts = {(r.lat, r.lon) for r in geo.grid_points(spark, (0.0, 3.0), (0.0, 3.0), 1.0, [(0.9, 2.0, 0.9, 2.0)], 0.5).collect()}
    assert (1.0, 1.0) not in pts and (0.9, 0.9) in pts and (1.9, 1.4) in pts and (0.0, 3.0) in pts and (2.0, 2.0) not in pts
    assert len(pts) == 16 - 4 + 9


def test_distance_tiers_include_upper_edge(spark):
    got = each(spark, [0.0, 25_000.0, 25_000.1, 50_000.0, 50_001.0, float("inf")], "m double", t=values.distance_tier(F.col("m")))
    assert [r.t for r in got] == ["close", "close", "medium", "medium", "far", "far"]

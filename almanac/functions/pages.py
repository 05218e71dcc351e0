"""HTML to text, and dates stated in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.values import plausible_date

_HIDDEN = ("script", "style", "noscript", "head")
# Meta keys that state when a page changed.
META_DATE_KEYS = (
    "article:modified_time", "og:updated_time", "last-modified", "revised", "date", "dcterms.modified",
    "dc.date.modified",
)


# Entities that pages write instead of the character; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"),
    ("&eacute;", "é"), ("&amp;", "&"),
)


def shown(html: Column) -> Column:
    """The markup without hidden elements and comments; a hidden element that is never closed hides the rest."""
    t = html
    for tag in _HIDDEN:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "<>")
    return F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", "<>")


def node_text(html: Column, cap: int | None = None) -> Column:
    """The visible text nodes of a page, trimmed and joined by spaces; empty for null.  ``cap`` keeps a prefix."""

    def decoded(node: Column) -> Column:
        for entity, ch in ENTITIES:
            node = F.replace(node, F.lit(entity), F.lit(ch))
        return F.regexp_replace(node, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")

    nodes = F.transform(F.split(shown(F.coalesce(html, F.lit(""))), r"(?s)</?[a-zA-Z!?][^>]*>|<>", -1), decoded)
    t = F.replace(F.array_join(F.filter(nodes, lambda n: n != ""), " "), F.lit("\x00"), F.lit(""))
    return t if cap is None else F.substring(t, 1, cap)


def page_text(pages: DataFrame, html: str = "html", out: str = "content_text", cap: int | None = None) -> DataFrame:
    """Replace ``html`` by its visible text, without leaving the row."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, node_text(F.col(html), cap).alias(out))


def quick_text(html: Column, cap: int | None = None) -> Column:
    """Fast native variant: markup removed by patterns, common entities decoded, white space squeezed."""
    t = html
    for tag in _HIDDEN:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, ch in (
        ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "'"),
        ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    t = F.replace(t, F.lit("\x00"), F.lit(""))
    t = F.trim(F.regexp_replace(t, "[ \\t\\n\\r\\f]+", " "))
    return t if cap is None else F.substring(t, 1, cap)


def stated_dates(html: Column) -> Column:
    """All date texts a page states about itself: JSON-LD blocks that parse, then meta tags."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1
    )
    parsed = F.filter(blocks, lambda b: F.try_parse_json(F.trim(b)).isNotNull())
    ld = F.flatten(
        F.transform(
            parsed, lambda b: F.regexp_extract_all(b, F.lit(r'"(?i:datemodified|datepublished)"\s*:\s*"([^"]*)"'), 1)
        )
    )
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), 0)

    def attr(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf'(?i)(?<![\w:.\-]){name}\s*=\s*"([^"]*)"', 1)

    def key(tag: Column) -> Column:
        named = [F.nullif(attr(tag, a), F.lit("")) for a in ("property", "name", "itemprop")]
        return F.lower(F.coalesce(*named, F.lit("")))

    meta = F.transform(F.filter(tags, lambda t: key(t).isin(*META_DATE_KEYS)), lambda t: attr(t, "content"))
    return F.concat(ld, meta)


def page_date(html: Column) -> Column:
    """Latest plausible date a page states, as ``yyyy-MM-dd``."""
    return F.array_max(F.transform(stated_dates(html), lambda d: plausible_date(d)))

"""URL keys, link extraction and URL rules as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types that are never fetched as pages.
SKIP_EXTENSIONS = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp3", ".mp4", ".zip", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx", ".css", ".js", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".map",
)
# Page file types folded away by the canonical key.
PAGE_EXTENSIONS = ("html", "htm", "php", "asp", "aspx", "cfm", "shtml")
# Social hosts whose links never identify one owner.
SOCIAL_DOMAINS = (
    "facebook.com", "m.facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "youtube.com",
    "youtu.be", "linkedin.com", "tiktok.com", "pinterest.com", "linktr.ee",
)
# Path words that raise a page's reading priority.
PRIORITY_WORDS = (
    "about", "who-we-are", "who_we_are", "whoweare", "belief", "denomination", "affiliat", "congregation",
    "welcome", "mission", "clergy", "rabbi", "our-", "history", "membership", "join",
)

_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)"


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _drop_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def normal_domain(url: Column) -> Column:
    """Host (with any port), or the whole string when there is none; no ``www.``, lower, no final slash."""
    host = netloc(url)
    return F.regexp_replace(F.lower(_drop_www(F.when(host == "", url).otherwise(host))), "/+$", "")


def strict_domain(url: Column) -> Column:
    """Bare host: user info and port dropped too; null when nothing is left."""
    u = F.lower(F.trim(url))
    host = netloc(F.when(u.contains("://"), u).otherwise(F.concat(F.lit("http://"), u)))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":.*$", "")
    return F.nullif(_drop_www(host), F.lit(""))


def domain_path(url: Column, lower_host: bool = False) -> Column:
    """``domain/path`` key of an absolute http link, blank otherwise."""
    u = F.trim(url)
    host = F.lower(netloc(u)) if lower_host else netloc(u)
    path = F.regexp_replace(url_path(u), "^/+", "")
    key = F.when(path == "", _drop_www(host)).otherwise(F.concat_ws("/", _drop_www(host), path))
    return F.when(u.startswith("http"), key).otherwise(F.lit(""))


def _strip_tail(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"[.,_~\-]+$", "")


def canonical_page_key(path: Column) -> Column:
    """One key for all spellings of a page: query, trailing slash, punctuation, index file, page extension."""
    p = _strip_tail(F.regexp_extract(F.lower(F.trim(path)), "^([^?#]*)", 1))
    index = "/index\\.html?$"
    p = F.when(p.rlike(index), _strip_tail(F.regexp_replace(p, index, ""))).otherwise(p)
    ext = r"\.(" + "|".join(PAGE_EXTENSIONS) + ")$"
    return F.when(p.rlike(ext), _strip_tail(F.regexp_replace(p, ext, ""))).otherwise(p)


def agreement_page_key(url: Column) -> Column:
    """Host plus decoded path without ``.html``/``.htm`` and ``/index``."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    u = F.when(u == "", u).when(u.startswith("http"), u).otherwise(F.concat(F.lit("http://"), u))
    raw = url_path(u)
    path = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    path = F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"\.html?$", "")
    return F.concat(_drop_www(netloc(u)), F.regexp_replace(path, "/index$", ""))


def path_variants(base: Column) -> Column:
    """The spellings under which one labelled page may be stored."""
    stem = F.regexp_replace(base, "/+$", "")
    return F.array_distinct(
        F.array(base, stem, F.concat(stem, F.lit("/index.html")), F.concat(stem, F.lit(".html")))
    )


def file_extension(path: Column) -> Column:
    """Lower-case extension of the last path part, dot included; blank when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def storage_key(url: Column) -> Column:
    """File path for a page: safe characters, ``.html`` suffix, short hash of the query."""
    path = F.regexp_replace(url_path(url), "^/+|/+$", "")
    path = F.regexp_replace(F.when(path == "", F.lit("index")).otherwise(path), "[^a-zA-Z0-9/._-]", "_")
    skip = file_extension(path).isin(*SKIP_EXTENSIONS)
    path = F.when(skip, F.regexp_replace(path, r"\.[^./]*$", "")).otherwise(path)
    path = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", "")
    query = url_query(url)
    suffix = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("_"), F.substring(F.md5(query), 1, 8)))
    return F.concat(path, suffix, F.lit(".html"))


def _squash_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` parts of an absolute path."""
    parts = F.split(path, "/")
    last_is_dir = path.rlike(r"(^|/)\.{1,2}$")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when((p == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(p == "..", acc)
        .otherwise(F.array_append(acc, p)),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last_is_dir, F.lit("/")).otherwise(F.lit("")))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page ``base``, without the fragment."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    hpath, tail = F.regexp_extract(h, r"^([^?]*)", 1), F.regexp_extract(h, r"^[^?]*(\?.*)?$", 1)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(h.startswith("?"), F.concat(root, url_path(base), h))
        .when(h.startswith("/"), F.concat(root, _squash_dots(hpath), tail))
        .otherwise(F.concat(root, _squash_dots(F.concat(folder, hpath)), tail))
    )


_HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_hrefs(html: Column) -> Column:
    """Raw ``href`` values of all anchors, in page order."""
    raw = F.regexp_extract_all(html, F.lit(_HREF), 1)
    return F.transform(raw, lambda h: F.trim(F.regexp_replace(h, "^[\"']|[\"']$", "")))


def internal_links(html: Column, url: Column) -> Column:
    """Absolute links of a page that stay on its own domain and may be pages."""
    usable = F.filter(
        page_hrefs(html),
        lambda h: ~((h == "") | h.startswith("#") | h.startswith("mailto:") | h.startswith("tel:")),
    )
    home = _drop_www(F.lower(netloc(url)))
    links = F.transform(usable, lambda h: resolve_link(url, h))
    return F.filter(
        links,
        lambda u: (_drop_www(F.lower(netloc(u))) == home) & ~file_extension(url_path(u)).isin(*SKIP_EXTENSIONS),
    )


def url_rule_bucket(url: Column, domain: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Bucket of the first (pattern, bucket) rule found in domain or URL; null when none is."""
    text = F.lower(F.concat(F.coalesce(domain, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))
    out = F.when(text.rlike(rules[0][0]), F.lit(rules[0][1]))
    for pattern, bucket in rules[1:]:
        out = out.when(text.rlike(pattern), F.lit(bucket))
    return out


def is_platform(url: Column, domain: Column, hosts: Sequence[str] = SOCIAL_DOMAINS) -> Column:
    """Domain is a shared host, or a malformed URL mentions one."""
    low = F.lower(F.coalesce(url, F.lit("")))
    flag = F.coalesce(domain, F.lit("")).isin(*hosts)
    for h in hosts:
        flag = flag | low.contains(h)
    return flag


def page_priority(path: Column, words: Sequence[str] = PRIORITY_WORDS) -> Column:
    """Home pages score 5; each priority word in the path adds 2."""
    p = F.lower(F.coalesce(path, F.lit("")))
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    home = p.endswith("/index.html") | p.endswith("/index.htm") | (slashes <= 1)
    score = F.when(home, 5).otherwise(0)
    for w in words:
        score = score + F.when(p.contains(w), 2).otherwise(0)
    return score

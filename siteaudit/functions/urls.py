"""URL functions as native Column expressions (no UDF).

URLs are split with the RFC 3986 appendix-B pattern via ``regexp_extract``
rather than ``parse_url``: ``parse_url`` raises under ANSI mode and
``try_parse_url`` rejects spaces in paths and ``_`` in hosts, which the
audited tool accepts. Semantics follow Python's ``urlparse``: the scheme is
lower-cased, ``;params`` of the last path segment are not part of the path,
and an empty query or fragment is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteaudit import schema as S

RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(url, idx: int) -> Column:
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), RFC3986, idx)


def url_scheme(url) -> Column:
    return F.lower(_part(url, 2))


def url_has_authority(url) -> Column:
    return _part(url, 3) != ""


def url_netloc(url) -> Column:
    return _part(url, 4)


def url_path_params(url) -> Column:
    return _part(url, 5)


def url_path(url) -> Column:
    """Path without the ``;params`` of its last segment (as urlparse)."""
    return F.regexp_replace(url_path_params(url), r";[^/]*$", "")


def url_query(url) -> Column:
    return _part(url, 7)


def url_fragment(url) -> Column:
    return _part(url, 9)


def url_is_parseable(url) -> Column:
    """False where urlparse raises: unbalanced IPv6 brackets in the netloc."""
    n = url_netloc(url)
    return n.contains("[") == n.contains("]")


def strip_ws(x) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def _add_https(v: Column) -> Column:
    return F.when(v.startswith("http://") | v.startswith("https://"), v).otherwise(F.concat(F.lit("https://"), v))


# U2
def normalize_domain(value) -> Column:
    v = _add_https(F.regexp_replace(strip_ws(value), "/+$", ""))
    return F.concat(url_scheme(v), F.lit("://"), url_netloc(v))


# U3
def normalize_target(value) -> Column:
    """struct<root, prefix>; prefix '' means the whole site."""
    v = _add_https(strip_ws(value))
    path = url_path(v)
    prefix = F.when((path == "") | (path == "/"), F.lit("")).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.struct(F.concat(url_scheme(v), F.lit("://"), url_netloc(v)).alias("root"), prefix.alias("prefix"))


# U5
def bare_host(netloc) -> Column:
    h = F.lower(F.split(_c(netloc), ":", 2).getItem(0))
    return F.when(h.startswith("www."), F.substring(h, 5, 1 << 30)).otherwise(h)


# U6
def same_host(url, root) -> Column:
    return bare_host(url_netloc(url)) == bare_host(url_netloc(root))


def _trimmed_path(url) -> Column:
    p = url_path(url)
    return F.when(p.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(p, r"/+\z", ""))


# U4
def matches_prefix(url, root, prefix) -> Column:
    pre = _c(prefix)
    path = _trimmed_path(url)
    return same_host(url, root) & (
        (pre == "") | (path == pre) | path.startswith(F.concat(pre, F.lit("/"))))


# U7
def canonicalize_url(url) -> Column:
    """Dedup key: lower host, no trailing slash, '/' for empty path, no fragment, query kept."""
    u = _c(url)
    q = url_query(u)
    key = F.concat(url_scheme(u), F.lit("://"), F.lower(url_netloc(u)), _trimmed_path(u),
                   F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.when(F.coalesce(u, F.lit("")) == "", F.lit("")).otherwise(key)


# U8
def normalize_url(url) -> Column:
    """Comparison key of canonical/orphan checks: as U7 but the query is dropped."""
    u = _c(url)
    key = F.concat(url_scheme(u), F.lit("://"), F.lower(url_netloc(u)), _trimmed_path(u))
    return F.when(F.coalesce(u, F.lit("")) == "", F.lit("")).otherwise(key)


def _any_of(texts) -> str:
    """A pattern that finds any of the texts as they are."""
    return "|".join(rf"\Q{t}\E" for t in texts)


# U1
def is_html_url(url) -> Column:
    # one pattern each: a lambda over the list would take the URL apart again for each of its items
    path_bad = F.lower(url_path(url)).rlike(rf"(?:{_any_of(S.SKIP_EXTENSIONS)})\z|{_any_of(S.SKIP_PATH_FRAGMENTS)}")
    query_bad = F.lower(url_query(url)).rlike(_any_of(S.SKIP_QUERY_NEEDLES))
    return url_is_parseable(url) & ~path_bad & ~query_bad


# U9
def resolve_url(base, href) -> Column:
    """``urljoin(base, href)`` for http(s) bases, as a Column.

    Absolute references of another scheme are returned as is; references with
    an authority keep their path; relative paths are merged with the base
    directory, empty inner segments dropped and dot segments resolved.
    """
    b, h = _c(base), _c(href)
    bs, hs = url_scheme(b), url_scheme(h)
    h_auth = url_has_authority(h) & (url_netloc(h) != "")  # '///x' is a path on the base host
    hq, hf = _part(h, 6), _part(h, 8)  # '?query' / '#frag' with their marks
    bq = _part(b, 6)
    hpath = url_path_params(h)
    bpath = url_path_params(b)
    base_dir = F.regexp_replace(bpath, "[^/]*$", "")
    merged = F.when(hpath.startswith("/"), hpath).otherwise(F.concat(base_dir, hpath))
    segs = F.split(merged, "/", -1)
    n = F.size(segs)
    # relative merges keep first and last segment and drop empty inner ones
    inner = F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    segs2 = F.when((n <= 2) | hpath.startswith("/"), segs) \
        .otherwise(F.concat(F.array(segs.getItem(0)), inner, F.array(F.element_at(segs, -1))))
    resolved = F.aggregate(
        segs2, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs2, -1)
    resolved = F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
    joined = F.array_join(resolved, "/")
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    prefix = F.concat(bs, F.lit("://"), url_netloc(b))
    rel = F.when((hpath == "") & (hq == ""), F.concat(prefix, bpath, bq, hf)) \
        .when(hpath == "", F.concat(prefix, bpath, hq, hf)) \
        .otherwise(F.concat(prefix, joined, hq, hf))
    same_scheme = (hs == "") | (hs == bs)
    with_auth = F.concat(bs, F.lit(":"), F.regexp_replace(h, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""))
    return F.when(F.coalesce(h, F.lit("")) == "", b) \
        .when(~same_scheme, h) \
        .when(h_auth, with_auth) \
        .otherwise(rel)


def strip_fragment(url) -> Column:
    return F.split(_c(url), "#", 2).getItem(0)

"""URL column functions (canonical form, validity, domain, keys).

All functions are pure Column -> Column expressions built from Spark SQL
built-ins, so they stay inside whole-stage codegen and need no Python worker.
URLs are split with the RFC 3986 appendix-B regular expression, which is as
lenient as Python's ``urlsplit`` and never throws (``parse_url`` does under ANSI).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B splitter and its group numbers.
RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
G_SCHEME, G_NETLOC, G_PATH, G_QUERY, G_FRAGMENT = 2, 4, 5, 7, 9

# Schemes for which Python's urlunsplit writes "//" even with an
# empty netloc (urllib.parse.uses_netloc), used by the rebuild step.
USES_NETLOC = [
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
    "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
]

# Characters replaced by "_" when a URL becomes a file key.
ILLEGAL_FILE_CHARS = '<>:"/\\|?*'


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_part(col, group: int) -> Column:
    return F.regexp_extract(_c(col), RFC3986, group)


def scheme(col) -> Column:
    return F.lower(url_part(col, G_SCHEME))


def netloc(col) -> Column:
    return url_part(col, G_NETLOC)


def path(col) -> Column:
    return url_part(col, G_PATH)


def query(col) -> Column:
    return url_part(col, G_QUERY)


def py_strip(col) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace (Spark trim only drops spaces)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def form_decode(col) -> Column:
    """``unquote_plus``: '+' is a space, then percent-decoding; a '%' that starts no escape is kept."""
    c = F.regexp_replace(_c(col), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def form_encode(col) -> Column:
    """``quote_plus``: like Java's URLEncoder, except '~' stays literal and '*' is escaped."""
    enc = F.url_encode(_c(col))
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(q) -> Column:
    """Query string as ``urlencode(sorted(parse_qs(q)))``: pairs without '=' and
    blank values are dropped, keys sorted, values keep their order within a key."""
    q = _c(q)
    pieces = F.split(q, "&")
    pairs = F.transform(
        pieces,
        lambda p, i: F.when(
            F.instr(p, "=") > 0,
            F.struct(
                form_decode(F.substring_index(p, "=", 1)).alias("k"),
                i.alias("pos"),
                form_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"),
            ),
        ),
    )
    kept = F.filter(pairs, lambda s: s.isNotNull() & (F.length(s["v"]) > 0))
    ordered = F.array_sort(kept)  # struct order: key, then original position
    encoded = F.transform(ordered, lambda s: F.concat(form_encode(s["k"]), F.lit("="), form_encode(s["v"])))
    return F.when(F.length(q) > 0, F.array_join(encoded, "&")).otherwise(F.lit(""))


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it several times in ``fn`` (a one-element
    array mapped by a lambda): keeps a regex split from being re-evaluated
    for every reference."""
    return F.element_at(F.transform(F.array(value), fn), 1)


_PARAMS_RE = r"^((?:.*/)?[^;/]*)(;[^/]*)?$"


def normalize_url(col) -> Column:
    """Canonical URL.

    lower scheme and host; strip one leading ``www.``; drop ``:80`` on http and
    ``:443`` on https; canonical query (see :func:`canonical_query`); drop one
    trailing '/' of the path unless the path is '/'; drop the fragment.
    null or '' -> ''.
    """
    u = _c(col)
    parts = F.struct(
        F.lower(url_part(u, G_SCHEME)).alias("sch"),
        F.regexp_replace(F.lower(netloc(u)), r"^www\.", "").alias("host"),
        path(u).alias("path"),
        query(u).alias("q"),
    )

    def build(s):
        sch, h = s["sch"], s["host"]
        host = (
            F.when((sch == "http") & h.endswith(":80"), F.substring(h, F.lit(1), F.length(h) - 3))
            .when((sch == "https") & h.endswith(":443"), F.substring(h, F.lit(1), F.length(h) - 4))
            .otherwise(h)
        )
        # urlparse splits ";params" off the last path segment; the trailing-slash rule sees the path only
        split = F.regexp_extract_all(s["path"], F.lit(r"^(?:.*/)?[^;/]*|;[^/]*$"), 0)

        def with_path(pp):
            p0 = F.element_at(pp, 1)
            params = F.coalesce(F.try_element_at(pp, F.lit(2)), F.lit(""))
            p1 = F.when((p0 != "/") & p0.endswith("/"), F.substring(p0, F.lit(1), F.length(p0) - 1)).otherwise(p0)
            p = F.concat(p1, params)
            q = canonical_query(s["q"])
            body = (
                F.when(F.length(host) > 0, F.concat(
                    F.lit("//"), host,
                    F.when((F.length(p) > 0) & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)))
                .when(p.startswith("//"), F.concat(F.lit("//"), p))
                .when((F.length(sch) > 0) & sch.isin(*USES_NETLOC) & ((F.length(p) == 0) | p.startswith("/")),
                      F.concat(F.lit("//"), p))
                .otherwise(p)
            )
            return F.concat(
                F.when(F.length(sch) > 0, F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
                body,
                F.when(F.length(s["q"]) > 0,
                       let(q, lambda qq: F.when(F.length(qq) > 0, F.concat(F.lit("?"), qq)).otherwise(F.lit(""))))
                .otherwise(F.lit("")),
            )

        return let(split, with_path)

    return F.when(u.isNull() | (u == ""), F.lit("")).otherwise(let(parts, build))


def is_valid_url(col) -> Column:
    """Non-empty scheme and host, scheme http or https (case-insensitive)."""
    u = _c(col)
    sch = scheme(u)
    return F.coalesce(
        (F.length(u) > 0) & (F.length(netloc(u)) > 0) & sch.isin("http", "https"), F.lit(False)
    )


def url_domain(col) -> Column:
    """Lower-cased host without userinfo, port and one leading ``www.``."""
    host = F.lower(netloc(_c(col)))
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.substring_index(host, ":", 1)
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def same_domain(a, b) -> Column:
    """C4."""
    return url_domain(a) == url_domain(b)


# Fixed value: URL pattern for free text (http/https followed by URL characters).
TEXT_URL_PATTERN = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"


def extract_urls(col) -> Column:
    """Every http/https URL in free text, in order (array<string>)."""
    return F.regexp_extract_all(_c(col), F.lit(TEXT_URL_PATTERN), 0)


def url_file_key(col) -> Column:
    """Domain + path with illegal file characters as '_', plus ``_q`` and
    8 hex digits of md5(query) when there is a query."""
    u = _c(col)
    repl = "_" * len(ILLEGAL_FILE_CHARS)
    dom = F.translate(netloc(u), ILLEGAL_FILE_CHARS, repl)
    pth_raw = F.regexp_extract(path(u), r"^((?:.*/)?[^;/]*)(;[^/]*)?$", 1)
    pth = F.translate(pth_raw, ILLEGAL_FILE_CHARS, repl)
    base = F.when((F.length(pth_raw) > 0) & (pth_raw != "/"), F.concat(dom, pth)).otherwise(dom)
    q = query(u)
    return F.when(F.length(q) > 0, F.concat(base, F.lit("_q"), F.substring(F.md5(q), 1, 8))).otherwise(base)


def cache_key(url, params=None) -> Column:
    """md5 of the URL, or of ``url?k=v&k=v`` with params (a map) sorted by key."""
    u = _c(url)
    if params is None:
        return F.md5(u)
    m = _c(params)
    kv = F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        "&",
    )
    return F.when(m.isNull() | (F.size(m) == 0), F.md5(u)).otherwise(F.md5(F.concat(u, F.lit("?"), kv)))


def mime_type(col) -> Column:
    """Media type without parameters, trimmed and lower-cased."""
    return F.lower(py_strip(F.split(F.coalesce(_c(col), F.lit("")), ";")[0]))


def resolve_url(base, href) -> Column:
    """RFC 3986 reference resolution (``urljoin``) for the shapes a page
    link takes: absolute, scheme-relative ``//host``, ``/path``, ``?query``,
    ``#frag``, and relative paths (merged with the base directory, with dot
    segments removed)."""
    b, h = _c(base), _c(href)
    h = py_strip(h)
    b_scheme = url_part(b, G_SCHEME)
    b_auth = netloc(b)
    b_path = path(b)
    b_query = url_part(b, 6)
    prefix = F.concat(b_scheme, F.lit("://"), b_auth)
    has_scheme = F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    dir_ = F.regexp_extract(b_path, r"^(.*/)", 1)
    merged = F.concat(F.when(F.length(dir_) > 0, dir_).otherwise(F.lit("/")), h)
    return (
        F.when(h.isNull(), F.lit(None))
        .when(F.length(h) == 0, b)
        .when(F.length(has_scheme) > 0, h)
        .when(h.startswith("//"), F.concat(b_scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(prefix, remove_dot_segments(h)))
        .when(h.startswith("?"), F.concat(prefix, b_path, h))
        .when(h.startswith("#"), F.concat(prefix, b_path, b_query, h))
        .otherwise(F.concat(prefix, remove_dot_segments(merged)))
    )


def remove_dot_segments(p: Column) -> Column:
    """RFC 3986 5.2.4 on the path part (query/fragment untouched), via an
    array fold over the path segments."""
    tail = F.regexp_extract(p, r"^[^?#]*(.*)$", 1)
    only = F.regexp_extract(p, r"^([^?#]*)", 1)
    segs = F.split(only, "/")
    folded = F.aggregate(
        F.slice(segs, 2, 1 << 30),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segs, -1)
    trailing = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(folded, "/"), trailing, tail)


def key_location(col, key: str, override: str | None = None) -> Column:
    """C11: ``scheme://host/<key>.txt`` for a URL, or the given location."""
    u = _c(col)
    if override:
        return F.lit(override)
    return F.concat(url_part(u, G_SCHEME), F.lit("://"), netloc(u), F.lit("/"), F.lit(key), F.lit(".txt"))


def url_host(col) -> Column:
    """Host string (netloc) as sent in a notification payload."""
    return netloc(_c(col))

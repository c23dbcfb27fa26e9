"""HTML column functions that are exact with regular expressions.

These run inside the JVM (no Python worker) and are what the index, SEO and
link operators use at scale. Selector-driven extraction that needs a real
parser lives in :mod:`sitelens.operators.extract` (one ``mapInPandas`` pass).
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.urls import let, py_strip

# Element and space patterns.
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
# scripts, styles and comments in one leftmost-first alternation (one pass)
HIDDEN_RE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
COMMENT_RE = r"(?s)<!--.*?-->"
TAG_RE = r"<[^>]*>"
SPACE_RE = r"[\t\n\x0B\f\r ]+"
SCRIPT_RE = r"(?is)<script\b[^>]*>.*?</script>"
JSONLD_RE = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
LANG_RE = r"(?is)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z0-9_-]+)"
H1_RE = r"(?is)<h1[\s>]"
JS_FRAMEWORK_RE = r"(?i)(react|vue|angular)"
JS_HEAVY_SCRIPT_COUNT = 10

# Character references as HTML5 defines them (the standard library's table). The names it also lists without a
# semicolon decode without one in text; in attributes only where no '=', letter or digit follows.
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_LEGACY = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
_REFERENCE = r"&(?:#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};|(?:" + _LEGACY + ")"
TEXT_REFERENCE_RE, ATTR_REFERENCE_RE = _REFERENCE + ")", _REFERENCE + "(?![=A-Za-z0-9]))"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _decoded(reference: Column) -> Column:
    """The text of one character reference; an unknown name stays as it is."""
    name = F.regexp_extract(reference, r"^&([A-Za-z][A-Za-z0-9]*);?$", 1)
    table = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    dec = F.regexp_extract(reference, r"^&#([0-9]+);?$", 1)
    hexa = F.regexp_extract(reference, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
    code = F.when(dec != "", dec.cast("long")).otherwise(F.conv(hexa, 16, 10).cast("long"))
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD).cast("long")).otherwise(code)), 8, "0")), "UTF-32")
    return F.when(name != "", F.coalesce(F.try_element_at(table, name), reference)).otherwise(char)


def decode_entities(col, attribute: bool = False) -> Column:
    """Named and numeric character references decoded in one pass."""
    pattern = ATTR_REFERENCE_RE if attribute else TEXT_REFERENCE_RE

    def build(s):
        found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(F.split(s, pattern, -1), found, lambda gap, m: F.array(
            gap, F.when(m.isNotNull(), _decoded(m)).otherwise(F.lit(""))))
        return F.when(s.contains("&"), F.array_join(F.flatten(pairs), "")).otherwise(s)

    return let(_c(col), build)


def shown(col) -> Column:
    """The html without scripts, styles and comments (tags inside them are no tags)."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), HIDDEN_RE, " ")


def page_title(col) -> Column:
    """Text of the first <title> (inner tags dropped, entities decoded, stripped); '' if absent."""
    raw = F.regexp_extract(F.coalesce(_c(col), F.lit("")), TITLE_RE, 1)
    return py_strip(decode_entities(F.regexp_replace(raw, TAG_RE, "")))


def visible_text(col) -> Column:
    """Text of the page without script, style, comments and tags, whitespace
    collapsed to single spaces (the regex text path used by the index)."""
    return text_of(shown(col))


def text_of(markup: Column) -> Column:
    """The text of markup that is already without hidden parts."""
    h = decode_entities(F.regexp_replace(markup, TAG_RE, " "))
    return py_strip(F.regexp_replace(h, SPACE_RE, " "))


def hrefs(col) -> Column:
    """Every non-empty ``<a href>`` value in document order (array<string>), entities decoded."""
    values = F.transform(tags(shown(col), "a"), lambda t: attr(t, "href"))
    return F.filter(values, lambda v: v.isNotNull())


def structured_data(col) -> Column:
    """Raw JSON-LD blocks outside comments (array<string>, stripped)."""
    html = F.regexp_replace(F.coalesce(_c(col), F.lit("")), COMMENT_RE, " ")
    blocks = F.regexp_extract_all(html, F.lit(JSONLD_RE), 1)
    return F.transform(blocks, lambda b: py_strip(b))


def _scripts(col) -> Column:
    html = F.regexp_replace(F.coalesce(_c(col), F.lit("")), COMMENT_RE, " ")
    return F.regexp_extract_all(html, F.lit(SCRIPT_RE), 0)


def script_count(col) -> Column:
    return F.size(_scripts(col))


def is_js_heavy(col) -> Column:
    """More than 10 scripts, or a script element (its tag or its text) that names react/vue/angular."""
    return let(_scripts(col), lambda s: (F.size(s) > JS_HEAVY_SCRIPT_COUNT) | F.exists(s, lambda x: x.rlike(JS_FRAMEWORK_RE)))


def html_lang(col) -> Column:
    """Declared ``<html lang>`` (lower-cased primary tag), '' when absent."""
    v = F.lower(F.regexp_extract(F.coalesce(_c(col), F.lit("")), LANG_RE, 1))
    return F.substring_index(F.replace(v, F.lit("_"), F.lit("-")), "-", 1)


def meta_content(col, name: str) -> Column:
    """The same of whole html: see :func:`meta_value`."""
    return meta_value(tags(shown(col), "meta"), name)


def meta_value(metas: Column, name: str) -> Column:
    """content of the first ``<meta name=...>`` that has one, whatever the attributes' order, case and quotes; else null."""
    named = lambda t: F.lower(attr(t, "name")).eqNullSafe(F.lit(name))
    return first_attr(metas, named, "content")


def viewport_meta(col) -> Column:
    """Content of ``<meta name=viewport>`` or null."""
    v = meta_content(col, "viewport")
    return F.when(F.length(v) > 0, v)


def amp_url(col) -> Column:
    """Href of ``<link rel=amphtml>`` or null."""
    amp = lambda t: F.lower(attr(t, "rel")).eqNullSafe(F.lit("amphtml"))
    v = first_attr(tags(shown(col), "link"), amp, "href")
    return F.when(F.length(v) > 0, v)


def image_counts(col) -> Column:
    """struct<images, with_alt>: ``<img>`` tags, and those with a non-empty alt."""
    return counts_of(tags(shown(col), "img"))


def counts_of(images: Column) -> Column:
    """image_counts of the start tags themselves."""
    return let(images, lambda t: F.struct(
        F.size(t).cast("long").alias("images"),
        F.size(F.filter(t, lambda x: F.coalesce(F.length(attr(x, "alt")) > 0, F.lit(False)))).cast("long").alias("with_alt")))


def count_matches(col, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(pattern), 0))


def has_og_tags(col) -> Column:
    return any_og(tags(shown(col), "meta"))


def any_og(metas: Column) -> Column:
    return F.exists(metas, lambda t: F.coalesce(F.lower(attr(t, "property")).startswith("og:"), F.lit(False)))


def hreflangs(col) -> Column:
    """hreflang of every ``<link>`` that has one (array<string>)."""
    return F.filter(F.transform(tags(shown(col), "link"), lambda t: attr(t, "hreflang")), lambda v: v.isNotNull())


# --------------------------------------------------------------------------- tags and attributes as columns
# Tag-level extraction stays in the JVM: ``tags`` lists the start tags of one
# element name, ``attr`` reads an attribute from such a tag string whatever the
# attribute order or quoting (names case-insensitive, values entity-decoded).

CSS_BG_RE = r"""background-image:\s*url\(\s*['"]?([^'")\s]+)['"]?\s*\)"""


def tags(col, name: str) -> Column:
    """Start tags ``<name ...>`` in document order (array<string>)."""
    # a '>' inside quotes does not end a tag; possessive, so no backtracking and no recursion
    start_tag = rf"""(?i)<{name}(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(start_tag), 0)


def blocks(col, name: str) -> Column:
    """Whole elements ``<name ...>...</name>`` (non-nested), in order."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(rf"(?is)<{name}\b.*?</{name}\s*>"), 0)


def _attr_re(name: str) -> str:
    return rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)\s{name}(?:\s*=|(?=[\s/>]))")


def attr(tag: Column, name: str) -> Column:
    """Attribute value of a start-tag string; '' for a bare attribute, null
    when absent. One regex finds the (possibly quoted) value; quotes are cut
    and entities decoded only when an '&' is present."""
    def value(v):
        q = v.startswith('"') | v.startswith("'")
        unq = F.when(q, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return let(unq, lambda u: decode_entities(u, attribute=True))

    raw = F.regexp_extract(tag, _attr_re(name), 1)
    return let(raw, lambda v: F.when(F.length(v) > 0, value(v)).when(has_attr(tag, name), F.lit("")))


def first_attr(tag_list: Column, pred, name: str) -> Column:
    """``name`` of the first tag satisfying ``pred`` that carries ``name``."""
    hit = F.filter(tag_list, lambda t: pred(t) & has_attr(t, name))
    return F.when(F.size(hit) > 0, attr(F.element_at(hit, 1), name))


def last_wins_map(entries: Column) -> Column:
    """map_from_entries keeping the last value of a repeated key."""
    n = F.size(entries)
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(1))),
                                                     lambda later: later["key"] == e["key"]) | (i + 1 == n))
    return F.map_from_entries(kept)

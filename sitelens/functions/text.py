"""Text column functions: tokens, snippets, highlight, summary, language vote.

Regex classes are spelled with explicit Unicode properties (``\\p{L}``) because
Java's ``\\w`` is ASCII-only while the semantics we follow are Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index stopwords (tokens dropped besides those of length <= 2).
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at",
    "to", "for", "with", "by", "about", "from", "of",
]
MIN_TOKEN_LEN = 3
WORD = r"[\p{L}\p{N}_]+"

# Default snippet length and the text used when nothing is known.
SNIPPET_SIZE = 200
NO_DESCRIPTION = "No description available"

# Small per-language stopword lists used to vote on a language.
LANG_STOPWORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "as", "was", "on", "are", "this", "be", "by", "from", "at", "or"],
    "fr": ["le", "la", "les", "de", "des", "et", "est", "un", "une", "du", "que", "qui", "dans", "pour", "pas", "sur", "au", "avec", "ce", "par"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "sich", "des", "auf", "für", "im", "dem", "auch", "es"],
    "es": ["el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "es", "por", "con", "no", "para", "del", "se", "al", "lo", "como"],
}
LANG_ORDER = ["en", "fr", "de", "es"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col) -> Column:
    """All word runs of the lower-cased text (array<string>, [] for null)."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


# One regex does the whole token rule (no per-token lambda): a maximal word run
# (not preceded by a word character) of at least MIN_TOKEN_LEN characters that
# is not exactly a stopword. Shorter stopwords already fail the length rule.
_W = r"[\p{L}\p{N}_]"
_LONG_STOP = [s for s in STOPWORDS if len(s) >= MIN_TOKEN_LEN]
TOKEN_RE = rf"(?<!{_W})(?!(?:{'|'.join(_LONG_STOP)})(?!{_W})){_W}{{{MIN_TOKEN_LEN},}}"


def tokenize(col) -> Column:
    """Lower-case word runs longer than two characters that are not stopwords."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(TOKEN_RE), 0)


def keywords(col) -> Column:
    """K1: non-stopword tokens, repeats kept (same rule as the index tokens)."""
    return tokenize(col)


def snippet(text, description=None, n: int = SNIPPET_SIZE) -> Column:
    """First ``n`` characters plus '...' when longer; else the description; else a default."""
    t = _c(text)
    cut = F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)
    cut = F.when(F.length(t) > 0, cut)
    alts = [cut]
    if description is not None:
        d = _c(description)
        alts.append(F.when(F.length(d) > 0, d))
    alts.append(F.lit(NO_DESCRIPTION))
    return F.coalesce(*alts)


def highlight(col, term: str, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """I8: wrap the first case-insensitive occurrence of ``term``."""
    c = _c(col)
    if not term:
        return c
    pos = F.instr(F.lower(c), term.lower())
    n = len(term)
    return F.when(
        pos > 0,
        F.concat(
            F.substring(c, F.lit(1), pos - 1), F.lit(open_tag),
            F.substring(c, pos, F.lit(n)), F.lit(close_tag),
            F.substring(c, pos + n, F.lit(1 << 30)),
        ),
    ).otherwise(c)


SENTENCE = r"[^.!?]+[.!?]*"


def summary(col, n: int = 3) -> Column:
    """K2: the first ``n`` sentences joined by a space."""
    sents = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(SENTENCE), 0)
    sents = F.filter(F.transform(sents, lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return F.array_join(F.slice(sents, 1, n), " ")


def truncate_text(col, n: int = 1024) -> Column:
    """K4: the first ``n`` characters."""
    return F.substring(_c(col), 1, n)


def language_votes(col) -> Column:
    """Per-language count of distinct stopwords present (struct en, fr, de, es)."""
    w = F.array_distinct(words(col))
    return F.struct(*[
        F.size(F.array_intersect(w, F.array(*[F.lit(s) for s in LANG_STOPWORDS[lang]]))).alias(lang)
        for lang in LANG_ORDER
    ])


def detect_language(col) -> Column:
    """K3: the language whose stopwords overlap most (ties by the fixed order
    en, fr, de, es); 'unknown' when none overlaps."""
    v = language_votes(col)
    best = F.greatest(*[v[lang] for lang in LANG_ORDER])
    out = F.lit("unknown")
    for lang in reversed(LANG_ORDER):
        out = F.when((best > 0) & (v[lang] == best), F.lit(lang)).otherwise(out)
    return out

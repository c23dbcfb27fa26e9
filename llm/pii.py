"""Personal data by patterns, extended by bootstrapped contextual extraction; DataFrame functions alone.

Base entities are leftmost non-overlapping matches of one expression for each kind. They are the seeds: the one or two
words before an entity are a lexical pattern, an entity or a candidate of like shape an instance. Occurrences of
instances in patterns make a bipartite graph that is scored in rounds: a pattern's score for a kind is the mass of the
kind's instances that follow it, over all its occurrences in all documents (also those followed by ordinary words); an
instance's score is one minus the product of its patterns' doubts. A pattern that LEAST_SEEDS different entities support
and that scores PATTERN_SCORE or more is trusted, and candidates after it that score INSTANCE_SCORE or more are added.

Only the occurrences and the counts of supported patterns are exchanged, never texts. Frequent words are counted where
they are read and combined map-side. Null text counts as empty; repeated rows give repeated results; rows are told apart
by doc_id and a hash of the text, so null or shared doc_ids do no harm; an empty table gives no rows; other columns are
ignored by `find_private` and kept by `mask_private`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents, stage

#: Fixed values of the contract, each expression with possessive parts where that changes no match (a long run of
#: digits or letters is then read once). \G: the place where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

_WORD = r"[^\x20\x09-\x0D]"
_SPACE = r"[\x20\x09-\x0D]"
#: Addresses that the base cannot match: four numbers with written, bracketed or spaced dots, and groups of IPv6.
_DOT = r"(?:\x20?(?:\.|\[\.\]|\(\.\)|\{\.\}|[\[(]dot[\])])\x20?|\x20dot\x20)"
_DOTTED = rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}"
_GROUPS = "[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+)"
_IPV6 = rf"(?:{_GROUPS}{{7}}|(?=:*+[0-9A-Fa-f])(?!(?:[0-9A-Fa-f]*:){{9}})(?:{_GROUPS}{{0,6}})?::(?:{_GROUPS}{{0,6}})?)"
#: Candidates: words with an at sign or a written "(at)", addresses as above, and runs of words of digits and their
#: separators.
CANDIDATE = (
    rf"(?<!{_WORD}){_WORD}*?(?:@|[\[(]at[\])]){_WORD}++"
    rf"|(?<![^\x20\x09-\x0D\"'\[(])(?:{_IPV6}(?![0-9A-Za-z:])|{_DOTTED}(?![0-9A-Za-z]))"
    r"|(?<![^\x20\x09-\x0D\"'])[0-9(][0-9()./:-]*+(?:\x20[0-9(][0-9()./:-]*+)*+"
)
_LIKE = {
    "email": r"^[^@]+(?:@|[\[(]at[\])])[^@]+[.\])][^@]*[A-Za-z]$",
    "ip": rf"^(?:{_BYTE}(?:{_DOT}{_BYTE}){{3}}|{_IPV6})$",
    "card": r"^(?:[0-9][ .-]?){12,18}[0-9]$",
    "phone": r"^\(?(?:[0-9][ ().\/-]{0,3}){6,14}[0-9]$",
}
#: Characters of context that a pattern is read from.
CONTEXT = 80
LEAST_SEEDS, ROUNDS, PATTERN_SCORE, INSTANCE_SCORE = 3, 4, 0.7, 0.8
_MATCH = "array<struct<start: int, stop: int, value: string, before: string>>"


def located(text: Column, pattern: str) -> Column:
    """All matches with their places (code points, stop exclusive) and the text before each, back to the last match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda a, b: F.struct(a.alias("gap"), b.alias("value")))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() AS {_MATCH})").alias("found"))

    def add(state, step):
        start = state["at"] + F.char_length(step["gap"])
        stop = start + F.char_length(step["value"])
        one = F.struct(
            start.alias("start"), stop.alias("stop"), step["value"].alias("value"), F.right(step["gap"], F.lit(CONTEXT)).alias("before")
        )
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    steps = F.filter(steps, lambda x: x["value"].isNotNull())
    return F.when(F.size(matches) > 0, F.aggregate(steps, begin, add, lambda s: s["found"])).otherwise(
        F.expr(f"cast(array() AS {_MATCH})")
    )


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        digit = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str):
    """The check that a match of a kind has to pass."""

    def check(m: Column) -> Column:
        value = m["value"]
        digits = F.regexp_replace(value, "[^0-9]", "")
        if kind == "ip":
            return value.rlike(_IP)
        if kind == "card":
            return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(8, 15)
        return F.lit(True)

    return check


def _tagged(kind: str | None):
    return lambda m: F.struct(F.lit(kind).cast("string").alias("kind"), m.alias("m"))


def base_entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and for every kind an array of its entities; `candidates`: what looks like one, but is none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    empty = F.expr(f"cast(array() AS {_MATCH})")
    has_digit = F.col("text").rlike("[0-9]")
    for kind, pattern in KINDS.items():
        likely = has_digit if kind == "card" else F.col("text").contains(_NEEDS[kind])
        found = F.filter(located(F.col("text"), pattern), _valid(kind))
        rows = rows.withColumn(kind, F.when(likely, found).otherwise(empty))
    likely = has_digit | F.col("text").contains("@") | F.col("text").contains("::") | F.col("text").rlike(r"[\[(]at[\])]")
    rows = rows.withColumn("candidates", F.when(likely, located(F.col("text"), CANDIDATE)).otherwise(empty))

    def trimmed(m):
        value = F.when(m["value"].rlike(rf"^{_IPV6}$"), m["value"]).otherwise(
            F.regexp_replace(m["value"], r"[^0-9A-Za-z\])]+$", "")
        )
        return F.struct(
            m["start"].alias("start"), (m["start"] + F.char_length(value)).cast("int").alias("stop"), value.alias("value"),
            m["before"].alias("before"),
        )

    taken = F.concat(*KINDS)
    free = lambda m: ~F.exists(taken, lambda b: (b["start"] < m["stop"]) & (b["stop"] > m["start"]))
    like = lambda m: reduce(or_, [m["value"].rlike(p) for p in _LIKE.values()])
    rows = rows.withColumn("candidates", F.filter(F.transform("candidates", trimmed), lambda m: like(m) & free(m)))
    return rows.drop("text")


def occurrences(found: DataFrame) -> DataFrame:
    """One row for each entity or candidate and pattern before it: kind is null for candidates."""
    tagged = [F.transform(k, _tagged(k)) for k in KINDS]
    other = F.transform("candidates", _tagged(None))
    each = found.select("doc_id", "text_key", F.inline(F.concat(*tagged, other)))
    before = F.lower("m.before")
    last = F.regexp_extract(before, rf"({_WORD}+){_SPACE}+$", 1)
    two = F.regexp_extract(before, rf"{_SPACE}({_WORD}+){_SPACE}+{_WORD}+{_SPACE}+$", 1)
    patterns = F.array(last, F.when(two != "", F.concat_ws(" ", two, last)))
    return each.select(
        "doc_id", "text_key", "kind", F.col("m.start").alias("start"), F.col("m.stop").alias("stop"),
        F.col("m.value").alias("instance"), F.explode(F.filter(patterns, lambda p: p.isNotNull() & (p != ""))).alias("pattern"),
    )


def pattern_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the one or two words of a pattern stand in all texts. patterns: (pattern), distinct."""
    words = F.split(F.lower(F.col("text")), rf"{_SPACE}+")
    shifted = F.concat(F.array(F.lit("")), words)
    pairs = docs.select(F.inline(F.arrays_zip(shifted.alias("prev"), words.alias("word"))))
    pairs = pairs.where(F.col("word").isNotNull() & (F.col("word") != ""))
    ends = patterns.select(F.substring_index("pattern", " ", -1).alias("word")).distinct()
    near = pairs.join(ends, "word", "left_semi")
    both = F.array(F.col("word"), F.concat_ws(" ", F.when(F.col("prev") != "", F.col("prev")), F.col("word")))
    each = near.select(F.explode(F.array_distinct(both)).alias("pattern"))
    return each.join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def bootstrapped(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_key, kind, start, stop of the candidates that trusted patterns discover."""
    seen = stage(occurrences(found), "pii-occurrences")
    supported = (
        seen.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("seeds"))
        .where(F.col("seeds") >= LEAST_SEEDS)
    )
    supported = stage(supported.select("pattern", "kind"), "pii-patterns")
    totals = stage(pattern_counts(docs, supported.select("pattern").distinct()), "pii-totals")
    # the graph: how often an instance follows a pattern, for the kinds that support the pattern
    compatible = F.array_compact(F.array(*[F.when(F.col("instance").rlike(p), F.lit(k)) for k, p in _LIKE.items()]))
    kinds = F.when(F.col("kind").isNotNull(), F.array(F.col("kind"))).otherwise(compatible)
    graph = (
        seen.withColumn("seed", F.col("kind").isNotNull()).withColumn("kind", F.explode(kinds))
        .join(supported, ["pattern", "kind"])
        .groupBy("pattern", "kind", "instance", "seed").agg(F.count("*").alias("n"))
        .join(totals, "pattern")
    )
    graph = stage(graph, "pii-graph")
    score = stage(
        graph.select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score")).distinct(), "pii-scores"
    )
    for _ in range(ROUNDS):
        trust = graph.join(score, ["kind", "instance"]).groupBy("pattern", "kind").agg(
            F.least(F.lit(1.0), F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("trust")
        )
        doubt = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("trust"))))
        score = stage(
            graph.join(trust, ["pattern", "kind"]).groupBy("kind", "instance").agg(
                F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(doubt)).alias("score")
            ),
            "pii-scores",
        )
    trusted = graph.join(score, ["kind", "instance"]).groupBy("pattern", "kind").agg(
        (F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("trust")
    ).where(F.col("trust") >= PATTERN_SCORE)
    good = score.where(F.col("score") >= INSTANCE_SCORE).select("kind", "instance", "score")
    hits = (
        seen.where("kind IS NULL").drop("kind")
        .join(trusted, "pattern").join(good, ["kind", "instance"])
        .groupBy("doc_id", "text_key", "start", "stop")
        .agg(F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
    )
    return hits.select("doc_id", "text_key", "kind", "start", "stop")


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, counts and base spans of each kind, and all spans: array<struct<rank, start, stop, kind>>, by
    kind in the order of KINDS, then start."""
    found = stage(base_entities(docs), "pii-base")
    rank = {k: i for i, k in enumerate(KINDS)}
    span = lambda k: F.transform(
        F.col(k), lambda m: F.struct(F.lit(rank[k]).alias("rank"), m["start"].alias("start"), m["stop"].alias("stop"), F.lit(k).alias("kind"))
    )
    ranks = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in rank.items()])
    more = bootstrapped(docs, found).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct(ranks.alias("rank"), "start", "stop", "kind")).alias("more")
    ).withColumnsRenamed({"doc_id": "its_id", "text_key": "its_key"})
    base = found.select("doc_id", "text_key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.concat(*[span(k) for k in KINDS]).alias("base"))
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key"))
    none = F.filter("base", lambda _: F.lit(False))
    return base.join(more, same, "left").select(
        "doc_id", "text_key", *[f"n_{k}" for k in KINDS], F.sort_array("base").alias("base"),
        F.sort_array(F.concat("base", F.coalesce("more", none))).alias("spans"),
    )


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def mask_private(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets (overlapping spans: the first one's)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = find_private(docs).where(F.size("spans") > 0).select("doc_id", "text_key", "spans").distinct()
    found = found.toDF("__doc", "__key", "__spans")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text_key") == F.col("__key"))
    by_place = F.array_sort(
        F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(state, s):
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        fresh = F.struct(s["stop"].alias("at"), F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(
            F.struct(F.greatest(state["at"], s["stop"]).alias("at"), state["out"].alias("out"))
        )

    end = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    masked = F.when(F.col("__spans").isNotNull(), F.aggregate(by_place, begin, put, end)).otherwise(F.col("text"))
    joined = docs.withColumn("__text_key", F.xxhash64(text)).join(found, same, "left")
    return joined.withColumn("text", masked).drop("__doc", "__key", "__spans", "__text_key")


def op5_private_data(spark, sf_dir: str) -> DataFrame:
    found = find_private(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )

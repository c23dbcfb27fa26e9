"""Language by character n-grams (K3): per-language n-gram log probabilities, scored by joins and sums.

A word's n-grams are those of the lower-cased word between two blanks, so strings stay short however long a text is. Texts
become (document, word, count) rows as they are read, and all that is shuffled of them is added up before: training is one
aggregate by (language, word), then by (language, n-gram). N-grams are taken and scored per distinct word, and a document's
score is the sum over its words. The most frequent words, as many as HOT_CELLS allows, go to every executor with what they
add in each language; only documents' other words meet theirs in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import words
from sitelens.session import cut_lineage

#: Length of the n-grams, and what is added to every count.
GRAM, ADD = 3, 0.5
#: Numbers (words times languages) that are broadcast of the most frequent words, and the longest word among them.
HOT_CELLS, HOT_LENGTH = 800_000, 64


def word_counts(docs: DataFrame, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """(keys, word, n): the words of each document, a row for each place; nothing is shuffled, readers add up n."""
    return docs.select(*keys, F.explode(words(text_col)).alias("word")).withColumn("n", F.lit(1).cast("long"))


def grams(word: str = "word", n: int = GRAM) -> Column:
    padded = F.concat(F.lit(" "), F.col(word), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda p: F.substring(padded, p, F.lit(n)))


def train_language_model(counts: DataFrame, lang_col: str = "lang", add: float = ADD) -> DataFrame:
    """(lang, gram, logp) from word counts with their language. A null gram holds what an n-gram that the language lacks
    gets; an n-gram is in the model for every language that has it."""
    by_word = counts.groupBy(lang_col, "word").agg(F.sum("n").alias("n"))
    seen = by_word.select(F.col(lang_col).alias("lang"), F.explode(grams()).alias("gram"), "n")
    seen = cut_lineage(seen.groupBy("lang", "gram").agg(F.sum("n").alias("n")))  # read several times
    size = seen.agg(F.count_distinct("gram").alias("v"))
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total")).crossJoin(size)  # one row a language, times one row
    under = F.col("total") + F.lit(add) * F.col("v")
    known = seen.join(totals, "lang").select("lang", "gram", F.ln((F.col("n") + add) / under).alias("logp"))
    return known.unionByName(totals.select("lang", F.lit(None).cast("string").alias("gram"), F.ln(F.lit(add) / under).alias("logp")))


def _hot(gains: DataFrame, limit: int) -> Column:
    """Whether a word is frequent enough to be broadcast: the fewest uses, as a power of two, that at most `limit` words reach."""
    by_size = gains.where(F.length("word") <= HOT_LENGTH).groupBy(F.floor(F.log2("uses")).alias("p")).count().collect()  # <= 63 rows
    least, words_above = 63, 0
    for r in sorted(by_size, key=lambda r: -r["p"]):
        words_above += r["count"]
        if words_above > limit:
            break
        least = r["p"]
    return (F.length("word") <= HOT_LENGTH) & (F.floor(F.log2("uses")) >= least)


def detect_by_model(counts: DataFrame, model: DataFrame, keys: tuple = ("doc_id",), hot_cells: int = HOT_CELLS) -> DataFrame:
    """(keys, predicted): the language with the largest log probability, among equals the first by name; documents
    without words have no row."""
    floor = {r["lang"]: r["logp"] for r in model.where("gram IS NULL").collect()}  # one row a language
    langs = sorted(floor, key=lambda lang: (lang is not None, lang or ""))  # without a name: no n-gram of it is known
    if not langs:
        return counts.select(*keys, F.lit(None).cast("string").alias("predicted")).limit(0)
    cols = [f"_gain{i}" for i in range(len(langs))]
    gain = model.where("gram IS NOT NULL").groupBy("gram").agg(*[
        F.max(F.when(F.col("lang") == lang, F.col("logp") - F.lit(floor[lang]))).alias(c) for lang, c in zip(langs, cols)])
    if gain.count() * len(langs) <= hot_cells:
        gain = F.broadcast(gain)
    each = counts.groupBy("word").agg(F.sum("n").alias("uses")).select("word", "uses", F.explode(grams()).alias("gram"))
    gains = cut_lineage(each.join(gain, "gram", "left").groupBy("word").agg(
        F.max("uses").alias("uses"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols]))

    # what unseen n-grams would give in each language goes by the document's number of n-grams
    def added(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*keys, *by).agg(F.sum("n").alias("n"), F.sum("grams").alias("grams"), *[F.sum(c).alias(c) for c in cols])

    size = F.greatest(F.length("word") + 3 - GRAM, F.lit(1))
    hot = gains.where(_hot(gains, hot_cells // len(langs))).select("word", F.lit(True).alias("_hot"), *cols)
    each = counts.join(F.broadcast(hot), "word", "left")
    each = each.select(*keys, "n", (F.col("n") * size).alias("grams"), *[(F.col("n") * F.col(c)).alias(c) for c in cols],
                       F.when(F.col("_hot").isNull(), F.col("word")).alias("rare"))
    parts = cut_lineage(added(each, "rare"))
    rare = parts.where("rare IS NOT NULL").drop(*cols).join(gains.withColumnRenamed("word", "rare"), "rare")
    rare = rare.select(*keys, "n", "grams", *[(F.col("n") * F.col(c)).alias(c) for c in cols])
    total = added(parts.where("rare IS NULL").drop("rare").unionByName(rare))
    scores = F.array(*[F.struct((-(F.col("grams") * F.lit(floor[lang]) + F.col(c))).alias("s"), F.lit(lang).cast("string").alias("lang"))
                       for lang, c in zip(langs, cols)])
    return total.select(*keys, F.array_min(scores)["lang"].alias("predicted"))

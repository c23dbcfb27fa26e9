"""Character n-gram language model against plain Python and the stopword vote; merged sketches against exact counts."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelens.functions.text import detect_language
from sitelens.operators import langmodel as LM
from sitelens.operators import sketches as SK
from sitelens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def slow_model(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for w in re.findall(r"\w+", text.lower()):
            for i in range(len(w)):
                counts[lang, f" {w} "[i : i + 3]] += 1
                totals[lang] += 1
    size = len({g for _, g in counts})

    def score(lang, text):
        return sum(math.log((counts[lang, f" {w} "[i : i + 3]] + 0.5) / (totals[lang] + 0.5 * size))
                   for w in re.findall(r"\w+", text.lower()) for i in range(len(w)))

    return lambda text: min(totals, key=lambda lang: (-score(lang, text), lang))


def test_language_model_against_plain_counts(spark):
    train = [("en", "the cat sat on the mat"), ("de", "der hund und die katze"), ("fr", "le chat est sur la table")]
    asked = [(1, "the hat"), (2, "der kater und der hut"), (3, "la chatte"), (4, ""), (5, None), (6, "zzz qqq"), (None, "the mat")]
    rows = spark.createDataFrame(train, "lang string, text string")
    model = LM.train_language_model(LM.word_counts(rows, keys=("lang",)))
    got = {r.doc_id: r.predicted for r in LM.detect_by_model(LM.word_counts(spark.createDataFrame(asked, "doc_id long, text string")), model).collect()}
    plain = slow_model(train)
    assert got == {i: plain(t) for i, t in asked if t}


def test_word_counts_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, None)], "doc_id long, text string")
    counts = LM.word_counts(docs)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.s) for r in counts.groupBy("word").agg(F.sum("n").alias("s")).collect()} == {("a", 2), ("b", 2)}


@pytest.mark.parametrize("hot_cells", [0, 6, 60, 10**6])
def test_rare_and_frequent_words_score_alike(spark, hot_cells):
    train = [("en", "the cat sat on the mat"), ("de", "der hund und die katze"), ("fr", "le chat est sur la table")]
    asked = [(i % 23, ("the hat " * (i % 3) + "der kater und " * (i % 4) + f"chatte zzz w{i} " * (i % 2)) or None) for i in range(40)]
    rows = spark.createDataFrame(train, "lang string, text string")
    model = LM.train_language_model(LM.word_counts(rows, keys=("lang",)))
    docs = spark.createDataFrame([*asked, (None, "le table")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in LM.detect_by_model(LM.word_counts(docs), model, hot_cells=hot_cells).collect()}
    plain = slow_model(train)
    whole = {}
    for i, t in [*asked, (None, "le table")]:
        whole[i] = f"{whole.get(i, '')} {t or ''}"
    assert got == {i: plain(t) for i, t in whole.items() if t.strip()}


def test_languages_without_name_or_rows(spark):
    docs = spark.createDataFrame([(1, None, "aa bb"), (2, "en", "the cat"), (3, None, "xx")], "doc_id long, lang string, text string")
    counts = LM.word_counts(docs, keys=("doc_id", "lang"))
    guess = lambda model: {r.doc_id: r.predicted for r in LM.detect_by_model(counts, model, keys=("doc_id", "lang")).collect()}
    assert guess(LM.train_language_model(counts.where("doc_id = 1"))) == {1: None, 2: None, 3: None}
    assert guess(LM.train_language_model(counts.where("doc_id < 3")))[2] == "en"
    assert guess(LM.train_language_model(counts.limit(0))) == {}


def test_held_out_accuracy_above_the_vote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = QUERIES["language_model"][0](spark, SF).where("held_out")
    vote = docs.select("doc_id", detect_language("text").alias("voted"))
    held = rows.join(vote, "doc_id").collect()
    assert len(held) >= 20 and all((hashlib.md5(str(r.doc_id).encode()).hexdigest()[0] in "0123") for r in held)
    right = sum(r.predicted == r.lang for r in held) / len(held)
    voted = sum(r.voted == r.lang for r in held) / len(held)
    print("held-out accuracy", right, "stopword vote", voted)
    assert right >= 0.95 and right >= voted


def test_sketches_merge_to_about_the_exact_count(spark):
    rows = spark.range(60_000).select((F.col("id") % 5).alias("run"), F.concat(F.lit("u"), F.col("id") % 41_003).alias("url"))
    stored = SK.run_sketches(rows, ["run"], {"urls": "url"})
    merged = SK.merge_sketches(stored, ["urls"]).first()
    assert merged.rows == 60_000 and abs(merged.urls - 41_003) <= SK.error_bound() * 41_003
    by_run = {r.run: r.urls for r in SK.merge_sketches(stored, ["urls"], by=["run"]).collect()}
    exact = {r.run: r.n for r in rows.groupBy("run").agg(F.count_distinct("url").alias("n")).collect()}
    assert all(abs(by_run[k] - n) <= SK.error_bound() * n for k, n in exact.items())
    assert SK.merge_sketches(stored.limit(0), ["urls"]).first().rows is None

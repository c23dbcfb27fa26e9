"""Tokens, index, search semantics (brute force on small fixtures), ids."""

import re

from pyspark.sql import functions as F

import pytest

from sitelens.functions import text as T
from sitelens.operators import index as IX
from sitelens.plans.ids import dense_ids

STOP = set(T.STOPWORDS)


def py_tokens(text):
    if not text:
        return []
    return [t for t in re.findall(r"\w+", text.lower()) if len(t) > 2 and t not in STOP]


def test_tokenize_unicode_stopwords_empty(spark):
    texts = ["The Café au lait, ÉCOLE naïve_1 ab", "the and of", "", None, "Straße über 123 4567 x_y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.tokenize("t")).collect()]
    assert got == [py_tokens(t) for t in texts]


def test_snippet_highlight_summary(spark):
    long = "a" * 250
    df = spark.createDataFrame([(long, None), ("", "desc"), (None, None), ("short", "d")], "c string, d string")
    got = [r[0] for r in df.select(T.snippet("c", "d")).collect()]
    assert got == ["a" * 200 + "...", "desc", "No description available", "short"]
    h = spark.createDataFrame([("Hello World",)], "t string").select(T.highlight("t", "world")).first()[0]
    assert h == "Hello <mark>World</mark>"
    s = spark.createDataFrame([("One. Two! Three? Four.",)], "t string").select(T.summary("t")).first()[0]
    assert s == "One. Two! Three?"


def _index(spark, rows):
    df = spark.createDataFrame(rows, "url string, title string, content string")
    docs = IX.build_documents(df, order_by="url")
    return docs, IX.build_postings(docs)


def brute_search(docs, postings, query, limit=10):
    terms = {}
    for term, doc in postings:
        terms.setdefault(term, set()).add(doc)
    score = {}
    for tok in py_tokens(query):
        for term, ds in terms.items():
            if tok in term:
                for d in ds:
                    score[d] = score.get(d, 0) + 1
    ranked = sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))[:limit]
    return [(i + 1, d, s) for i, (d, s) in enumerate(ranked)]


ROWS = [
    ("https://a.com/1", "Search engines", "Crawling the web and indexing pages"),
    ("https://a.com/2", "Index design", "An inverted index maps terms to documents"),
    ("https://b.org/x", "Spark", "Distributed engines process data"),
    ("https://c.net/y", None, "no title means not indexable"),
    ("https://d.io/z", "Über café", "Naïve search über alles"),
]


def test_documents_and_postings(spark):
    docs, post = _index(spark, ROWS)
    d = docs.orderBy("doc_id").collect()
    assert [r.doc_id for r in d] == [0, 1, 2, 3]
    assert [r.url for r in d] == sorted(r[0] for r in ROWS if r[1] is not None)
    assert all(r.type == "unknown" and r.date == "" and r.snippet == "" for r in d)
    p = post.collect()
    assert len(p) == len({(r.term, r.doc_id) for r in p})  # unique postings
    stats = IX.index_stats(docs, post).first()
    assert stats.documents == 4 and stats.postings == len(p)


def test_search_matches_brute_force(spark):
    docs, post = _index(spark, ROWS)
    pairs = [(r.term, r.doc_id) for r in post.collect()]
    for q in ["engine index", "ing ing", "über", "the and", "", "zzz", "dex"]:
        got = [(r.rank, r.doc_id, r.score) for r in IX.search(docs, post, q).orderBy("rank").collect()]
        assert got == brute_search(None, pairs, q), q


def test_search_batch_ties_and_limit(spark):
    docs, post = _index(spark, ROWS)
    pairs = [(r.term, r.doc_id) for r in post.collect()]
    qs = spark.createDataFrame([(1, "ing"), (2, "engines data"), (3, "the")], "query_id long, query string")
    got = IX.search_batch(post, qs, limit=2).collect()
    for qid, q in [(1, "ing"), (2, "engines data"), (3, "the")]:
        exp = brute_search(None, pairs, q, limit=2)
        assert sorted((r.rank, r.doc_id, r.score) for r in got if r.query_id == qid) == exp


@pytest.mark.parametrize("cells", [0, 5, 12, 500_000])
def test_search_batch_with_often_and_seldom_used_terms(spark, cells):
    docs, post = _index(spark, ROWS)
    pairs = [(r.term, r.doc_id) for r in post.collect()]
    asked = [(1, "ing"), (2, "engines data ing ing"), (3, "the"), (None, "dex")]
    qt = IX.query_tokens(spark.createDataFrame(asked, "query_id long, query string"))
    uses = IX.vocabulary(post)
    matches = IX._substring_matches(uses.select("term"), qt.select("token"))
    got = {(r.query_id, r.doc_id): r.score for r in IX.scores_by_tokens(post, qt, matches, uses, "query_id", cells).collect()}
    exp = {(i, d): score for i, q in asked for _rank, d, score in brute_search(None, pairs, q, limit=1000)}
    assert got == exp


def test_search_batch_computes_postings_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            reads.add(part.num_rows)
            yield part

    rows = [("engine", 1), ("index", 1), ("engines", 2)]
    post = spark.createDataFrame(rows, "term string, doc_id long")
    qs = spark.createDataFrame([(1, "engine")], "query_id long, query string")
    got = IX.search_batch(post.mapInArrow(seen, post.schema), qs).collect()
    assert sorted((r["rank"], r.doc_id, r.score) for r in got) == [(1, 1, 1), (2, 2, 1)] and reads.value == len(rows)


def test_upsert_keeps_ids_and_replaces_postings(spark):
    docs, post = _index(spark, ROWS)
    new = spark.createDataFrame([("https://a.com/2", "Renamed", "fresh words only"), ("https://e.com/new", "New page", "brand")],
                                "url string, title string, content string")
    d2, p2 = IX.upsert_documents(docs, post, new)
    rows = {r.url: r for r in d2.collect()}
    assert rows["https://a.com/2"].doc_id == 1 and rows["https://a.com/2"].title == "Renamed"
    assert rows["https://e.com/new"].doc_id == 4
    terms1 = {r.term for r in p2.where("doc_id = 1").collect()}
    assert "inverted" not in terms1 and {"renamed", "fresh", "words", "only"} <= terms1


def test_dense_ids_global_and_grouped(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 1000).alias("k"))
    g = dense_ids(df, "k", "rid").collect()
    assert sorted(r.rid for r in g) == list(range(1000))
    assert all(r.rid == r.k for r in g)  # k is a permutation of 0..999
    grp = dense_ids(df, "k", "pos", group_by="g").collect()
    by = {}
    for r in grp:
        by.setdefault(r.g, []).append((r.k, r.pos))
    for items in by.values():
        items.sort()
        assert [p for _, p in items] == list(range(len(items)))


def test_boosted_search(spark):
    df = spark.createDataFrame([(0, "Spark engine", "u/spark", "engine text"), (1, "Other", "u/x", "nothing")],
                               "doc_id long, title string, url string, content string")
    got = IX.search_boosted(df, "spark engine").collect()
    assert [(r.doc_id, r.score) for r in got] == [(0, 3.0 * 2 + 2.0 * 1 + 1.0 * 1)]


def test_substring_matches_random(spark):
    import random
    rng = random.Random(11)
    alpha = "abé"
    terms = sorted({"".join(rng.choice(alpha) for _ in range(rng.randint(3, 9))) for _ in range(300)})
    toks = sorted({"".join(rng.choice(alpha) for _ in range(rng.randint(3, 6))) for _ in range(60)} | {"zzz", "aaaa"})
    v = spark.createDataFrame([(t,) for t in terms], "term string")
    q = spark.createDataFrame([(t,) for t in toks], "token string")
    got = {(r.term, r.token) for r in IX._substring_matches(v, q).collect()}
    exp = {(a, b) for a in terms for b in toks if b in a}
    assert got == exp


def test_dense_ids_hot_group_spans_partitions(spark):
    # one group holds 90% of the rows: its positions must still be 0..n-1,
    # numbered across several range partitions instead of one task
    hot = spark.range(0, 9000).select(F.lit("hot").alias("g"), F.col("id").alias("k"))
    cold = spark.range(0, 1000).select((F.col("id") % 10).cast("string").alias("g"), F.col("id").alias("k"))
    rows = dense_ids(hot.unionByName(cold), "k", "pos", group_by="g")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 1
    hot_pos = [r.pos for r in rows.where("g = 'hot'").orderBy("k").collect()]
    assert hot_pos == list(range(9000))


def test_upsert_duplicate_urls_in_batch(spark):
    docs, post = _index(spark, ROWS)
    new = spark.createDataFrame([("https://z.com/", "Old", "first", 1), ("https://z.com/", "New", "second", 2)],
                                "url string, title string, content string, seq long")
    d2, p2 = IX.upsert_documents(docs, post, new)
    row = d2.where("url = 'https://z.com/'").collect()
    assert len(row) == 1 and row[0].title == "New"
    assert {r.term for r in p2.where(f"doc_id = {row[0].doc_id}").collect()} == {"new", "second"}
    # without seq the choice is deterministic (the greatest row) for documents and postings alike
    d3, p3 = IX.upsert_documents(docs, post, new.drop("seq"))
    r3 = d3.where("url = 'https://z.com/'").first()
    assert r3.title == "Old" and {r.term for r in p3.where(f"doc_id = {r3.doc_id}").collect()} == {"old", "first"}

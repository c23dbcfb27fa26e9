"""Stored index: searches equal those of a full scan, merges rewrite only touched buckets, readers and replays."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelens.operators import index as IX
from sitelens.sources import segments as SG

COLS = "url string, title string, snippet string, content string, description string, type string, date string, seo_score double"
WORD = re.compile(r"[^\W]+", re.UNICODE)


def pages(n, seed=1, words=None):
    rnd = random.Random(seed)
    words = words or ["".join(rnd.choice("abcdeo") for _ in range(rnd.randrange(2, 9))) for _ in range(150)] + ["the", "from"]
    some = lambda k: " ".join(rnd.choice(words) for _ in range(rnd.randrange(k)))
    return [
        (f"https://h{i % 7}.org/{rnd.choice(words)}/{i}", some(6), some(9) or None, some(30), some(5) or None, None, None, i / 10)
        for i in range(n)
    ]


#: Three characters of words that stand in the pages.
SOME = sorted({w[1:4] for r in pages(300) for w in r[3].split() if len(w) > 5})[::40][:3]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    rows = pages(300)
    SG.BLOCK_DOCS = 2
    SG.merge(spark, root, spark.createDataFrame(rows, COLS), batch=0, buckets=8)
    yield SG.Index(spark, root), rows
    SG.BLOCK_DOCS = 1024


def by_id(index):
    return {r.doc_id: r for r in index.documents.collect()}


def texts(rows):
    return {r[0]: r for r in rows}


def plain(index, rows, query, limit, score):
    """Scores of all documents, one by one."""
    given = texts(rows)
    out = []
    for doc_id, doc in by_id(index).items():
        s = score(given[doc.url], query)
        if s > 0:
            out.append((-s, doc_id))
    return [(r, d, -s) for r, (s, d) in enumerate(sorted(out)[:limit], 1)]


def tokens(text):
    stop = set(SG.STOPWORDS)
    return [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) >= 3 and w not in stop]


def contains_score(row, query):
    terms = set(tokens(" ".join(x or "" for x in row[1:4])))
    return sum(t in w for t in tokens(query) for w in terms)


def boost_score(row, query):
    fields = {"title": row[1], "url": row[0], "description": row[4], "content": row[3]}
    return round(sum(IX.BOOSTS[f] * (t in (v or "").lower()) for f, v in fields.items() for t in set(tokens(query))), 2)


@pytest.mark.parametrize("query", ["abc", " ".join(SOME), f"{SOME[0]} {SOME[0]} {SOME[1]} the", "the from", "dodo ace", "zzz", "", "org"])
def test_searches_equal_a_full_scan(stored, query):
    index, rows = stored
    got = [(r["rank"], r.doc_id, r.score) for r in SG.search(index, query).orderBy("rank").collect()]
    assert got == plain(index, rows, query, 10, contains_score)
    got = [(r["rank"], r.doc_id, r.score) for r in SG.search_boosted(index, query, 25).orderBy("rank").collect()]
    assert got == plain(index, rows, query, 25, boost_score)


def test_results_are_whole_documents(stored):
    index, rows = stored
    row = SG.search(index, SOME[0]).orderBy("rank").first()
    given = texts(rows)[row.url]
    assert (row.title, row.snippet, row.type, row.date, row.seo_score) == (given[1], given[2] or "", "unknown", "", given[7])


def test_batch_equals_single_queries(spark, stored):
    index, rows = stored
    queries = [(1, " ".join(SOME)), (2, "the"), (3, "bed cab bed"), (4, "zzz")]
    got = SG.search_batch(index, spark.createDataFrame(queries, "query_id long, query string")).collect()
    for query_id, query in queries:
        mine = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == query_id)
        assert mine == plain(index, rows, query, 10, contains_score)


def test_scan_is_pruned(stored):
    index, _ = stored
    token = SOME[0]
    matched = SG.matched_terms(index, [token])
    near = index.table("postings").where(SG.term_ranges(matched))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and ("EqualTo(term" in plan or "GreaterThanOrEqual(term" in plan or "Or(" in plan)
    assert "html" not in plan and "content" not in plan
    grams = index.table("grams").where(F.col("gram") == token[:3])
    assert f"EqualTo(gram,{token[:3]})" in grams._jdf.queryExecution().executedPlan().toString()


def test_blocks_that_cannot_reach_the_top_are_skipped(stored):
    index, rows = stored
    matched = SG.matched_terms(index, SOME[:2])
    query = " ".join(SOME[:2])
    bounds = SG.block_bounds(index, matched, SG.term_ranges(matched)).collect()
    block_of = {r.doc_id: (r.bucket, r.block) for r in index.table("postings").select("doc_id", "bucket", "block").distinct().collect()}
    docs, given = by_id(index), texts(rows)
    most = {}
    for d, key in block_of.items():
        most[key] = max(most.get(key, 0), boost_score(given[docs[d].url], query))
    bound = {(r.bucket, r.block): r.bound for r in bounds}
    assert all(bound.get(k, 0) >= v for k, v in most.items())
    least = plain(index, rows, query, 5, boost_score)[-1][2]
    assert sum(b < least for b in bound.values()) > len(bound) / 4


def test_few_matched_terms_meet_the_postings_without_a_shuffle(stored, monkeypatch):
    index, _ = stored
    joined = []
    plain_boosted = SG._boosted
    monkeypatch.setattr(SG, "_boosted", lambda rows, keys: joined.append(rows) or plain_boosted(rows, keys))
    SG.search_boosted(index, SOME[0], 5)
    assert joined
    for rows in joined:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [term" not in plan and "hashpartitioning(term" not in plan


def test_ranges_of_many_terms_are_no_filter(spark):
    terms = spark.range(SG.RANGES * SG.RANGE_TERMS + 1).select(F.concat(F.lit("t"), F.col("id")).alias("term"))
    assert "BETWEEN" not in str(SG.term_ranges(terms)).upper() and terms.where(SG.term_ranges(terms)).count() == terms.count()
    few = terms.limit(SG.RANGES * SG.RANGE_TERMS)
    assert few.where(SG.term_ranges(few)).count() == few.count() and "term" in str(SG.term_ranges(few))


def test_merge_does_not_shuffle_the_stored_postings_by_document(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "i")
    SG.merge(spark, root, spark.createDataFrame(pages(40, 2), COLS), batch=0, buckets=4)
    plans, write = {}, SG._write
    monkeypatch.setattr(SG, "_write", lambda rows, root, table, version: (
        plans.update({table: rows._jdf.queryExecution().executedPlan().toString()}), write(rows, root, table, version)))
    SG.merge(spark, root, spark.createDataFrame(pages(10, 3), COLS), batch=1)
    for table in ("documents", "postings"):
        assert "LeftAnti" in plans[table] and "hashpartitioning(doc_id" not in plans[table]


def test_newest_rows_carry_their_texts_once(spark):
    rows = [("u", "a", "first", "2024-01-01", 1, 0.5), ("u", "b", "second", "2024-01-02", 0, None),
            ("u", "c", "third", "2024-01-02", 1, 0.1), ("v", "d", None, None, None, None)]
    cols = "url string, title string, content string, date string, seq long, seo_score double"
    df = spark.createDataFrame(rows, cols)
    newest = SG._incoming(df, 4)
    got = {r.url: (r.title, r.content, r.date, r.seo_score, r.type) for r in newest.collect()}
    assert got == {"u": ("c", "third", "2024-01-02", 0.1, "unknown"), "v": ("d", None, "", None, "unknown")}
    assert "max_by" not in newest._jdf.queryExecution().executedPlan().toString()
    mapped = SG._incoming(df.withColumn("m", F.create_map(F.lit("k"), F.col("seq"))), 4)
    assert {r.url: r.m for r in mapped.collect()} == {"u": {"k": 1}, "v": {"k": None}}


def test_merge_rewrites_touched_buckets_alone(spark, tmp_path):
    root, rows = str(tmp_path / "i"), pages(60, 2)
    first = SG.merge(spark, root, spark.createDataFrame(rows, COLS), batch=0, buckets=8)
    before = SG.Index(spark, root)
    held = sorted(map(tuple, before.documents.collect()))
    one = (rows[5][0], "fresh title", "s", "entirely neww words", None, "desktop", "2024-01-02", None)
    second = SG.merge(spark, root, spark.createDataFrame([one], COLS), batch=1)
    changed = [b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)]
    assert len(changed) == 1
    now = SG.Index(spark, root)
    a, b = ({r.url: r for r in x.documents.collect()} for x in (before, now))
    assert set(a) == set(b) and a[one[0]].doc_id == b[one[0]].doc_id
    assert (b[one[0]].title, b[one[0]].type, b[one[0]].seo_score) == ("fresh title", "desktop", rows[5][7])  # null keeps the score
    assert [u for u in a if a[u] != b[u]] == [one[0]]
    terms = {r.term for r in now.postings.where(F.col("doc_id") == b[one[0]].doc_id).collect()}
    assert terms == {"fresh", "title", "entirely", "neww", "words"}
    # a reader of the version before still reads it whole
    assert sorted(map(tuple, before.documents.collect())) == held and SG.search(before, "neww").count() == 0
    # a repeated batch does nothing
    assert SG.merge(spark, root, spark.createDataFrame([one], COLS), batch=1) == second


def test_new_urls_and_old_files(spark, tmp_path):
    root = str(tmp_path / "i")
    rows = pages(20, 3)
    SG.merge(spark, root, spark.createDataFrame(rows, COLS), buckets=4)
    for k in range(3):
        more = [(f"https://new{k}.org/{i}", "title", None, "text", None, None, None, None) for i in (2, 1)]
        SG.merge(spark, root, spark.createDataFrame(more, COLS))
        ids = {r.url: r.doc_id for r in SG.Index(spark, root).documents.collect()}
        assert [ids[f"https://new{k}.org/{i}"] for i in (1, 2)] == [20 + 2 * k, 21 + 2 * k]
    assert len(SG.versions(spark, root)) == 2
    named = {v for n in SG.versions(spark, root) for v in SG.read_manifest(spark, root, n)["buckets"].values()}
    assert {int(x.split("=")[1]) for x in SG._names(spark, f"{root}/postings")} == named


def test_failed_merge_leaves_the_index(spark, tmp_path):
    root, rows = str(tmp_path / "i"), pages(10, 4)
    SG.merge(spark, root, spark.createDataFrame(rows, COLS), batch=0, buckets=4)
    spark.range(3).write.parquet(f"{root}/postings/v=1/bucket=0")  # left by a writer that died
    assert SG.Index(spark, root).manifest["version"] == 0
    SG.merge(spark, root, spark.createDataFrame(pages(10, 4), COLS), batch=1)
    assert SG.Index(spark, root).documents.count() == 10


def test_empty_and_null_rows(spark, tmp_path):
    root = str(tmp_path / "i")
    SG.merge(spark, root, spark.createDataFrame([(None, "t"), ("https://a.org", None)], "url string, title string"), buckets=2)
    index = SG.Index(spark, root)
    assert index.documents.count() == 0 and SG.search(index, "abc").count() == 0 and SG.search_boosted(index, "abc").count() == 0
    SG.merge(spark, root, spark.createDataFrame([("https://a.org", "abcd"), ("https://a.org", "abce")], "url string, title string"))
    assert [r.title for r in SG.search(SG.Index(spark, root), "abc").collect()] == ["abce"]

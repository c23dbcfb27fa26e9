"""Dual-tree search against scoring every pair, and its odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.dualtree import Search, op11_dual_tree_search, search_documents, term_lists

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, top=10):
    """(item_id, rank, doc_id, score) rows over all pairs."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, c), n in zip(counts, sizes):
            score = 0
            for t in set(terms(text)) & set(c):
                m = 10 + 90 * n * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    given = ["Ab-cÉ_d9  x\x00y\x7fz", None, "", " .,", "ſK k"]
    import pyarrow as pa

    got = [[t for t in ts if t] for ts in term_lists(pa.array(given)).to_pylist()]
    assert got == [terms(t) for t in given]


def test_small_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(op11_dual_tree_search(spark, sf)) == slow(docs, items)


@pytest.fixture(scope="module")
def items(odd_rows):
    texts = [r[1] for r in odd_rows]
    return [(i, " ".join((texts[i] or "").split()[:12])) for i in range(20)] + [
        (None, texts[2]), (20, None), (21, ""), (22, "nowhere"), (3, " ".join(texts[3].split()[:12])), (23, "x y z don't Z"),
    ]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_odd_rows(spark, odd, odd_rows, items, block):
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    got = rows_of(search_documents(odd, asked, block_bytes=block))
    assert got == slow([r[:2] for r in odd_rows], items)


def test_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search_documents(empty, items).count() == 0
    assert search_documents(odd, items.limit(0)).count() == 0


def test_trees_skip_what_cannot_reach_the_best():
    """Same best documents as all products, with far fewer of them, also when tables have to be cut."""
    rnd = np.random.default_rng(2)
    topics = [np.arange(k * 20, k * 20 + 20) for k in range(40)]
    docs = [np.sort(rnd.choice(topics[i // 60], 8, replace=False)) for i in range(2400)]
    values = [rnd.integers(1, 900_000, 8) for _ in docs]
    weights = np.zeros((40, 800))
    for k in range(40):
        weights[k, rnd.choice(topics[k], 5, replace=False)] = rnd.integers(1, 9000, 5)
    dense = np.zeros((2400, 800))
    for i, (d, v) in enumerate(zip(docs, values)):
        dense[i, d] = v
    scores = weights @ dense.T
    search = Search(weights, np.arange(800), np.zeros(40))
    found = []
    for a in range(0, 2400, 600):
        ends = np.arange(0, 601) * 8
        found += [(i, a + d, s) for i, d, s in search.tree(np.arange(600), np.concatenate(docs[a : a + 600]), np.concatenate(values[a : a + 600]), ends)]
    for k in range(40):
        want = sorted((-scores[k, d], d) for d in np.flatnonzero(scores[k]))[:10]
        assert sorted((-s, d) for i, d, s in found if i == k)[:10] == want
    assert search.scored < 40 * 2400 / 10


def test_ties_and_copies(spark):
    rows = [(i, "alpha beta" if i % 3 else "alpha beta gamma delta") for i in range(4000)]
    items = [(1, "gamma"), (2, "alpha beta"), (3, "delta alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(search_documents(df, spark.createDataFrame(items, "item_id long, text string"))) == slow(rows, items)
    rnd = random.Random(1)
    rows = [(None if rnd.random() < 0.5 else 7, rnd.choice(["a b", "b c c", "c"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(search_documents(df, spark.createDataFrame([(1, "c")], "item_id long, text string"))) == slow(rows, [(1, "c")])

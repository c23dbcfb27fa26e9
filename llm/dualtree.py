"""Ranked lexical search by dual trees: hierarchies over items and documents whose nodes hold coordinate maxima.

An item's coordinates are the weights of its terms, a document's the damped counts of the same terms; a score is their
inner product. A node of documents holds the largest value of each term below it, a node of items the terms of all its
items, so the product of two nodes bounds every score between them. A pair of nodes goes, with all pairs below it, when
that bound does not reach the weakest k-th score of the node's items; else both are opened, at last item and document.

1. One pass takes the terms of whole texts; per document it keeps its length and the counts of item terms. Their
   document counts, N and L are sums; the driver gets one number for each term of a block of items.
2. Documents are dealt and sorted by their heaviest coordinate, so that those below a node are alike and its maxima
   tight; equal texts lie side by side in any number of tasks.
3. Documents of one in PRIME hashes are searched first; their k-th scores are lower bounds with which all others start.
   Every pass is exact for its documents, so the ten best of all passes' tens are the ten best of all.

Items are a query set: they are handled in blocks of bounded text (equal items as one), each against all documents.

Null text: no terms. Null doc_id: ranked after others of equal score. Null item_id: an item like others. Repeated items
give their rows repeatedly, repeated documents each take a rank; no documents or no items give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import documents, partitions, slices, stage
from sitelens.session import read_table

#: Fixed values of the contract: what separates terms (ASCII only), damping of counts, length mix in percent.
SEPARATORS = bytes(c for c in range(128) if not (chr(c).isascii() and chr(c).isalnum()))
SCALE, PER_COUNT, PER_LENGTH, MIX, TOP = 1_000_000_000, 1000, 8, 90, 10
#: Bytes of item texts in a block; documents of a tree; documents below a node, by level; nodes below an item node.
BLOCK_BYTES, TREE, LEAVES, ITEM_LEAF = 1 << 20, 2048, (512, 64, 8), 4
#: Numbers in a table of items or documents by terms.
DENSE = 4 << 20
#: One of so many hashes is searched first.
PRIME = 64

_TABLE = bytes(0x20 if c in SEPARATORS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def term_lists(texts: pa.Array) -> pa.ListArray:
    """The terms of each text (null: none), A-Z lower-cased; all else stays."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    clean = (data.to_pybytes() if data is not None else b"").translate(_TABLE)
    spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(clean)], offset=texts.offset)
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))


def _terms(text: str | None) -> list[str]:
    return sorted(set(term_lists(pa.array([text], pa.string())).flatten().to_pylist()) - {""})


def counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, codes, counts): each document's number of terms, and how often it holds those of the vocabulary."""
    known = pa.array(vocabulary, pa.large_string())

    def emit(batches):
        for batch in slices(batches):
            lists = term_lists(batch.column("text"))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, flat = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().dictionary_encode()
            real = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)
            code = pc.index_in(flat.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False)
            at = flat.indices.to_numpy()
            n = np.bincount(owner[real[at]], minlength=len(sizes))
            found = np.flatnonzero(code[at] >= 0) if len(at) else np.empty(0, int)
            keys, counts = np.unique(owner[found] * len(known) + code[at[found]], return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(sizes) + 1) * max(len(known), 1)).astype(np.int32)
            codes = (keys % max(len(known), 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, codes),
                pa.ListArray.from_arrays(ends, counts.astype(np.int32)),
            ], names=["doc_id", "n", "codes", "counts"])

    rows = docs.select("doc_id", "text").mapInArrow(emit, "doc_id long, n long, codes array<int>, counts array<int>")
    return stage(rows, "search-terms")


class Search:
    """The best documents of some items, tree by tree. weights: items x terms; terms: the code of each column; floor: a
    lower bound of each item's k-th score, raised with every tree."""

    def __init__(self, weights: np.ndarray, terms: np.ndarray, floor: np.ndarray, top: int = TOP):
        self.terms, self.top, self.floor = terms, top, np.array(floor, float)
        # neighbours share their heaviest terms; the last level are single items
        order = np.lexsort((weights.sum(axis=1), weights.argmax(axis=1)))
        self.below = [[np.array([i]) for i in order]]
        while len(self.below[0]) > 1:
            last = self.below[0]
            self.below.insert(0, [np.concatenate(last[a : a + ITEM_LEAF]) for a in range(0, len(last), ITEM_LEAF)])
        self.nodes = [np.array([weights[s].max(axis=0) for s in level]) for level in self.below]
        self.scored = 0  # pairs of an item and a document

    def tree(self, ids: np.ndarray, codes: np.ndarray, values: np.ndarray, ends: np.ndarray) -> list[tuple]:
        """(item, document, score) of the best in a run of documents: document i has the terms ends[i] to ends[i + 1].
        ids: their order among equal scores."""
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        place = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        own = self.terms[place] == codes
        used, at = np.unique(place[own], return_inverse=True)
        if not len(used):
            return []
        if len(ids) > 1 and len(ids) * len(used) > DENSE:
            half = len(ids) // 2
            found = []
            for a, b in ((0, half), (half, len(ids))):
                some = slice(ends[a], ends[b])
                inner = self.tree(ids[a:b], codes[some], values[some], ends[a : b + 1] - ends[a])
                found += [(i, a + d, score) for i, d, score in inner]
            return found
        levels, sizes = [], [*(s for s in LEAVES if s < len(ids)), 1]
        for size in sizes:
            dense = np.zeros((-(-len(ids) // size), len(used)))
            np.maximum.at(dense, (owner[own] // size, at), values[own])
            levels.append(dense)
        rows = [x[:, used] for x in self.nodes]
        weakest = [np.array([self.floor[s].min() for s in level]) for level in self.below]
        up = down = 0
        items, nodes = (x.ravel() for x in np.meshgrid(np.arange(len(rows[0])), np.arange(len(levels[0])), indexing="ij"))
        while True:
            bounds = _products(rows[up], levels[down], items, nodes)
            alive = (bounds >= weakest[up][items]) & (bounds > 0)
            items, nodes, bounds = items[alive], nodes[alive], bounds[alive]
            if up == len(rows) - 1 and down == len(levels) - 1:
                break
            if up < len(rows) - 1:
                items, nodes = _opened(items, nodes, ITEM_LEAF, len(rows[up + 1]))
                up += 1
            if down < len(levels) - 1:
                nodes, items = _opened(nodes, items, sizes[down] // sizes[down + 1], len(levels[down + 1]))
                down += 1
        self.scored += len(items)
        return self._best(items, nodes, bounds, ids)

    def _best(self, items, docs, scores, ids) -> list[tuple]:
        order = np.lexsort((ids[docs], -scores, items))
        items, docs, scores = items[order], docs[order], scores[order]
        begin = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.empty(0, int)
        rank = np.arange(len(items)) - np.repeat(begin, np.diff(np.append(begin, len(items))))
        for i, score in zip(items[rank == self.top - 1], scores[rank == self.top - 1]):
            at = self.below[-1][i][0]
            self.floor[at] = max(self.floor[at], score)
        first = rank < self.top
        return [(int(self.below[-1][i][0]), d, int(s)) for i, d, s in zip(items[first], docs[first].tolist(), scores[first])]


def _products(rows: np.ndarray, columns: np.ndarray, items: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """rows[i] @ columns[j] of each pair (whole numbers below 2**53 in doubles, so exact)."""
    if 4 * len(items) > len(rows) * len(columns):
        return (rows @ columns.T)[items, nodes]
    out = np.empty(len(items))
    order = np.argsort(items, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(items[order])) + 1) if len(order) else ():
        out[part] = columns[nodes[part]] @ rows[items[part[0]]]
    return out


def _opened(first: np.ndarray, second: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pair's `first` replaced by the (up to width) nodes below it."""
    inner = (first[:, None] * width + np.arange(width)).ravel()
    beside = np.repeat(second, width)
    real = inner < size
    return inner[real], beside[real]


def item_groups(lists: list[np.ndarray]) -> list[tuple[list[int], np.ndarray]]:
    """Runs of items (term codes each) whose items x terms stay below DENSE, or single items: (items, sorted codes)."""
    groups, held, codes = [], [], np.empty(0, np.int64)
    for i in sorted(range(len(lists)), key=lambda i: (len(lists[i]) and int(lists[i].min()), i)):
        both = np.union1d(codes, lists[i])
        if held and (len(held) + 1) * len(both) > DENSE:
            groups.append((held, codes))
            held, both = [], lists[i]
        held, codes = [*held, i], both
    return [*groups, (held, codes)] if held else groups


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def vectors(rows: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray) -> DataFrame:
    """(lead, n, doc_id, codes, values) of the documents with item terms: their coordinates, and which is heaviest."""

    def emit(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            codes, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("codes", "counts"))
            n = batch.column("n").to_pylist()
            m = np.array([100 - MIX + MIX * x * n_docs // n_terms for x in n], np.int64)[owner]
            values = SCALE * counts // (PER_COUNT * counts + PER_LENGTH * m)
            heaviest = np.lexsort((codes, -(values * weights[codes]), owner))
            lead = codes[heaviest[np.cumsum(sizes) - sizes]]
            yield pa.RecordBatch.from_arrays([
                pa.array(lead), batch.column("n"), batch.column("doc_id"), batch.column("codes"),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values)),
            ], names=["lead", "n", "doc_id", "codes", "values"])

    found = rows.where(F.size("codes") > 0).mapInArrow(emit, "lead long, n long, doc_id long, codes array<int>, values array<long>")
    prime = F.pmod(F.xxhash64("doc_id", "n", "codes"), F.lit(PRIME)) == 0
    return found.withColumns({"prime": prime, "place": F.monotonically_increasing_id()})


def searched(found: DataFrame, lists: list[np.ndarray], weights: np.ndarray, floor: np.ndarray) -> DataFrame:
    """(item, doc_id, score): the best of each task's documents, at most TOP for each item and tree."""
    groups = item_groups(lists)

    def emit(batches):
        searches = []
        for held, terms in groups:
            table = np.zeros((len(held), len(terms)))
            for k, i in enumerate(held):
                at = np.searchsorted(terms, lists[i])
                table[k, at] = weights[lists[i]]
            if len(terms):
                searches.append((held, Search(table, terms, floor[held])))
        for batch in batches:
            for start in range(0, batch.num_rows, TREE):
                run = batch.slice(start, TREE)
                ids = pc.rank(run.column("doc_id"), null_placement="at_end", tiebreaker="first").to_numpy()
                codes, values = (run.column(c).flatten().to_numpy().astype(np.int64) for c in ("codes", "values"))
                ends = np.append(0, np.cumsum(pc.list_value_length(run.column("codes")).to_numpy(zero_copy_only=False)))
                out = [(held[i], d, s) for held, search in searches for i, d, s in search.tree(ids, codes, values, ends)]
                item, doc, score = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([
                    pa.array(item, pa.int32()), run.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(score, pa.int64()),
                ], names=["item", "doc_id", "score"])

    alike = found.repartitionByRange(partitions(found), "lead", "n", "doc_id", "place").sortWithinPartitions("lead", "n", "doc_id", "place")
    return alike.select("doc_id", "codes", "values").mapInArrow(emit, "item int, doc_id long, score long")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The top rows of each item, ranked from 1."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(docs: DataFrame, items: list, kind: str, top: int) -> DataFrame:
    """Ranked rows of some items, given as (item_id, text, how often) rows."""
    spark = docs.sparkSession
    terms = [_terms(r["text"]) for r in items]
    vocabulary = sorted(set().union(*terms))
    code = {t: i for i, t in enumerate(vocabulary)}
    lists = [np.array([code[t] for t in ts], np.int64) for ts in terms]
    rows = counted(docs, vocabulary)
    total = rows.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("codes").alias("c")).groupBy("c").count().collect():  # at most a number for each term
        df[r["c"]] = r["count"]
    weights = np.array([weight(total["n"], int(x)) for x in df], np.int64)
    found = stage(vectors(rows, total["n"], total["l"] or 1, weights), "search-vectors")
    first = stage(best(searched(found.where("prime"), lists, weights, np.zeros(len(items))), top), "search-first")
    floor = np.zeros(len(items))
    for r in first.where(F.col("rank") == top).select("item", "score").collect():  # at most one for each item
        floor[r["item"]] = r["score"]
    rest = searched(found.where("NOT prime"), lists, weights, floor)
    ranked = best(first.drop("rank").unionByName(rest), top)
    named = spark.createDataFrame(
        [(i, r["item_id"], r["times"]) for i, r in enumerate(items)], f"item int, item_id {kind}, times long"
    )
    again = named.join(ranked, "item").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return again.select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` documents. items: item_id, text."""
    same = items.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = 1 + size // block_bytes
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    kind = items.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        some = same.where(of == block).orderBy("item_id", "text").collect()  # about block_bytes of text
        if some:
            out = out.unionByName(_block(docs, some, kind, top))
    return out


#: The same rows in DuckDB, by all pairs that share a term.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(terms) AS term, len(terms) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
), counts AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM words GROUP BY doc_id, term),
total AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM words),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (
  SELECT c.term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts c, total WHERE c.term IN (SELECT term FROM asked) GROUP BY c.term
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counts USING (term), total GROUP BY item_id, doc_id
), ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 10
"""


def op11_dual_tree_search(spark, sf_dir: str) -> DataFrame:
    return search_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))

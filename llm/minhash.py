"""MinHash fingerprints of documents under many universal hash permutations.

The words of a text (runs of other characters than space and U+0009..U+000D) give shingles; a shingle's 64-bit base
hash x goes through PERMUTATIONS bijections a * x + b mod 2^64 (a odd), and each keeps its least value. All of that is
numpy over blocks of shingles, so a text of any length needs bounded memory beside itself. The likeness of two
fingerprints, the share of equal values, estimates the Jaccard similarity of the shingle sets.

Null text counts as empty: no shingles, a fingerprint of its own that is like other empty ones alone. A text with fewer
words than a shingle has one shingle of them all. Equal texts have equal fingerprints; an empty table gives no rows;
other columns are ignored.

`near_duplicates` links documents whose 5-word shingle sets have a Jaccard similarity of SIMILARITY or more. Signatures
are cut into bands; texts that agree in a band meet in a bucket by a Spark join, and every pair that is compared is
verified on the whole shingle sets. A bucket is not expanded into all pairs: in round k the members of rank 2^k - 1 to
2^(k+1) - 2 are held against the later members of other components only. The first one links a group of near copies, so
later rounds have only what is still apart; no pair of one bucket stays both unlinked and uncompared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import documents, narrow, partitions, range_bounds, range_bucket, record_batch, slices, stage
from llm.components import components
from sitelens.plans.ids import dense_ids

SHINGLE_WORDS, PERMUTATIONS, SEED = 5, 128, 7
#: Values of a band (with 128 values a pair at 0.8 meets in some band but for a chance of 0.002), least similarity.
BAND_VALUES, SIMILARITY = 6, 0.8
_BLOCK = 512
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class MinHash:
    """Signatures of texts; `coefficients` are drawn once from the seed."""

    def __init__(self, shingle_words: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS, seed: int = SEED):
        draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, permutations), dtype=np.uint64)
        self.words = shingle_words
        self.a, self.b = (draw[0] << np.uint64(1) | np.uint64(1))[:, None], draw[1][:, None]

    def shingles(self, text: str) -> np.ndarray:
        """Base hashes of the word shingles in order, repeats included."""
        words = text.encode().split()  # bytes.split knows the six ASCII characters of the word rule alone
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        k = min(self.words, len(words))
        out = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            out = _mix(out + hashes[j : len(hashes) - k + 1 + j])
        return out

    def signature(self, text: str) -> np.ndarray:
        x = self.shingles(text)
        least = np.full(len(self.a), _NONE)
        for i in range(0, len(x), _BLOCK):
            values = self.a * x[i : i + _BLOCK]
            values += self.b
            np.minimum(least, values.min(axis=1), out=least)
        return (least >> np.uint64(16)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def bands(signature: np.ndarray, values: int = BAND_VALUES) -> list[int]:
    """A signed 64-bit hash of each full band of values."""
    return [
        xxhash.xxh64_intdigest(signature[i : i + values].tobytes(), i) - (1 << 63)
        for i in range(0, len(signature) - values + 1, values)
    ]


def shingle_sets(docs: DataFrame, **options) -> DataFrame:
    """doc_id, set_key (a hash of the shingle set), shingles (sorted, distinct), bands."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("set_key", pa.int64()), ("shingles", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
    ])

    def emit(batches):
        hasher = MinHash(**options)
        for batch in slices(batches, 1 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                distinct = np.unique(hasher.shingles(text).view(np.int64))
                key = xxhash.xxh64_intdigest(distinct.tobytes()) - (1 << 63)
                rows.append((doc_id, key, distinct, bands(hasher.signature(text))))
            yield record_batch(schema, list(zip(*rows)))

    return narrow(docs).mapInArrow(emit, "doc_id long, set_key long, shingles array<long>, bands array<long>")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id reachable by verified links), n_links (verified links of its shingle set to
    other sets that had to be compared). Documents with equal shingle sets are of one class. A null doc_id is no
    candidate for class_id."""

    sets = stage(shingle_sets(docs, **options), "shingle-sets")
    one = sets.groupBy("set_key").agg(F.min("doc_id").alias("first"))
    distinct = sets.dropDuplicates(["set_key"]).select("set_key", "shingles", "bands")  # equal rows: whichever stays
    spots = distinct.select(F.col("set_key").alias("k"), F.posexplode("bands").alias("band", "value"))
    spots = stage(dense_ids(spots, "k", "rank", group_by=["band", "value"]), "bands")
    longest = spots.agg(F.max("rank").alias("r")).first()["r"]
    links = None
    roots = None
    first = 0
    while longest is not None and first < longest:
        rows = spots
        if roots is not None:
            rows = spots.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
        else:
            rows = spots.withColumn("root", F.col("k"))
        lead = rows.where(F.col("rank").between(first, 2 * first)).select(
            "band", "value", F.col("k").alias("a"), F.col("rank").alias("lead_rank"), F.col("root").alias("lead_root")
        )
        pairs = rows.where(F.col("rank") > first).join(lead, ["band", "value"]).where(
            (F.col("rank") > F.col("lead_rank")) & (F.col("root") != F.col("lead_root"))
        ).select("a", F.col("k").alias("b")).distinct()
        left = distinct.select(F.col("set_key").alias("a"), F.col("shingles").alias("x"))
        right = distinct.select(F.col("set_key").alias("b"), F.col("shingles").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        verified = pairs.join(left, "a").join(right, "b").where(
            (F.size("x") > 0) & (common >= F.lit(similarity) * (F.size("x") + F.size("y") - common))
        )
        found = stage(verified.select("a", "b"), "near-links")
        links = found if links is None else links.union(found)
        roots = stage(components(links), "near-roots")
        first = 2 * first + 1
    named = one if roots is None else one.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = named.withColumn("root", F.coalesce("root", "set_key") if roots is not None else F.col("set_key"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = named.join(least, "root").select("set_key", "class_id")
    if links is None:
        return sets.join(named, "set_key").select("doc_id", "class_id", F.lit(0).cast("long").alias("n_links"))
    ends = links.select(F.explode(F.array("a", "b")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("n_links"))
    return sets.select("doc_id", "set_key").join(named, "set_key").join(ends, "set_key", "left").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


_RESULT = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
 near_edited double, near_next double"""


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(part, ahead, doc_id, text) so that each partition holds ranges of doc_id in descending order, each range followed
    by the first row of the range after it (ahead; after the last range: of the first one). Texts are shuffled once; the
    driver gets one number for each range."""
    least = F.lit(-(1 << 63))
    n = partitions(docs)
    keyed = narrow(docs).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), least))
    part = range_bucket(F.col("key"), range_bounds(docs, "doc_id", n))
    heads = keyed.select("key", part.alias("part")).groupBy("part").agg(F.max("key").alias("key")).orderBy("part").collect()
    after = {h["key"]: heads[(i + 1) % len(heads)]["part"] for i, h in enumerate(heads)}
    table = docs.sparkSession.createDataFrame(list(after.items()) or [(0, 0)], "key long, target int")
    spot = lambda at, ahead: F.struct(F.col(at).alias("part"), F.lit(ahead).alias("ahead"))
    spots = F.when(F.col("target").isNull(), F.array(spot("part", False))).otherwise(
        F.array(spot("part", False), spot("target", True))
    )
    # one row for each range of the shuffle: its size follows the number of partitions
    dealt = keyed.withColumn("part", part).join(F.broadcast(table), "key", "left")
    dealt = dealt.select("doc_id", "text", "key", F.inline(spots))
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ahead", F.desc("key"), "text")
    return dealt.select("part", "ahead", "doc_id", "text")


def fingerprint_with_next(docs: DataFrame, **options) -> DataFrame:
    """The fingerprint of every text and of its edited text (the last third replaced by the start of the next document,
    by descending doc_id), with the likeness of its own to the edited and to the next one."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("sha", "own", "edited")),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def run(batches):
        hasher, last, out = MinHash(**options), None, []
        for batch in batches:
            columns = (batch.column(c) for c in ("part", "ahead", "doc_id", "text"))
            for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in columns)):
                if last and last[1]:  # a range has ended; no more is needed of what was ahead of it
                    if ahead and part == last[0]:
                        continue
                    last = None
                own = hasher.signature(text)
                if last:
                    _, _, id_before, before, signature = last
                    n = len(before)
                    edited = before[: n - n // 3] + text[: n // 3]
                    other = hasher.signature(edited)
                    out.append((
                        id_before, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(signature),
                        fingerprint(other), likeness(signature, other), likeness(signature, own),
                    ))
                last = (part, ahead, doc_id, text, own)
                if len(out) >= 1000:
                    yield record_batch(schema, list(zip(*out)))
                    out = []
        if out:
            yield record_batch(schema, list(zip(*out)))

    return in_descending_order(docs).mapInArrow(run, _RESULT)


def op2_minhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(documents(spark, sf_dir))

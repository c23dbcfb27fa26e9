"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of the word shingles. For a radius r, 2^(r+1) - 1
bit masks are built from scalar products over GF(2): bit i has a vector m(i), mask v keeps the bits with <m(i), v> = 1.
For any r differing bits some v other than 0 is orthogonal to all their vectors, so each pair within the radius agrees
under some mask. Distinct fingerprints are bucketed by their kept bits. A bucket with more than BUCKET members is dealt
out again by masks over the bits that are still free; after some levels so few bits are free that no bucket can be
larger, so every bucket is compared whole, none is capped, and no task holds an unbounded one. A bucket gives each
member one link to the least member that it reaches inside the bucket, never all pairs.

Null or empty texts have no words: fingerprint zero, linked like any other. Equal texts and repeated rows have equal
fingerprints; an empty table gives no rows; other columns are ignored. A null doc_id gets a result row, but is no
candidate for component_id unless its whole component has null ids (then component_id is null). `keep_first` decides
for each component by itself, so neither null nor shared doc_ids cost a document that has no copy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from llm.common import documents, narrow, stage
from llm.components import components

#: Fixed values of the contract.
SHINGLE_WORDS, RADIUS, SEED = 3, 2, 42
#: Distinct fingerprints that one task compares with each other.
BUCKET = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit form. Only A-Z are lower-cased; words end at space and U+0009..U+000D."""
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII alone
    if not words:
        return 0
    data, k = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(stops)
    for i in range(0, n, _BLOCK):
        h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[i : i + _BLOCK], stops[i : i + _BLOCK])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return narrow(docs).select("doc_id", _text_key().alias("text_key"), fp("text").alias("fp"))


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the set bits of `free`: any `radius` of them are left out together by some mask."""
    bits = [i for i in range(64) if free >> i & 1]
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for place, bit in enumerate(bits) if ((place % vectors + 1) & v).bit_count() & 1)
        for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, masks: list[tuple[int, int, int]]) -> DataFrame:
    """One row (mask, bucket, fp) for each mask that follows the row's mask. masks: (before, number, kept bits), a table
    whose size depends on the radius alone."""
    table = rows.sparkSession.createDataFrame([(a, b, _signed(c)) for a, b, c in masks], "mask int, next int, kept long")
    dealt = rows.join(F.broadcast(table), "mask")
    return dealt.select(F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("kept")).alias("bucket"), "fp")


def links_within(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) with the same components as all pairs within `radius`."""

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def compared(lists: pd.Series) -> pd.Series:
        def star(members):
            x = np.sort(np.asarray(members, np.int64))
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            label = np.arange(len(x))
            while True:
                least = np.where(near, label[None, :], len(x)).min(axis=1)
                if (least == label).all():
                    break
                label = least
            return [{"a": int(x[i]), "b": int(x[k])} for i, k in enumerate(label.tolist()) if i != k]

        return lists.map(star)

    full = (1 << 64) - 1
    kept_of, level = {0: 0}, [0]
    rows = fps.select(F.lit(0).alias("mask"), "fp")
    found = []
    while True:
        masks = []
        for before in level:
            for kept in covering_masks(full & ~kept_of[before], radius):
                number = len(kept_of)
                kept_of[number] = kept | kept_of[before]
                masks.append((before, number, kept_of[number]))
        dealt = stage(_deal(rows, masks), "buckets")
        sizes = dealt.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1")
        sized = dealt.join(sizes, ["mask", "bucket"])
        groups = sized.where(F.col("n") <= bucket).groupBy("mask", "bucket").agg(F.collect_list("fp").alias("fps"))
        found.append(groups.select(F.inline(compared("fps"))))
        level = [number for _, number, _ in masks]
        most = max((full & ~kept_of[m]).bit_count() for m in level)
        if 1 << most <= bucket or sizes.where(F.col("n") > bucket).isEmpty():
            break
        rows = sized.where(F.col("n") > bucket).select("mask", "fp")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _rooted(marked: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """marked: rows of `fingerprints`. (fp, root) of each distinct fingerprint, and (root, first) of each component: its
    row of the smallest doc_id (null last), then of the least text_key."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    distinct = stage(marked.groupBy("fp").agg(F.min(row).alias("first")), "fingerprints")
    roots = components(links_within(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    return rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links of at most `radius` differing bits)."""
    marked = stage(fingerprints(docs, shingle_words), "simhash")
    rooted, least = _rooted(marked, radius)
    named = rooted.join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Of each component one row with all its columns: that of the smallest doc_id (null last; of several texts of this
    doc_id in the component the one of the least hash)."""
    _, least = _rooted(stage(fingerprints(docs, shingle_words), "simhash"), radius)
    kept = least.select(F.col("first.doc_id").alias("__kept_id"), F.col("first.text_key").alias("__kept_key"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (_text_key() == F.col("__kept_key"))
    rows = docs.join(kept, same, "left_semi")
    # repeated rows of one doc_id and text: one stays
    order = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    nth = F.row_number().over(Window.partitionBy("doc_id", _text_key()).orderBy(*order))
    return rows.select("*", nth.alias("__nth")).where("__nth = 1").drop("__nth")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

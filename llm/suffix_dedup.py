"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes are bucketed by their first q bytes and refined by the bucket identifiers at later offsets: the identifier at
depth 2d of position i comes from those at depth d of i and of i + d, so each round reuses the last one, up to DEPTH
bytes. A bucket with one suffix is final and never refined. Identifiers are 64-bit hashes, not ranks, so that partitions
agree on them without a global sort.

Only anchors are exchanged between partitions. A DEPTH-byte string's anchor is its least q-gram identifier (leftmost),
which equal strings share, so strings that start near each other form a run with one anchor:
1. anchor buckets over all documents; anchors that occur once are final, their runs hold no repeated string;
2. runs with other anchors are refined as a whole: a run that occurs twice is repeated throughout;
3. anchors with several different runs are refined string by string, from one copy of each run: a bucket of strings
   of one anchor fits a task; one with over BUCKET_RUNS runs is dealt out by string instead.
Then each document drops the bytes that its repeated strings cover. The identifiers of strings are compared within
their anchor's bucket, so two different strings are taken for equal only if two 64-bit hashes agree.

Null text: empty. A text shorter than DEPTH bytes loses nothing. Repeated rows are documents of their own, so all their
strings are repeated. Null doc_ids and rows that share one are handled by doc_id and a hash of the text; an empty table
gives no rows; other columns are ignored by `find_repeats` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import documents, narrow, record_batch, slices, stage

#: Fixed value of the contract.
DEPTH = 200
#: Bytes of the q-grams whose buckets come first.
Q = 32
#: Different runs of one anchor that a task refines together.
BUCKET_RUNS = 50_000
#: Bytes that are refined at once.
BLOCK = 1 << 18
_PLACE_BITS = np.uint64(24)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _A
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: np.ndarray, depth: int) -> np.ndarray:
    """The bucket identifier at `depth` (8 or more) of each position that has so many bytes."""
    n = len(data)
    if n < depth:
        return np.empty(0, np.uint64)
    ids = _mix(np.ndarray((n - 7,), "<u8", data, strides=(1,)) * _B)
    have = 8
    while have < depth:
        step = min(have, depth - have)
        ids = _mix(ids[:-step] * _B + ids[step:])
        have += step
    return ids


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: least of a block's end and of the next block's start."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ends = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ends[: n - width + 1], starts[width - 1 : n])


class Runs:
    """The runs of strings with one anchor place, over texts that stand one after the other in `data`.

    text, start (in the text), size (number of strings), anchor; with whole=True also `whole`, the identifier of the
    run, and `begin`, its place in data."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, whole: bool):
        self.text = self.start = self.size = np.empty(0, np.int64)
        self.anchor = self.whole = np.empty(0, np.uint64)
        self.begin = self.start
        ends = np.cumsum(sizes)
        if len(data) < DEPTH:
            return
        grams = identifiers(data, Q)
        places = np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(grams >> _PLACE_BITS << _PLACE_BITS | places, DEPTH - Q + 1)
        at = np.flatnonzero(np.repeat(ends, sizes)[: len(least)] - np.arange(len(least)) >= DEPTH)
        if not len(at):
            return
        place = (least[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.begin, self.size = at[first], np.diff(np.append(first, len(at)))
        self.anchor = grams[place[first]]
        self.text = np.searchsorted(ends, self.begin, "right")
        self.start = self.begin - (ends - sizes)[self.text]
        if whole:
            strings = identifiers(data, DEPTH)[at]
            self.whole = np.add.reduceat(_mix(strings + (place - at).astype(np.uint64) * _B), first)


def blocks(batch: pa.RecordBatch):
    """(data, sizes, rows, offsets): texts of a batch joined to blocks, long ones cut so that no string is lost."""
    held, sizes, rows, offsets = [], [], [], []
    total = 0
    for row, text in enumerate(batch.column("text").to_pylist()):
        raw = text.encode()
        for at in range(0, max(1, len(raw) - DEPTH + 1), BLOCK):
            part = raw[at : at + BLOCK + DEPTH - 1]
            held.append(part)
            sizes.append(len(part))
            rows.append(row)
            offsets.append(at)
            total += len(part)
            if total >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(sizes), np.array(rows), np.array(offsets)
                held, sizes, rows, offsets, total = [], [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(sizes), np.array(rows), np.array(offsets)


def anchors(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, anchors array<long>: the anchors of each text, one that stands there several times twice."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def emit(batches):
        for batch in slices(batches):
            owners, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            out_ids, out_keys, out = [], [], []
            for data, sizes, of, _ in blocks(batch):
                runs = Runs(data, sizes, False)
                if not len(runs.text):
                    continue
                order = np.lexsort((runs.anchor, runs.text))
                text, anchor = runs.text[order], runs.anchor[order]
                same = np.concatenate([[False], (text[1:] == text[:-1]) & (anchor[1:] == anchor[:-1])])
                third = same & np.concatenate([[False], same[:-1]])
                text, anchor = text[~third], anchor[~third].view(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                rows_of = of[text[cuts]].tolist()
                out_ids += [owners[r] for r in rows_of]
                out_keys += [keys[r] for r in rows_of]
                out += np.split(anchor, cuts[1:])
            if out:
                yield record_batch(schema, [out_ids, out_keys, out])

    return rows.select("doc_id", "text_key", "text").mapInArrow(emit, "doc_id long, text_key long, anchors array<long>")


_RUN = "doc_id long, text_key long, anchor long, whole long, start long, size int, times int, data binary"


def shared_runs(rows: DataFrame) -> DataFrame:
    """Runs of the rows (doc_id, text_key, text, shared: anchors that occur more than once) with those anchors. `times`
    equal runs that follow each other are one row; data: the bytes of one."""
    names = [c.split()[0] for c in _RUN.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def emit(batches):
        for batch in slices(batches, limit=1 << 21):
            owners, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            shared = batch.column("shared").to_pylist()
            for data, sizes, of, offsets in blocks(batch):
                runs = Runs(data, sizes, True)
                known = np.array(sorted({x for row in set(of.tolist()) for x in shared[row]}), np.int64).view(np.uint64)
                keep = np.flatnonzero(np.isin(runs.anchor, known))
                if not len(keep):
                    continue
                text, begin, size, anchor, whole = (
                    x[keep] for x in (runs.text, runs.begin, runs.size, runs.anchor, runs.whole)
                )
                again = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1]) & (size[1:] == size[:-1])
                again &= (text[1:] == text[:-1]) & (begin[1:] == begin[:-1] + size[:-1])
                first = np.flatnonzero(np.concatenate([[True], ~again]))
                times = np.diff(np.append(first, len(begin)))
                text, begin, size = text[first], begin[first], size[first]
                row, start = of[text], runs.start[keep][first] + offsets[text]
                raw = data.tobytes()
                yield record_batch(schema, [
                    [owners[r] for r in row.tolist()], [keys[r] for r in row.tolist()], anchor[first].view(np.int64),
                    whole[first].view(np.int64), start, size.astype(np.int32), times.astype(np.int32),
                    [raw[b : b + s + DEPTH - 1] for b, s in zip(begin.tolist(), size.tolist())],
                ])

    return rows.mapInArrow(emit, _RUN)


def _strings(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers of the strings of each run, their run and their place in it."""
    sizes = np.array([len(d) for d in data])
    joined = np.frombuffer(b"".join(data), np.uint8)
    ids = identifiers(joined, DEPTH)
    ends = np.cumsum(sizes)
    at = np.flatnonzero(np.repeat(ends, sizes)[: len(ids)] - np.arange(len(ids)) >= DEPTH)
    run = np.searchsorted(ends, at, "right")
    return ids[at], run, at - (ends - sizes)[run]


def _as_ranges(places: np.ndarray) -> list[dict]:
    cuts = np.flatnonzero(np.diff(places) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(places[np.append(0, cuts + 1)], places[np.append(cuts, -1)])]


_REFINED = "anchor long, whole long, ranges array<struct<a: int, b: int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def refined(runs: DataFrame) -> DataFrame:
    """runs: different runs (anchor, whole, data), those of an anchor next to each other in one partition. Gives the ranges
    of strings that some other run of the anchor has too."""
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("ranges", _RANGES)])

    def resolve(anchor, whole, data):
        ids, run, place = _strings(data)
        key = np.array(anchor, np.int64).view(np.uint64)[run]
        order = np.lexsort((ids, key))
        same = (ids[order][1:] == ids[order][:-1]) & (key[order][1:] == key[order][:-1])
        twice = np.zeros(len(ids), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        run, place = run[twice], place[twice]
        if not len(run):
            return None
        cuts = np.flatnonzero(np.diff(run)) + 1
        found = [int(r) for r in run[np.append(0, cuts)]]
        ranges = [_as_ranges(p) for p in np.split(place, cuts)]
        return record_batch(schema, [[anchor[r] for r in found], [whole[r] for r in found], ranges])

    def emit(batches):
        anchor, whole, data, held = [], [], [], 0
        for batch in batches:
            for a, w, d in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "data"))):
                if held > 1 << 22 and a != anchor[-1]:
                    if (got := resolve(anchor, whole, data)) is not None:
                        yield got
                    anchor, whole, data, held = [], [], [], 0
                anchor.append(a)
                whole.append(w)
                data.append(d)
                held += len(d)
        if data and (got := resolve(anchor, whole, data)) is not None:
            yield got

    return runs.select("anchor", "whole", "data").mapInArrow(emit, _REFINED)


def refined_by_string(runs: DataFrame) -> DataFrame:
    """The same for anchors with any number of runs: the strings themselves are dealt out and counted."""
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("id", pa.int64()), ("place", pa.int32())])

    def emit(batches):
        for batch in slices(batches, limit=1 << 21, column="data"):
            anchor, whole = (batch.column(c).to_numpy() for c in ("anchor", "whole"))
            ids, run, place = _strings(batch.column("data").to_pylist())
            yield record_batch(schema, [anchor[run], whole[run], ids.view(np.int64), place.astype(np.int32)])

    strings = runs.select("anchor", "whole", "data").mapInArrow(emit, "anchor long, whole long, id long, place int")
    twice = strings.groupBy("anchor", "id").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "id")
    places = strings.join(twice, ["anchor", "id"]).groupBy("anchor", "whole").agg(F.collect_list("place").alias("places"))
    ranges = F.transform("places", lambda p: F.struct(p.alias("a"), p.alias("b")))  # a run has at most DEPTH strings
    return places.select("anchor", "whole", ranges.alias("ranges"))


def repeated_ranges(docs: DataFrame, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """doc_id, text_key, spans array<struct<a, b>>: byte ranges [a, b) to remove from the texts that have any."""
    keyed = narrow(docs).withColumn("text_key", F.xxhash64("text"))
    found = stage(anchors(keyed), "anchors")
    each = found.select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    buckets = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # rows without an id, or of one id, are told apart by their texts
    shared = each.join(buckets, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("shared"))
    shared = shared.withColumnsRenamed({"doc_id": "holder", "text_key": "held"})
    holders = keyed.join(shared, F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("text_key") == F.col("held")))
    runs = stage(shared_runs(holders.select("doc_id", "text_key", "text", "shared")), "runs")
    different = stage(
        runs.groupBy("anchor", "whole").agg(F.sum("times").alias("total"), F.max("size").alias("size"), F.min("data").alias("data")),
        "different-runs",
    )
    several = different.groupBy("anchor").agg(F.count("*").alias("n_runs")).where("n_runs > 1")
    contested = different.join(several, "anchor")
    near = contested.where(F.col("n_runs") <= bucket_runs).repartition("anchor").sortWithinPartitions("anchor")
    by_string = refined(near).union(refined_by_string(contested.where(F.col("n_runs") > bucket_runs)))
    partly = by_string.join(different.where("total = 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi")
    throughout = different.where("total > 1").select(
        "anchor", "whole", F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - 1).cast("int").alias("b"))).alias("ranges")
    )
    spans = runs.select("doc_id", "text_key", "anchor", "whole", "start", "size", "times").join(
        throughout.union(partly), ["anchor", "whole"]
    )
    # a run that stands several times in a row is repeated throughout
    last = lambda r: F.col("start") + r["b"] + (F.col("times") - 1) * F.col("size") + DEPTH
    spans = spans.select(
        "doc_id", "text_key", F.inline(F.transform("ranges", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), last(r).alias("b"))))
    )
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """docs with column __spans (null: nothing to remove)."""
    spans = repeated_ranges(docs, **options).select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")
    )
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    on = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text_key") == F.col("__key"))
    return docs.withColumn("__text_key", key).join(spans, on, "left").drop("__doc", "__key", "__text_key")


def removed_mask(size: int, spans) -> np.ndarray:
    change = np.zeros(size + 1, np.int32)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def find_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string())]
    )

    def emit(batches):
        for batch in slices(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "__spans"))
            for doc_id, text, spans in zip(*columns):
                raw = text.encode()
                gone, n_spans = 0, 0
                if spans:
                    mask = removed_mask(len(raw), [(s["a"], s["b"]) for s in spans])
                    gone = int(mask.sum())
                    n_spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                else:
                    kept = raw
                out.append((doc_id, len(raw), gone, n_spans, hashlib.sha256(kept).hexdigest()))
            yield record_batch(schema, list(zip(*out)))

    marked = with_spans(narrow(docs), **options).select("doc_id", "text", "__spans")
    return marked.mapInArrow(emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated bytes removed from text; a character goes if all its bytes do."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def keep(text, found):
            if found is None or not len(found):
                return text
            raw = np.frombuffer(text.encode(), np.uint8)
            gone = removed_mask(len(raw), [(s["a"], s["b"]) for s in found])
            starts = np.flatnonzero((raw & 0xC0) != 0x80)
            whole = np.logical_and.reduceat(gone, starts)
            return raw[~np.repeat(whole, np.diff(np.append(starts, len(raw))))].tobytes().decode()

        return pd.Series([keep(t, s) for t, s in zip(texts, spans)], dtype=object)

    return with_spans(docs, **options).withColumn("text", kept("text", "__spans")).drop("__spans")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return find_repeats(documents(spark, sf_dir))


#: The same in DuckDB: every 200-byte string of every text, those that start twice, and the bytes that they cover.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
blocks AS (SELECT r, base, substr(h, 2 * base + 1, 2 * (1024 + 199)) AS b
           FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 1024)) AS base FROM d WHERE length(h) >= 400)),
strings AS (SELECT r, base + i AS p, md5(substr(b, 2 * i + 1, 400)) AS s
            FROM (SELECT r, base, b, unnest(range(least(1024, length(b) // 2 - 199))) AS i FROM blocks)),
twice AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
covered AS (SELECT r, p, p > lag(p, 1, -201) OVER (PARTITION BY r ORDER BY p) + 200 AS starts
            FROM strings SEMI JOIN twice USING (s)),
numbered AS (SELECT r, p, sum(starts::INT) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM covered),
spans AS (SELECT r, run, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, run),
pieces AS (SELECT s.r, s.run, s.b, s.b - s.a AS n,
                  substr(d.h, 2 * lag(s.b, 1, 0) OVER (PARTITION BY s.r ORDER BY s.run) + 1,
                         2 * (s.a - lag(s.b, 1, 0) OVER (PARTITION BY s.r ORDER BY s.run))) AS x
           FROM spans s JOIN d USING (r)),
kept AS (SELECT r, sum(n) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(x, '' ORDER BY run) AS x FROM pieces GROUP BY r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.x || substr(d.h, 2 * kept.last + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

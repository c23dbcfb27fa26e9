"""Token ids as wavelet matrices, one compressed file for each shard of documents.

A shard holds consecutive documents in doc_id order. Its ids are stored as bit planes, highest bit first; below each
plane the ids stand stably partitioned by that bit. Rank counts for each block of bits give access to single tokens,
counts of an id in a prefix, and the place of its k-th occurrence, without decoding the shard. The file holds a header,
the documents' ids and lengths, the planes and the rank blocks, each zstandard-compressed.

Spark deals documents to doc_id ranges, each task encodes its range in order and cuts shards, and the DataFrame writer
puts every shard into a file of its own in the shared folder: a lost executor's files are written anew, and readers see
committed files alone. Null text: empty (the document's end id alone). Repeated rows are stored repeatedly, in an
arbitrary order among themselves; null doc_ids come first; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.chunks import ENCODE_BYTES, tokenizer_encoder
from llm.common import BATCH_ROWS, documents, narrow, partitions, range_bounds, range_bucket, record_batch, slices, stage

#: Tokens of a shard, beside a longer single document.
SHARD_TOKENS = 1 << 21
#: Fixed value of the contract.
END_ID = 2
BLOCK_BITS = 512
_MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sBBQQ")
_NULL_ID = -(1 << 63)


def _mask(plane: np.ndarray, n: int) -> pa.BooleanArray:
    return pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(plane)])


class WaveletMatrix:
    """Bit planes of a sequence of ids with rank and select."""

    def __init__(self, planes: list[np.ndarray], n: int, blocks: list[np.ndarray]):
        self.planes, self.n, self.blocks, self.bits = planes, n, blocks, len(planes)
        self.zeros = [n - int(b[-1]) for b in blocks]

    @staticmethod
    def _blocks(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        padded = np.zeros(-(-len(plane) // (BLOCK_BITS // 8)) * (BLOCK_BITS // 8), np.uint8)
        padded[: len(plane)] = plane
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)]).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        kind = pa.uint16() if bits <= 16 else pa.uint32()
        cur, n, planes = ids.astype(kind.to_pandas_dtype()), len(ids), []
        for b in range(bits - 1, -1, -1):
            plane = np.packbits((cur >> b).astype(np.uint8) & 1, bitorder="little")
            planes.append(plane)
            if b:
                rows = pa.array(cur, kind)
                ones = rows.filter(_mask(plane, n))
                zeros = rows.filter(_mask(~plane, n))
                cur = np.concatenate([zeros.to_numpy(), ones.to_numpy()])
        return cls(planes, n, [cls._blocks(p) for p in planes])

    def ids(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest up."""
        kind = pa.uint16() if self.bits <= 16 else pa.uint32()
        cur = pa.array(np.zeros(self.n, kind.to_pandas_dtype()))
        for level in range(self.bits - 1, -1, -1):
            plane, zeros = self.planes[level], self.zeros[level]
            ones = cur[zeros:].to_numpy() | kind.to_pandas_dtype()(1 << (self.bits - 1 - level))
            spread = pc.replace_with_mask(cur, _mask(~plane, self.n), cur[:zeros])
            cur = pc.replace_with_mask(spread, _mask(plane, self.n), pa.array(ones))
        return cur.to_numpy()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK_BITS
        start = block * BLOCK_BITS // 8
        part = self.planes[level][start : i >> 3]
        ones = int(self.blocks[level][block]) + int(np.bitwise_count(part).sum())
        if i & 7:
            ones += (int(self.planes[level][i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return ones

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, value: int, end: int | None = None) -> int:
        """How often `value` stands among the first `end` ids."""
        if value < 0 or value >> self.bits:
            return 0
        low, high = 0, self.n if end is None else end
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if value >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return high - low

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        blocks = self.blocks[level].astype(np.int64)
        before = blocks if bit else np.arange(len(blocks)) * BLOCK_BITS - blocks
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * BLOCK_BITS
        some = np.unpackbits(self.planes[level][start // 8 : (start + BLOCK_BITS) // 8], bitorder="little")
        return start + int(np.flatnonzero(some == bit)[k - int(before[block])])

    def locate(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of `value`, or -1."""
        if not 0 <= k < self.count(value):
            return -1
        low = 0
        for level in range(self.bits):
            ones = self._rank1(level, low)
            low = self.zeros[level] + ones if value >> (self.bits - 1 - level) & 1 else low - ones
        i = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i


class Shard:
    """The content of one file: documents in order and the wavelet matrix of their ids."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [self.doc_ids.astype("<i8"), self.lengths.astype("<u4")]
        parts += self.matrix.planes + [b.astype("<u4") for b in self.matrix.blocks]
        packed = [pack(p.tobytes()) for p in parts]
        head = _HEAD.pack(_MAGIC, self.matrix.bits, 0, len(self.doc_ids), self.matrix.n)
        return head + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, bits, _, _, n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        sizes = struct.unpack_from(f"<{2 + 2 * bits}Q", data, _HEAD.size)
        at, parts, unpack = _HEAD.size + 8 * len(sizes), [], zstandard.ZstdDecompressor().decompress
        for size in sizes:
            parts.append(unpack(data[at : at + size]))
            at += size
        planes = [np.frombuffer(p, np.uint8) for p in parts[2 : 2 + bits]]
        blocks = [np.frombuffer(p, "<u4") for p in parts[2 + bits :]]
        return cls(np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<u4"), WaveletMatrix(planes, n, blocks))


_SHARD = "part int, shard int, n_tokens long, data binary"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of written shards, one file each: part and shard rise with doc_id; data is a Shard's bytes."""
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def cut(batches):
        encoder = tokenizer_encoder(source, True)
        part, shard, ids, held, names, lengths = None, 0, [], 0, [], []

        def full():
            matrix = WaveletMatrix.build(np.concatenate(ids))
            data = Shard(np.array(names, np.int64), np.array(lengths, np.uint32), matrix).to_bytes()
            return record_batch(schema, [[part], [shard], [matrix.n], [data]])

        for batch in slices(batches, ENCODE_BYTES):
            flat, counts = encoder(batch.column("text"))
            ends = np.cumsum(counts + 1)
            with_end = np.full(int(ends[-1]), end_id, np.uint32)
            spaces = np.ones(len(with_end), bool)
            spaces[ends - 1] = False
            with_end[spaces] = flat
            parts = batch.column("part").to_numpy()
            owners = pc.fill_null(batch.column("doc_id").cast(pa.int64()), _NULL_ID).to_pylist()
            first = 0
            for i, (p, end) in enumerate(zip(parts.tolist(), ends.tolist())):
                begin = end - int(counts[i]) - 1
                if names and (p != part or held + end - begin > shard_tokens):
                    ids.append(with_end[first:begin])
                    yield full()
                    shard = shard + 1 if p == part else 0
                    ids, held, names, lengths, first = [], 0, [], [], begin
                part = p
                names.append(owners[i])
                lengths.append(end - begin)
                held += end - begin
            ids.append(with_end[first:])
        if names:
            yield full()

    rows, n = narrow(docs), partitions(docs)
    bounds = range_bounds(docs, "doc_id", n)
    ranged = rows.withColumn("part", range_bucket(F.col("doc_id"), bounds)).repartitionById(n, F.col("part"))
    shards = ranged.sortWithinPartitions("part", "doc_id", "text").mapInArrow(cut, _SHARD)
    return stage(shards, "wavelet-shards", BATCH_ROWS, maxRecordsPerFile=1)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards' bytes."""
    schema = pa.schema([(c, pa.int64()) for c in ("part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32")])

    def read(batches):
        for batch in slices(batches, column="data"):
            for part, shard, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "data"))):
                got = Shard.from_bytes(data)
                raw = memoryview(got.matrix.ids().astype("<u4").tobytes())
                ends = np.cumsum(got.lengths, dtype=np.int64)
                starts = ends - got.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                owners = [None if x == _NULL_ID else x for x in got.doc_ids.tolist()]
                yield record_batch(schema, [[part] * n, [shard] * n, owners, starts, got.lengths.astype(np.int64), crcs])

    rows = shards.select("part", "shard", "data").mapInArrow(
        read, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    running = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each doc_id range, then the shards of a range
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("part", running(Window.orderBy("part")).alias("range_start"))
    inside = shards.select("part", "shard", F.col("n_tokens").alias("n"))
    inside = inside.select("part", "shard", running(Window.partitionBy("part").orderBy("shard")).alias("shard_start"))
    starts = inside.join(ranges, "part")
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("range_start") + F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op8_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))

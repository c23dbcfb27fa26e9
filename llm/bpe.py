"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each Spark partition.

Encoding: the pre-tokens of a slice become token-position rows (word, position, token). A recursive query joins
neighbouring tokens with the merge table, finds each word's minimum rank and contracts the leftmost pairs of that rank,
until no row of the word finds a merge. Decoding joins id-position rows with the vocabulary and aggregates the bytes in
position order. Only distinct words are encoded; the worker remembers them, up to a bound, and its tables are built
once per worker. Spark runs it as one narrow pass without a shuffle; lost executors cost only their own rows.

Null text counts as empty (no ids); repeated rows give repeated results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.chunks import ENCODE_BYTES, ChunkEncoder
from llm.common import documents, narrow, record_batch, slices

#: Distinct words, and ids, that one DuckDB query handles at most, beside a longer single text.
WORDS_AT_ONCE = 30_000
IDS_AT_ONCE = 500_000
MEMORY = "200MB"

# The merge table holds each split of a token into two tokens, under one key for the pair; the rank of a merge is the id
# that it makes. `alone`: the new token has a merge of a lower rank than its own, so later pairs of that rank must wait.
_TABLES = """
CREATE TABLE merges AS
WITH cuts AS (SELECT id, hex, unnest(range(1, length(hex) // 2)) AS c FROM vocab WHERE length(hex) > 2),
     found AS (SELECT a.id AS l, b.id AS r, c.id AS merged
               FROM cuts c JOIN vocab a ON a.hex = substr(c.hex, 1, 2 * c.c) JOIN vocab b ON b.hex = substr(c.hex, 2 * c.c + 1)),
     early AS (SELECT l AS tok FROM found WHERE merged < l UNION SELECT r FROM found WHERE merged < r)
SELECT l::BIGINT << 32 | r AS pair, merged, merged IN (SELECT tok FROM early) AS alone FROM found
"""

# A row is a token at place k: the word's number, shifted by 24 bits, plus the byte offset in the word. The next token
# of the word stands at k + len, and no other word reaches that place.
_ENCODE = """
WITH RECURSIVE parts AS (
    SELECT w::BIGINT << 24 AS k, v.id AS tok, length(hex) // 2 AS len, false AS live FROM words JOIN vocab v USING (hex)
    UNION ALL
    SELECT u.k, v.id, 1, true
    FROM (SELECT (w::BIGINT << 24) + c AS k, substr(hex, 2 * c + 1, 2) AS hex
          FROM (SELECT w, hex, unnest(range(length(hex) // 2)) AS c FROM words ANTI JOIN vocab USING (hex))) u
    JOIN vocab v USING (hex)
), steps AS (
    SELECT k, tok, len, live FROM parts
    UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT a.k, a.len, b.len AS next_len, m.merged, m.alone
        FROM steps a JOIN steps b ON b.k = a.k + a.len JOIN merges m ON m.pair = (a.tok::BIGINT << 32 | b.tok)
        WHERE a.live AND b.live
    ), low AS MATERIALIZED (
        SELECT k >> 24 AS w, min(merged) AS merged FROM pairs GROUP BY 1
    ), runs AS (
        SELECT p.*, row_number() OVER (PARTITION BY p.k >> 24 ORDER BY p.k) AS nth,
               lag(p.k + p.len) OVER (PARTITION BY p.k >> 24 ORDER BY p.k) IS NOT DISTINCT FROM p.k AS follows
        FROM pairs p JOIN low ON low.w = p.k >> 24 AND low.merged = p.merged
    ), numbered AS (
        SELECT *, nth - max(CASE WHEN NOT follows THEN nth END) OVER (PARTITION BY k >> 24 ORDER BY k) AS in_run FROM runs
    ), hits AS MATERIALIZED (
        SELECT k, k + len AS gone, merged, len + next_len AS len FROM numbered
        WHERE CASE WHEN alone THEN nth = 1 ELSE in_run % 2 = 0 END
    )
    SELECT s.k, coalesce(h.merged, s.tok), coalesce(h.len, s.len), low.w IS NOT NULL
    FROM (SELECT * FROM steps WHERE live) s LEFT JOIN low ON low.w = s.k >> 24
    LEFT JOIN hits h ON h.k = s.k ANTI JOIN hits g ON g.gone = s.k)
)
SELECT (k >> 24)::INTEGER AS w, tok FROM steps WHERE NOT live ORDER BY k
"""

_DECODE = """
SELECT d, coalesce(string_agg(hex, '' ORDER BY p), '') AS hex FROM ids JOIN vocab ON vocab.id = ids.tok GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class DuckBPE:
    """The vocabulary and merge table of one rank file in a DuckDB database of this worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [b.hex() for b in ranks]})
        self.db.register("given", vocab)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.db.unregister("given")
        self.db.execute(_TABLES)
        # the library's \s is White_Space, as in the regex module
        self.split = regex.compile(pattern).findall
        self.encoder = ChunkEncoder(self._units)

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, and how many each has: each pre-token is encoded apart."""
        split = [self.split(u) for u in units]
        words = dict.fromkeys(w for ws in split for w in ws)
        words = dict(zip(words, range(len(words))))
        parts, sizes = [], []
        distinct = list(words)
        for i in range(0, len(distinct), WORDS_AT_ONCE):
            ids, counts = self.encode_words(distinct[i : i + WORDS_AT_ONCE])
            parts.append(ids)
            sizes.append(counts)
        ids, sizes = np.concatenate(parts or [[]]), np.concatenate(sizes or [[]]).astype(np.int64)
        used = np.fromiter((words[w] for ws in split for w in ws), np.int64)
        per_unit = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.concatenate([[0], np.cumsum(sizes[used])])
        counts = np.diff(ends[np.concatenate([[0], np.cumsum(per_unit)])])
        return self.encoder._runs(ids, (np.cumsum(sizes) - sizes)[used], sizes[used]), counts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table = pa.table({"w": pa.array(range(len(words)), pa.int32()), "hex": [w.encode().hex() for w in words]})
        self.db.register("words", table)
        got = self.db.execute(_ENCODE).fetchnumpy()
        self.db.unregister("words")
        return got["tok"].astype(np.int32), np.bincount(got["w"], minlength=len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder(texts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids."""
        out = [b""] * len(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        first = done = 0
        ends = np.cumsum(counts)
        while first < len(counts):
            last = max(first + 1, int(np.searchsorted(ends, done + IDS_AT_ONCE, "right")))
            stop = int(ends[last - 1])
            self.db.register(
                "ids", pa.table({"d": owner[done:stop], "p": np.arange(done, stop), "tok": ids[done:stop]})
            )
            for d, text in self.db.execute(_DECODE).fetchall():
                out[d] = bytes.fromhex(text)
            self.db.unregister("ids")
            first, done = last, stop
        return out


_BUILT: dict = {}


def _codec(ranks: dict[bytes, int], pattern: str) -> DuckBPE:
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = DuckBPE(ranks, pattern)
    return _BUILT[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: what the tiktoken library gives with these ranks and this pattern."""
    ranks = read_ranks(ranks_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches):
        for batch in slices(batches, ENCODE_BYTES):
            ids, counts = _codec(ranks, pattern).encode(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists], schema=schema)

    return narrow(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, data binary: the bytes of each row's ids (null ids: no bytes)."""
    ranks = read_ranks(ranks_path)
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def decode(batches):
        for batch in batches:
            lists = batch.column("ids")
            counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            data = _codec(ranks, pattern).decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield record_batch(schema, [batch.column("doc_id").cast(pa.int64()), data])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes those ids, in one pass."""
    ranks = read_ranks(ranks_path)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        for batch in slices(batches, ENCODE_BYTES):
            codec = _codec(ranks, pattern)
            ids, counts = codec.encode(batch.column("text"))
            decoded = codec.decode(ids, counts)
            texts = list(map(str, ids.tolist()))
            ends = np.cumsum(counts).tolist()
            said = [" ".join(texts[e - n : e]) for e, n in zip(ends, counts.tolist())]
            yield record_batch(schema, [
                batch.column("doc_id").cast(pa.int64()), counts, [digest(s.encode()) for s in said], [digest(d) for d in decoded],
            ])

    return narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)

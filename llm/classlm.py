"""Brown class-based bigram model: exchange clustering, class transitions and word emissions, smoothed scores.

1. Every chunk of whole documents is stored as codes of its own vocabulary, so texts are tokenized once.
2. All words get numbers and their counts over all training documents. The HEAD most frequent ones start the clustering:
   their bigram table is built in Spark, and exchange rounds move each to the class that raises the likelihood of the
   class bigrams most; in a round only half of the words move, so that parallel moves don't undo each other.
3. Every chunk counts its distinct bigrams once. They are dealt out by word, for both words, and added up: the neighbours of
   each word, and its SLOTS (how often each class stands before and after it). Tokens are read again only for the scores.
4. Every other word starts in the class that its head neighbours speak for most, or without any by its frequency band.
5. Exchange rounds over all words, however many, go on until two of them gain less than SMALL_GAIN a token. The words that
   move send only what changes to the slots of their neighbours, so a round costs what its moves touch. A class without
   words is filled with half of a frequent one.
6. log10 P(w | v) = log10 (1 - u) P(c(w) | c(v)) P(w | c(w)) for words seen in training, log10 u for an unseen one: u is the
   share of words seen once among those that follow the class of v. Transitions are smoothed by the class frequencies.

A word's number holds the part (task) it is dealt to. The neighbours of a frequent word are cut into several rows and slots
are at most 2 * CLASSES + 4 a word, so no row grows with the corpus. The driver and closures hold HEAD words and
CLASSES x CLASSES counts, whatever the size of the corpus.

Null text: empty (one end token). Null doc_id: scored, and used for training as if its text form were empty. Repeated
rows count repeatedly; an empty table gives no rows; a corpus without training documents scores every word as unseen
by equal shares; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import BATCH_ROWS, documents, narrow, partitions, record_batch, slices, stage, unstage

#: Fixed values of the contract: documents held out, and the base's addition to counts.
FOLDS, HELD_FOLD, BASE_ADD = 5, 1, 0.5
CHUNK_BYTES = 8 << 20
#: Words that start the clustering, word classes, rounds over these; class 0 is the end of a text.
HEAD, CLASSES, ROUNDS = 2048, 64, 8
#: Rounds over all words end when two of them raise the log likelihood by less than this a token.
SMALL_GAIN = 0.005
#: Weight, in tokens, of the class frequencies in a transition, and of the overall share of unseen words.
PRIOR, UNSEEN_PRIOR = 20.0, 200.0
#: A word's number: its part above this bit, its place there (from 1) below; 0: the end of a text.
PART_BIT = 40
#: Words numbered, and neighbours merged, at once; words whose gains are computed at once; moves broadcast up to so many bytes.
WORDS_AT_ONCE, NEIGHBOURS_AT_ONCE, GAINS_AT_ONCE, MOVES_BYTES = 200_000, 1_000_000, 1024, 16 << 20
#: Counts whose gains are looked up; words that a class must have to be halved.
FEW, HALVED_WORDS = 64, 32

_CHUNK = """chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, words array<string>,
 counts array<long>, codes binary"""
_CHUNK_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
    ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary()),
])


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_FOLD


def coded_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of whole documents: word 0 is the end of a text, then the distinct words; codes in document order."""

    def emit(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in _merged(batches):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
            flat = lists.flatten().dictionary_encode()
            empty = pc.index(flat.dictionary, "").as_py()
            codes = flat.indices.to_numpy().astype(np.int64) + 1 if len(flat) else np.empty(0, np.int64)
            words = flat.dictionary.to_pylist() if len(flat) else []
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            if empty >= 0:  # white space at the ends of a text
                real = codes != empty + 1
                codes, owner = codes[real], owner[real]
                codes -= codes > empty + 1
                words.pop(empty)
            sizes = np.bincount(owner, minlength=len(lists)) + 1
            ends = np.cumsum(sizes)
            whole = np.zeros(int(ends[-1]), np.uint32)
            inner = np.ones(len(whole), bool)
            inner[ends - 1] = False
            whole[inner] = codes
            ids = batch.column("doc_id").to_pylist()
            held = np.array([is_held_out(i) for i in ids])
            counts = np.bincount(whole[np.repeat(~held, sizes)], minlength=len(words) + 1)
            packed = zstandard.ZstdCompressor(level=1).compress(whole.astype("<u4").tobytes())
            yield record_batch(_CHUNK_SCHEMA, [
                [(task << 32) + number], [ids], [held], [sizes.astype(np.int32)], [["", *words]], [counts], [packed],
            ])
            number += 1

    return stage(narrow(docs).mapInArrow(emit, _CHUNK), "lm-chunks", BATCH_ROWS)


def _merged(batches):
    """The batches (doc_id, text) put together to about CHUNK_BYTES of text."""
    held, size = [], 0
    for batch in slices(batches, CHUNK_BYTES):
        n = batch.column("text").nbytes
        if held and size + n > CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pack(values, kind: str = "<i8", rising: bool = False) -> bytes:
    """Compressed planes of bytes; rising: of the differences."""
    values = np.ascontiguousarray(values, kind)
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind: str = "<i8", rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    values = planes.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()
    return np.cumsum(values) if rising else values


class _Chunk:
    """One row of coded_chunks."""

    def __init__(self, sizes, held, codes: bytes):
        self.sizes, self.held = np.asarray(sizes, np.int64), np.asarray(held, bool)
        self.codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(codes), "<u4").astype(np.int64)
        self.first = np.zeros(len(self.codes), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.train = np.repeat(~self.held, self.sizes)

    def before(self, values: np.ndarray) -> np.ndarray:
        """For each token the value of the one before; before the first stands an end (code 0)."""
        out = np.concatenate([[0], values[:-1]])
        out[self.first] = 0
        return out


def _rows(batches, columns=("sizes", "held", "codes")):
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield one, _Chunk(*(one.column(c)[0].as_py() if c == "codes" else one.column(c)[0].values.to_numpy(zero_copy_only=False) for c in columns))


def numbered_words(chunks: DataFrame, head: int, parts: int) -> DataFrame:
    """(chunk, places, ids, counts), packed: numbers (0: the end) and training counts over all chunks of words at places of
    a chunk. Rows of chunk -1 hold the `head` most frequent training words of those numbered together."""
    schema = pa.schema([("word", pa.string()), ("chunk", pa.int64()), ("place", pa.int32()), ("n", pa.int64())])
    out = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])

    def emit(batches):
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c) for c in ("chunk", "words", "counts"))):
                n = len(words.values)
                yield pa.RecordBatch.from_arrays(
                    [words.values, pa.array(np.full(n, chunk.as_py())), pa.array(np.arange(n, dtype=np.int32)), counts.values],
                    schema=schema,
                )

    def number(batches):
        first = (TaskContext.get().partitionId() << PART_BIT) + 1

        def numbered(rows: pa.Table):
            coded = rows.column("word").combine_chunks().dictionary_encode()
            group = coded.indices.to_numpy().astype(np.int64)
            end = pc.equal(rows.column("word"), "").to_numpy()
            total = np.bincount(group, rows.column("n").to_numpy()).astype(np.int64)
            ids = np.where(end, 0, first + group)
            own = first + np.arange(len(total))
            own, seen = (x[(total > 0) & (coded.dictionary.to_numpy(zero_copy_only=False) != "")] for x in (own, total))
            top = np.argsort(-seen, kind="stable")[:head]
            found = [(-1, _pack([]), _pack(own[top]), _pack(seen[top]))]
            chunk, place = rows.column("chunk").to_numpy(), rows.column("place").to_numpy()
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0)).tolist()
            for a, b in zip(edges, [*edges[1:], len(order)]):
                at = order[a:b]
                found.append((int(chunk[at[0]]), _pack(place[at]), _pack(ids[at]), _pack(total[group[at]])))
            return len(total), record_batch(out, list(zip(*found)))

        held, size, limit = [], 0, WORDS_AT_ONCE
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                table = pa.Table.from_batches(held).combine_chunks()
                words = table.column("word")
                stop = pc.index(words, words[-1]).as_py()  # the last word may go on in the next batch
                if stop:
                    n, found = numbered(table.slice(0, stop))
                    first += n
                    yield found
                held, size = table.slice(stop).to_batches(), table.num_rows - stop
                limit = max(WORDS_AT_ONCE, 2 * size)
        if size:
            yield numbered(pa.Table.from_batches(held).combine_chunks())[1]

    each = chunks.select("chunk", "words", "counts").mapInArrow(emit, "word string, chunk long, place int, n long")
    dealt = each.repartition(parts, "word").sortWithinPartitions("word")
    return stage(dealt.mapInArrow(number, "chunk long, places binary, ids binary, counts binary"), "lm-words")


def numbered_chunks(chunks: DataFrame, numbered: DataFrame) -> DataFrame:
    """The chunks with numbers and counts of their words instead of these, in the order of the numbers."""
    known = numbered.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("places", "ids", "counts")).alias("known"))
    kept = ["chunk", "doc_ids", "held", "sizes"]
    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in kept)

    def emit(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows = one.column("known")[0].as_py()
                places, ids, counts = (np.concatenate([_unpack(r[c]) for r in rows]) for c in ("places", "ids", "counts"))
                order = np.argsort(ids)
                rank = np.empty(len(ids), "<u4")
                rank[places[order]] = np.arange(len(ids))
                raw = zstandard.ZstdDecompressor().decompress(one.column("codes")[0].as_py())
                codes = zstandard.ZstdCompressor(level=1).compress(rank[np.frombuffer(raw, "<u4")].tobytes())
                lists = [pa.array([x[order]], pa.list_(pa.int64())) for x in (ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c) for c in kept), pa.array([codes], pa.binary()), *lists], names=[*kept, "codes", "ids", "counts"]
                )

    both = chunks.join(known, "chunk").select(*kept, "codes", "known")
    return stage(both.mapInArrow(emit, schema + ", codes binary, ids array<bigint>, counts array<bigint>"), "lm-coded", 8)


def _numbers_of(ids: np.ndarray, head: np.ndarray, rest: int) -> np.ndarray:
    """The head number of each word number: 0 for the end, 1... for head words, `rest` for all others."""
    order = np.argsort(head)
    at = np.minimum(np.searchsorted(head[order], ids), max(len(head) - 1, 0))
    found = np.where(head[order][at] == ids, order[at] + 1, rest) if len(head) else np.full(len(ids), rest)
    return np.where(ids == 0, 0, found)


def head_bigrams(coded: DataFrame, head: np.ndarray) -> DataFrame:
    """(a, b, n): training bigrams of head numbers. head: the word numbers, the most frequent first."""
    rest = len(head) + 1
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def emit(batches):
        for row, chunk in _rows(batches):
            own = _numbers_of(row.column("ids")[0].values.to_numpy(), head, rest)[chunk.codes]
            keys = (chunk.before(own) * (rest + 1) + own)[chunk.train]
            keys, n = np.unique(keys, return_counts=True)
            yield record_batch(schema, [(keys // (rest + 1)).astype(np.int32), (keys % (rest + 1)).astype(np.int32), n])

    some = coded.select("ids", "sizes", "held", "codes").mapInArrow(emit, "a int, b int, n long")
    return stage(some.groupBy("a", "b").agg(F.sum("n").alias("n")), "lm-bigrams")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(left: np.ndarray, right: np.ndarray, own: float, now: int, table: np.ndarray, movable) -> int:
    """The class of `movable` where a word raises the class-bigram likelihood most. left, right: how often each class
    stands before and after it, without itself; own: how often it follows itself; table: class bigrams, the word in
    class `now`."""
    m = table.astype(float).copy()
    m[:, now] -= left
    m[now, :] -= right
    m[now, now] -= own
    m = np.maximum(m, 0)
    # a class keeps its bigrams with the word wherever that goes
    rows, columns = m.sum(axis=1) + left, m.sum(axis=0) + right
    # the word's own class stands on the diagonal, where both sides and the word itself meet
    gain = (_f(m + left[:, None]) - _f(m)).sum(axis=0) + (_f(m + right[None, :]) - _f(m)).sum(axis=1)
    d = np.diag(m)
    gain += _f(d + left + right + own) - _f(d + left) - _f(d + right) + _f(d)
    gain -= _f(rows + right.sum() + own) - _f(rows) + _f(columns + left.sum() + own) - _f(columns)
    choice = np.array(movable)
    return int(choice[np.argmax(gain[choice])]) if gain[choice].max() > gain[now] + 1e-9 else now


class Gains:
    """What counts up to FEW add to f of the class bigrams and of their sums, looked up for many words."""

    def __init__(self, table: np.ndarray):
        n = np.arange(FEW + 1)
        self.table = table.astype(float)
        self.cells = [_f(m[:, None, :] + n[None, :, None]) - _f(m)[:, None, :] for m in (self.table, self.table.T)]
        self.totals = [self.table.sum(axis=1), self.table.sum(axis=0)]
        self.sums = [_f(s[None, :] + n[:, None]) - _f(s)[None, :] for s in self.totals]

    def beside(self, side: int, beside: np.ndarray, other: np.ndarray, own: np.ndarray, now: np.ndarray) -> np.ndarray:
        """What the neighbours on one side add, by word and class it may go to."""
        m = (self.table, self.table.T)[side]
        gain = np.zeros(beside.shape)
        word, slot = np.nonzero(beside)
        n, at = beside[word, slot], now[word]
        few = (n <= FEW) & (slot != at)
        for chosen in (np.flatnonzero(few), np.flatnonzero(~few)):
            if not len(chosen):
                continue
            w, s, k, c = word[chosen], slot[chosen], n[chosen], at[chosen]
            row = np.arange(len(chosen))
            if few[chosen[0]]:
                added = self.cells[side][s, k.astype(np.int64)]
                added[row, c] = _f(m[s, c]) - _f(np.maximum(m[s, c] - k, 0))
            else:
                base = m[s]
                base[row, c] -= k
                same = s == c
                base[same] -= other[w[same]]
                base[row[same], c[same]] -= own[w[same]]
                base = np.maximum(base, 0)
                added = _f(base + k[:, None]) - _f(base)
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[starts]] += np.add.reduceat(added, starts)
        return gain

    def total(self, axis: int, mine: np.ndarray, now: np.ndarray) -> np.ndarray:
        """What a word's count adds to the sum of the class it goes to."""
        sums, row = self.totals[axis], np.arange(len(mine))
        few = mine <= FEW
        gain = self.sums[axis][np.where(few, mine, 0).astype(np.int64)]
        many = np.flatnonzero(~few)
        gain[many] = _f(sums + mine[many, None]) - _f(sums)
        gain[row, now] = _f(sums[now]) - _f(np.maximum(sums[now] - mine, 0))
        return gain


def best_classes(left, right, own, now: np.ndarray, table: np.ndarray, gains: Gains | None = None, end: int | None = None) -> np.ndarray:
    """best_class of many words at once, among the classes 1... (before `end`) that have words (all words that move at the
    same time would take the same empty one): a row of left and right for each word."""
    gains = gains or Gains(table)
    row = np.arange(len(left))
    gain = gains.beside(0, left, right, own, now) + gains.beside(1, right, left, own, now)
    # only where two of the three meet do the diagonal's parts differ from their sum
    word, c = np.nonzero(((left > 0) & (right > 0)) | (own > 0)[:, None])
    x, y, z = left[word, c], right[word, c], own[word]
    d = np.diag(gains.table)[c]
    d = np.maximum(np.where(c == now[word], d - x - y - z, d), 0)
    gain[word, c] += _f(d + x + y + z) - _f(d + x) - _f(d + y) + _f(d)
    gain -= gains.total(0, right.sum(axis=1) + own, now) + gains.total(1, left.sum(axis=1) + own, now)
    gain[:, gains.totals[1] == 0] = -np.inf
    best = 1 + gain[:, 1:end].argmax(axis=1)
    return np.where(gain[row, best] > gain[row, now] + 1e-9, best, now)


def exchange(bigrams: DataFrame, n_head: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each head number (0: the end; classes + 1: the rest) and the class bigrams under them."""
    rest, width = n_head + 1, classes + 2
    slots = 2 * width + 1
    of = np.array([0, *(1 + i % classes for i in range(n_head)), classes + 1], np.int64)
    schema = pa.schema([("h", pa.int64()), ("slot", pa.int64()), ("n", pa.int64())])

    def contexts(of):
        """How often each class stands before, after and in the place of a head number: at most (n_head + 2) * slots counts."""

        def count(batches):
            total = np.zeros((n_head + 2) * slots, np.int64)
            for batch in batches:
                a, b, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
                same = a == b
                keys = np.concatenate([b * slots + np.where(same, 2 * width, of[a]), (a * slots + width + of[b])[~same]])
                total += np.bincount(keys, np.concatenate([n, n[~same]]), minlength=len(total)).astype(np.int64)
            at = np.flatnonzero(total)
            yield record_batch(schema, [at // slots, at % slots, total[at]])

        each = bigrams.select("a", "b", "n").mapInArrow(count, "h long, slot long, n long")
        found = each.groupBy("h", "slot").agg(F.sum("n").alias("n")).toArrow()
        beside = np.zeros((n_head + 2, slots))
        beside[found.column("h").to_numpy(), found.column("slot").to_numpy()] = found.column("n").to_numpy()
        table = np.zeros((width, width))
        np.add.at(table, of, beside[:, width : 2 * width])
        np.add.at(table, (of, of), beside[:, -1])
        return beside, table

    words = np.arange(1, rest)
    for step in range(rounds):
        beside, table = contexts(of)
        half = words[[zlib.crc32(f"{h} {step // 2}".encode()) % 2 == step % 2 for h in words]]
        if len(half):
            of = of.copy()
            left, right = beside[half, :width], beside[half, width : 2 * width]
            # the rest of the words is no class that a head word may join
            of[half] = best_classes(left, right, beside[half, -1], of[half], table, None, classes + 1)
    return of, contexts(of)[1]


#: Rows that are dealt out by part, and what at, nb and n hold: neighbours that follow (0) or precede (1) a word (place of
#: the word, number of the neighbour, count), counts of slots (key, -, count), a part's state (keys, class by place,
#: counts), moves (place, new class, old class; -1: none before) and the words of a chunk (place).
FOLLOWS, PRECEDES, COUNTS, STATE, MOVES, WANTED = range(6)
_ROWS = "part long, kind int, chunk long, at binary, nb binary, n binary"
_ROWS_SCHEMA = pa.schema([
    ("part", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("nb", pa.binary()), ("n", pa.binary()),
])
_NONE = _pack([])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and the sums of n that are not 0."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.add.reduceat(n[order], starts)
    return keys[starts][sums != 0], sums[sums != 0]


def _dealt(keys: np.ndarray, n: np.ndarray, slots: int) -> list:
    """Rows of COUNTS by part; keys, rising: word number * slots + slot."""
    part = keys // slots >> PART_BIT
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    return [
        (int(part[a]), COUNTS, -1, _pack(keys[a:b] - (part[a] << PART_BIT) * slots, rising=True), _NONE, _pack(n[a:b]))
        for a, b in zip(edges, [*edges[1:], len(part)])
    ]


def _by_part(batches):
    """The rows of one part after another, as a generator each; batches are sorted by part."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield {c: batch.column(c)[i].as_py() for c in ("part", "kind", "chunk", "at", "nb", "n")}

    for _, group in itertools.groupby(rows(), lambda r: r["part"]):
        yield group


def _by_rows(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part", "kind")


def neighbours(coded: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows FOLLOWS and PRECEDES of all training words, and rows COUNTS of what no move changes: ends of texts beside a
    word, a word after itself, and its tokens."""
    slots = 2 * width + 2

    def emit(batches):
        for row, chunk in _rows(batches, ("sizes", "held", "codes")):
            ids = row.column("ids")[0].values.to_numpy()
            size = len(ids)
            keys, n = np.unique((chunk.before(chunk.codes) * size + chunk.codes)[chunk.train], return_counts=True)
            left, right = keys // size, keys % size
            between = (left > 0) & (right > 0) & (left != right)
            found = []
            for kind in (FOLLOWS, PRECEDES):
                word, other, k = left[between], right[between], n[between]
                if kind == PRECEDES:
                    order = np.argsort(right[between], kind="stable")
                    word, other, k = right[between][order], left[between][order], k[order]
                part = ids[word] >> PART_BIT
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
                for a, b in zip(edges, [*edges[1:], len(part)]):
                    place = ids[word[a:b]] - (part[a] << PART_BIT)
                    found.append((int(part[a]), kind, -1, _pack(place, rising=True), _pack(ids[other[a:b]], rising=True), _pack(k[a:b])))
            tokens = np.bincount(chunk.codes[chunk.train], minlength=size)
            tokens[0] = 0
            fixed = []
            for word, slot, chosen in ((right, 0, (left == 0) & (right > 0)), (left, width, (right == 0) & (left > 0)),
                                       (left, 2 * width, (left == right) & (left > 0))):
                fixed.append((ids[word[chosen]] * slots + slot, n[chosen]))
            fixed.append((ids[tokens > 0] * slots + 2 * width + 1, tokens[tokens > 0]))
            found += _dealt(*_summed(*(np.concatenate(x) for x in zip(*fixed))), slots)
            if found:
                yield record_batch(_ROWS_SCHEMA, list(zip(*found)))

    def merge(batches):
        def merged(part: int, kind: int, rows: list):
            at, nb, n = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((nb, at))
            at, nb = at[order], nb[order]
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (nb[1:] != nb[:-1])))
            return (part, kind, -1, _pack(at[starts], rising=True), _pack(nb[starts], rising=True), _pack(np.add.reduceat(n[order], starts)))

        for group in _by_part(batches):
            for kind, rows in itertools.groupby(group, lambda r: r["kind"]):
                held, size, limit, part = [], 0, NEIGHBOURS_AT_ONCE, 0
                for r in rows:
                    part, at, n = r["part"], _unpack(r["at"], rising=True), _unpack(r["n"])
                    held.append((at, n) if kind == COUNTS else (at, _unpack(r["nb"], rising=True), n))
                    size += len(n)
                    if size >= limit:
                        if kind == COUNTS:  # at most `slots` keys a word
                            held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                            size = len(held[0][0])
                            limit = max(NEIGHBOURS_AT_ONCE, 2 * size)
                        else:
                            yield record_batch(_ROWS_SCHEMA, list(zip(merged(part, kind, held))))
                            held, size = [], 0
                if held and kind == COUNTS:
                    keys, n = _summed(*(np.concatenate(x) for x in zip(*held)))
                    yield record_batch(_ROWS_SCHEMA, list(zip((part, kind, -1, _pack(keys, rising=True), _NONE, _pack(n)))))
                elif held:
                    yield record_batch(_ROWS_SCHEMA, list(zip(merged(part, kind, held))))

    each = coded.select("ids", "sizes", "held", "codes").mapInArrow(emit, _ROWS)
    return stage(_by_rows(each, parts).mapInArrow(merge, _ROWS), "lm-neighbours", 8)


def changed_counts(beside: DataFrame, moves: DataFrame, width: int) -> DataFrame:
    """Rows COUNTS of what the moves change in the slots of the neighbours."""
    slots = 2 * width + 2
    size = moves.agg(F.sum(F.length("at") + F.length("nb") + F.length("n")).alias("s")).first()["s"] or 0
    small = moves.select("part", F.col("at").alias("place"), F.col("nb").alias("new"), F.col("n").alias("old"))
    both = beside.where(F.col("kind") <= PRECEDES).join(F.broadcast(small) if size <= MOVES_BYTES else small, "part")

    def emit(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                kind, at, nb, n, place, new, old = (batch.column(c)[i].as_py() for c in ("kind", "at", "nb", "n", "place", "new", "old"))
                at, place = _unpack(at, rising=True), _unpack(place, rising=True)
                to = np.full(max(int(at[-1]), int(place[-1])) + 1, -1)
                to[place] = _unpack(new)
                sel = np.flatnonzero(to[at] >= 0)
                if not len(sel):
                    continue
                past = np.full(len(to), -1)
                past[place] = _unpack(old)
                at, n = at[sel], _unpack(n)[sel]
                # a word stands before those that follow it: in their left slots
                base = _unpack(nb, rising=True)[sel] * slots + (0 if kind == FOLLOWS else width)
                gone = past[at] >= 0
                keys += [base + to[at], base[gone] + past[at][gone]]
                counts += [n, -n[gone]]
                held += 2 * len(sel)
                if held >= 2 * NEIGHBOURS_AT_ONCE:
                    found = _dealt(*_summed(np.concatenate(keys), np.concatenate(counts)), slots)
                    if found:
                        yield record_batch(_ROWS_SCHEMA, list(zip(*found)))
                    keys, counts, held = [], [], 0
        if held:
            found = _dealt(*_summed(np.concatenate(keys), np.concatenate(counts)), slots)
            if found:
                yield record_batch(_ROWS_SCHEMA, list(zip(*found)))

    return both.select("kind", "at", "nb", "n", "place", "new", "old").mapInArrow(emit, _ROWS)


def state_after(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """One row STATE for each part from its rows STATE, MOVES and COUNTS. sums: class bigrams of its words (all but those of
    an end after a start), how many words seen once follow each class, and words by class."""
    slots = 2 * width + 2
    schema = _ROWS_SCHEMA.append(pa.field("sums", pa.list_(pa.int64())))

    def merge(batches):
        for group in _by_part(batches):
            held, size, limit, classes, moves = [], 0, NEIGHBOURS_AT_ONCE, np.empty(0, np.int64), []
            for r in group:
                part, at = r["part"], _unpack(r["at"], rising=True)
                if r["kind"] == MOVES:
                    moves.append((at, _unpack(r["nb"])))
                    continue
                if r["kind"] == STATE:
                    classes = _unpack(r["nb"])
                held.append((at, _unpack(r["n"])))
                size += len(at)
                if size >= limit:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    limit = max(NEIGHBOURS_AT_ONCE, 2 * size)
            keys, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            word, slot = keys // slots, keys % slots
            now = np.full(int(word[-1]) + 1, -1)
            now[: len(classes)] = classes
            for at, new in moves:
                now[at] = new
            cls = now[word]
            sums = np.zeros(width * width + 2 * width, np.int64)
            given = cls >= 0
            for chosen, cell in (
                (slot == 0, cls), ((slot >= width) & (slot < 2 * width), cls * width + slot - width), (slot == 2 * width, cls * width + cls),
            ):
                np.add.at(sums, cell[chosen & given], n[chosen & given])
            once = np.zeros(len(now), bool)
            once[word[(slot == 2 * width + 1) & (n == 1)]] = True
            np.add.at(sums, width * width + slot[(slot < width) & once[word]], 1)
            np.add.at(sums, width * width + width + now[now >= 0], 1)
            yield record_batch(schema, [[part], [STATE], [-1], [_pack(keys, rising=True)], [_pack(now)], [_pack(n)], [sums]])

    return stage(_by_rows(rows, parts).mapInArrow(merge, _ROWS + ", sums array<bigint>"), "lm-state", 16)


def chosen_moves(state: DataFrame, width: int, choose) -> DataFrame:
    """Rows MOVES. choose(numbers, tokens, classes, left, right, own): the new classes of some words."""
    slots = 2 * width + 2

    def emit(batches):
        for batch in batches:
            for part, at, nb, n in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "nb", "n"))):
                keys, now, n = _unpack(at, rising=True), _unpack(nb), _unpack(n)
                places = np.unique(keys // slots)
                new = now.copy()
                for a in range(0, len(places), GAINS_AT_ONCE):
                    some = places[a : a + GAINS_AT_ONCE]
                    lo, hi = np.searchsorted(keys, (some[0] * slots, (some[-1] + 1) * slots))
                    row = np.searchsorted(some, keys[lo:hi] // slots)
                    dense = np.bincount(row * slots + keys[lo:hi] % slots, n[lo:hi], minlength=len(some) * slots).reshape(-1, slots)
                    left, right = dense[:, :width], dense[:, width : 2 * width]
                    new[some] = choose((part << PART_BIT) + some, dense[:, -1].astype(np.int64), now[some], left, right, dense[:, -2])
                moved = np.flatnonzero(new != now)
                if len(moved):
                    yield record_batch(_ROWS_SCHEMA, list(zip((part, MOVES, -1, _pack(moved, rising=True), _pack(new[moved]), _pack(now[moved])))))

    return stage(state.select("part", "at", "nb", "n").mapInArrow(emit, _ROWS), "lm-moves", 16)


def first_classes(table: np.ndarray):
    """choose: the classes of words without one, from the classes beside them. table: class bigrams of the head."""
    inner = table + 0.5  # pointwise mutual information with the smoothed class bigrams
    info = np.log(inner * inner.sum() / (inner.sum(axis=1, keepdims=True) * inner.sum(axis=0, keepdims=True)))

    def choose(ids, tokens, now, left, right, own):
        score = left @ info[:, 1:] + right @ info[1:].T
        band = 1 + np.log2(np.maximum(tokens, 1)).astype(np.int64) % (len(table) - 1)
        found = np.where(left.any(axis=1) | right.any(axis=1), 1 + score.argmax(axis=1), band)
        return np.where(now >= 0, now, found)

    return choose


def exchanged(table: np.ndarray, words: np.ndarray, step: int):
    """choose: the best classes of half of the words. words: how many each class has."""
    often = [int(c) for c in np.argsort(-table.sum(axis=1), kind="stable") if c and words[c] >= HALVED_WORDS]
    # classes without words get the moving half of the most frequent ones, as far as it would stay
    filled = np.arange(len(table))
    for empty, c in zip([c for c in range(1, len(table)) if not words[c]], often):
        filled[c] = empty
    held = {}

    def choose(ids, tokens, now, left, right, own):
        if not held:
            held["gains"] = Gains(table)
        half = ((ids.astype(np.uint64) + np.uint64(step // 2)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(int) % 2
        out, at = now.copy(), np.flatnonzero(half == step % 2)
        if len(at):
            best = best_classes(left[at], right[at], own[at], now[at], table, held["gains"])
            out[at] = np.where(best == now[at], filled[best], best)
        return out

    return choose


def likelihood(table: np.ndarray) -> float:
    """The part of the training log likelihood that depends on the classes."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


def _totals(state: DataFrame, width: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class bigrams, words seen once after each class and words of each class; width * (width + 2) rows reach the driver."""
    sums = np.zeros(width * width + 2 * width)
    for r in state.select(F.posexplode("sums").alias("i", "n")).where("n <> 0").groupBy("i").agg(F.sum("n").alias("n")).collect():
        sums[r["i"]] = r["n"]
    table = sums[: width * width].reshape(width, width)
    table[0, 0] = texts - table[1:, 0].sum()
    return table, sums[width * width : -width], sums[-width:]


def settled(beside: DataFrame, head: np.ndarray, of: np.ndarray, table: np.ndarray, texts: int, parts: int) -> tuple:
    """(state, class bigrams, words seen once after each class, words of each class) of exchange rounds over all words until
    two rounds gain less than SMALL_GAIN a token. of, table: of `exchange` over the head; texts: training documents."""
    width = len(table) - 1
    spark = beside.sparkSession
    fixed = beside.where(F.col("kind") == COUNTS)
    rows = []
    for part in np.unique(head >> PART_BIT).tolist():  # at most HEAD rows
        mine = np.flatnonzero(head >> PART_BIT == part)
        mine = mine[np.argsort(head[mine])]
        place = head[mine] - (part << PART_BIT)
        rows.append((part, MOVES, -1, _pack(place, rising=True), _pack(of[1 + mine]), _pack(np.full(len(mine), -1))))
    moves = spark.createDataFrame(rows, _ROWS)
    first = state_after(fixed.union(moves).union(changed_counts(beside, moves, width)), width, parts)

    def moved(state, moves):
        kept = state.select(*_ROWS_SCHEMA.names)
        return state_after(kept.union(moves).union(changed_counts(beside, moves, width)), width, parts)

    moves = chosen_moves(first, width, first_classes(table[:-1, :-1]))
    best = moved(first, moves)
    unstage(first, moves)
    counts = _totals(best, width, texts)
    reached, step = [likelihood(counts[0])], 0
    while True:
        moves = chosen_moves(best, width, exchanged(counts[0], counts[2], step))
        after = moved(best, moves)
        counted = _totals(after, width, texts)
        value, step = likelihood(counted[0]), step + 1
        better = value > reached[-1]
        unstage(moves, best if better else after)
        if better:
            best, counts = after, counted
        reached.append(max(value, reached[-1]))
        if step > 1 and reached[-1] - reached[-3] <= SMALL_GAIN * counts[0].sum():
            return best, *counts


def with_classes(coded: DataFrame, state: DataFrame, parts: int) -> DataFrame:
    """coded with the class of each of its words (-1: not in training)."""
    out = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("classes", pa.binary())])

    def ask(batches):
        for batch in batches:
            for chunk, ids in zip(batch.column("chunk").to_pylist(), batch.column("ids")):
                ids = ids.values.to_numpy()
                part = ids >> PART_BIT
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
                rows = [
                    (int(part[a]), WANTED, chunk, _pack(ids[a:b] - (part[a] << PART_BIT), rising=True), _NONE, _NONE)
                    for a, b in zip(edges, [*edges[1:], len(ids)])
                ]
                yield record_batch(_ROWS_SCHEMA, list(zip(*rows)))

    def answer(batches):
        for group in _by_part(batches):
            now = np.full(1, -1)
            for r in group:
                if r["kind"] == STATE:
                    now = np.append(_unpack(r["nb"]), -1)
                else:
                    place = _unpack(r["at"], rising=True)
                    found = now[np.minimum(place, len(now) - 1)]
                    if r["part"] == 0 and place[0] == 0:
                        found[0] = 0  # the end of a text
                    yield record_batch(out, [[r["chunk"]], [r["part"]], [_pack(found)]])

    asked = coded.select("chunk", "ids").mapInArrow(ask, _ROWS).union(state.select(*_ROWS_SCHEMA.names))
    dealt = _by_rows(asked, parts).mapInArrow(answer, "chunk long, part long, classes binary")
    lists = dealt.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "classes"))).alias("dealt"))
    return coded.join(lists, "chunk").select("doc_ids", "held", "sizes", "codes", "counts", F.col("dealt.classes").alias("classes"))


def _unpacked(batches):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for ids, n in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist()):
            yield record_batch(schema, [_unpack(ids), _unpack(n)])


_SCORE = """doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double,
 score double"""


def score_documents(docs: DataFrame, head: int = HEAD, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Trains on the documents that are not held out and scores all."""
    chunks = coded_chunks(docs)
    parts = partitions(chunks)
    tokens = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    total = chunks.agg(F.sum(F.get("counts", F.lit(0))).alias("texts"), F.sum(tokens).alias("tokens")).first()
    texts, n_tokens = int(total["texts"] or 0), int(total["tokens"] or 0)
    numbered = numbered_words(chunks, head, parts)
    tops = numbered.where("chunk < 0").mapInArrow(_unpacked, "id long, n long")
    often = tops.orderBy(F.desc("n"), "id").limit(head).collect()
    frequent = np.array([r["id"] for r in often], np.int64)
    coded = numbered_chunks(chunks, numbered)
    unstage(chunks, numbered)
    of, table = exchange(head_bigrams(coded, frequent), len(frequent), classes, rounds)
    beside = neighbours(coded, classes + 1, parts)
    state, table, rare, words = settled(beside, frequent, of, table, texts, parts)
    unstage(beside)
    coded, n_types = with_classes(coded, state, parts), int(words.sum()) + (texts > 0)
    n, types = float(n_tokens), n_types
    frequency = table.sum(axis=0)
    share = frequency / max(n, 1.0)
    after = table.sum(axis=1)
    move = (table + PRIOR * share) / (after[:, None] + PRIOR)
    overall = (rare.sum() + 0.5) / (n + 1.0)
    unseen = np.minimum((rare + UNSEEN_PRIOR * overall) / (after + UNSEEN_PRIOR), 0.5)
    # the class before may be that of an unseen word (-1): then only the frequencies speak
    move, unseen = np.vstack([move, share]), np.append(unseen, overall)
    with np.errstate(divide="ignore"):
        log_move = np.log10(np.maximum(move, 1e-300)) + np.log10(1 - unseen)[:, None] - np.log10(np.maximum(frequency, 1e-300))
    log_unseen = np.log10(unseen)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")),
        ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def score(batches):
        base_under = math.log10(n + BASE_ADD * (types + 1))
        for row, chunk in _rows(batches):
            of = np.concatenate([_unpack(x) for x in row.column("classes")[0].as_py()])
            counts = row.column("counts")[0].values.to_numpy()
            log_count = np.log10(np.maximum(counts, 1))
            cls, known = of[chunk.codes], counts[chunk.codes] > 0
            before = chunk.before(cls)
            said = np.where(known, log_move[before, np.maximum(cls, 0)] + log_count[chunk.codes], log_unseen[before])
            base = (np.log10(counts + BASE_ADD) - base_under)[chunk.codes]
            first = np.cumsum(chunk.sizes) - chunk.sizes
            sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), base, said)]
            yield record_batch(schema, [
                row.column("doc_ids")[0].values, chunk.held, chunk.sizes, sums[0], np.full(len(first), n_tokens), sums[1], sums[2],
            ])

    return coded.mapInArrow(score, _SCORE)


def op4_brown_class_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))

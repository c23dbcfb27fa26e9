"""Best-fit packing of token pieces into fixed sequences by linear grouping.

Large pieces, sorted by length, are cut into groups of equal cardinality and rounded up to the longest of their group.
With so few sizes, configurations of a sequence are chosen one by one (the fullest that holds the largest size left, by
a subset-sum over the sizes) and each is used as often as the counts allow. The actual pieces then take the places of
their group's size, and the small pieces go, longest first, into the sequence where least room is left.

All of that needs only how many pieces there are of each length: at most `capacity` numbers reach the driver, however
many documents there are, and its plan is made of runs of sequences with equal lengths inside. Spark tokenizes, counts,
ranks the pieces of a length (in pieces of one partition, so that a very common length is no hot task) and looks every
rank up in the plan.

Null text: empty, so its piece is the end id alone. Repeated rows are packed repeatedly; a null doc_id stays null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.chunks import ENCODE_BYTES, REMEMBERED, tokenizer_encoder
from llm.common import BATCH_ROWS, documents, narrow, ranked, record_batch, slices, stage

#: Fixed values of the contract.
CAPACITY, END_ID = 4096, 1
#: Pieces longer than this share of a sequence are large; so many groups of them.
LARGE_SHARE, GROUPS = 1 / 3, 24

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, remembered: int = REMEMBERED
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and its end id, cut only where longer. remembered:
    distinct units that a worker holds while it tokenizes."""
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "crc"))])

    def cut(batches):
        encoder = tokenizer_encoder(source, False, remembered)
        for batch in slices(batches, ENCODE_BYTES):
            flat, counts = encoder(batch.column("text"))
            ends = np.cumsum(counts + 1)
            ids = np.full(int(ends[-1]), end_id, "<u4")
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = flat
            raw = memoryview(ids.tobytes())
            out = []
            for doc_id, end, count in zip(batch.column("doc_id").to_pylist(), ends.tolist(), counts.tolist()):
                first = end - count - 1
                for piece, at in enumerate(range(first, end, capacity)):
                    stop = min(at + capacity, end)
                    out.append((doc_id, piece, at - first, stop - at, zlib.crc32(raw[4 * at : 4 * stop])))
            yield record_batch(schema, list(zip(*out)))

    return narrow(docs).mapInArrow(cut, _PIECE)


def fullest(first: int, sizes: list[int], limits: list[int], capacity: int) -> list[int]:
    """How many of each size (at most its limit) to add to `first` so that the sum comes closest to `capacity`: a
    subset-sum whose reachable sums are the bits of an integer."""
    room = capacity - first
    keep = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for size, limit in zip(sizes, limits):
        stages.append(reach)
        for _ in range(min(limit, room // size)):
            more = reach | (reach << size & keep)
            if more == reach:
                break
            reach = more
    best = reach.bit_length() - 1
    used = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not stages[i] >> best & 1:
            best -= sizes[i]
            used[i] += 1
    return used


def grouped(lengths: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count], longest first, cut into groups of equal cardinality."""
    left = sum(lengths.values())
    each = max(1, -(-left // groups))
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(lengths, reverse=True):
        count = lengths[length]
        while count:
            if not room:
                out.append([])
                room = each
            take = min(count, room)
            out[-1].append([length, take])
            count -= take
            room -= take
    return out


def plan(lengths: dict[int, int], capacity: int = CAPACITY, large_share: float = LARGE_SHARE, groups: int = GROUPS) -> list:
    """Runs (number of sequences, lengths inside each) that hold so many pieces of each length."""
    small_most = int(capacity * large_share)
    runs: list[tuple[int, list[int]]] = []  # of sequences with large pieces alone
    queues = grouped({k: n for k, n in lengths.items() if k > small_most}, groups)
    sizes = [q[0][0] for q in queues]  # each group is rounded up to its longest piece
    left = [sum(n for _, n in q) for q in queues]
    for i in range(len(sizes)):
        while left[i]:
            others = range(len(sizes) - 1, i - 1, -1)  # rising sizes, none above the first
            limits = [left[k] - (k == i) for k in others]
            used = dict(zip(others, fullest(sizes[i], [sizes[k] for k in others], limits, capacity)))
            used[i] += 1
            times = min(left[k] // n for k, n in used.items() if n)
            places = [k for k, n in sorted(used.items()) for _ in range(n)]
            for k in places:
                left[k] -= times
            runs += _substituted(places, times, queues)
    return _best_fit({k: n for k, n in lengths.items() if k <= small_most}, runs, capacity)


def _substituted(places: list[int], times: int, queues: list) -> list[tuple[int, list[int]]]:
    """`times` sequences whose places hold the next actual pieces of their groups, as runs of equal lengths."""
    columns = []
    for k in places:
        queue, need, column = queues[k], times, []
        while need:
            take = min(need, queue[0][1])
            column.append([queue[0][0], take])
            need -= take
            queue[0][1] -= take
            if not queue[0][1]:
                queue.pop(0)
        columns.append(column)
    runs = []
    while times:
        count = min(c[0][1] for c in columns)
        runs.append((count, [c[0][0] for c in columns]))
        for c in columns:
            c[0][1] -= count
            if not c[0][1]:
                c.pop(0)
        times -= count
    return runs


def _best_fit(small: dict[int, int], runs: list[tuple[int, list[int]]], capacity: int) -> list[tuple[int, list[int]]]:
    """Small pieces, longest first, into the run of sequences with the least room that is enough."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for run in runs:
        by_room[capacity - sum(run[1])].append(run)
    rooms = sorted(by_room)

    def put(run: tuple[int, list[int]], room: int) -> None:
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append(run)

    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                count, inside = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            else:
                room, inside = capacity, []
                count = -(-left // (capacity // length))
            # a sequence that was the tightest stays so until no further piece of this length fits
            fits = room // length
            filled = min(count, left // fits)
            if filled:
                put((filled, inside + [length] * fits), room - fits * length)
                left -= filled * fits
                count -= filled
            if count and left and left < fits:
                put((1, inside + [length] * left), room - left * length)
                count -= 1
                left = 0
            if count and inside:
                put((count, inside), room)
    return [run for room in sorted(by_room) for run in by_room[room]]


def places(runs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): pieces of a length in rank order take these places."""
    rows, taken, sequence = [], defaultdict(int), 0
    for count, inside in runs:
        offset = 0
        for length in inside:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces (columns of token_pieces) with sequence_id and offset."""
    rows = stage(pieces.withColumn("__part", F.spark_partition_id()), "pieces", BATCH_ROWS)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    table = places(plan(counts, capacity, **options))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        found = table[np.searchsorted(keys, length.to_numpy() * (1 << 48) + rank.to_numpy(), "right") - 1]
        return pd.DataFrame({"sequence_id": found[:, 2] + rank.to_numpy() - found[:, 1], "offset": found[:, 3]})

    numbered = ranked(rows, "__part", "length", ["doc_id", "piece"], "__rank")
    return numbered.withColumn("__place", place("length", "__rank")).select(*pieces.columns, "__place.*")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack(token_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

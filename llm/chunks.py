"""Texts as codes of distinct units, so that a tokenizer sees each distinct piece of text once per worker.

A chunk is a run of white space with the run of other characters after it (or white space at the end of a text). No
pre-token of the byte-level pattern reaches over a place where white space follows something else, nor from a letter to
a full stop or comma after it; a unit is a chunk, or its part before or within such a tail. The ids of a text are those
of its units in order. For tokenizers that drop white space the chunks are what stands between it.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from llm.common import WHITE_SPACE

_CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_RE2_SPACE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts where a space or line end stands beside other white space, or that hold the mark, take the slow split.
_MIXED = f"\\x00|[ \\n][{_RE2_SPACE}]|[{_RE2_SPACE}][ \\n]"
_TAIL = ".,"
_TAILED = r"\pL[.,]+$"
#: Bytes of text that are encoded at once, beside a longer single text.
ENCODE_BYTES = 2 << 20
#: Distinct units that a worker remembers; beyond, it keeps those that came in several slices, at most half (a bound on
#: memory, not on what is encoded).
REMEMBERED = 2_000_000


_FACTORS = np.random.default_rng(1).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: its bytes, each times the factor of its place, mixed."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _FACTORS[place & (len(_FACTORS) - 1)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    found = sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]] + sizes.astype(np.uint64)
    found = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return found ^ (found >> np.uint64(32))


class ChunkEncoder:
    """Ids of texts through `encode(list of distinct strings) -> (all ids one after the other, how many each has)`.

    spaces=False: white space is dropped by the tokenizer and chunks are split at ASCII white space alone."""

    def __init__(self, encode, spaces: bool = True, remembered: int = REMEMBERED):
        self.encode, self.spaces, self.remembered = encode, spaces, remembered
        self.reset()

    def reset(self) -> None:
        self.known = pa.array([""], pa.string())  # the unit of each code
        self.hashes, self.codes = _hashes(self.known), np.zeros(1, np.int32)  # sorted, and the code of each
        self.flat, self.held = np.empty(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.uses = np.full(1, 255, np.uint8)  # slices that each unit came in, at most 255

    def _forget(self) -> None:
        """Keep the units of several slices, at most half of what may be remembered."""
        least = 2
        while (self.uses >= least).sum() > self.remembered // 2 and least < 255:
            least += 1
        kept = np.flatnonzero(self.uses >= least)
        if len(kept) > self.remembered // 2:
            return self.reset()
        flat, sizes = self._runs(self.flat, self.starts[kept], self.sizes[kept]), self.sizes[kept]
        number = np.full(len(self.known), -1, np.int32)
        number[kept] = np.arange(len(kept), dtype=np.int32)
        there = number[self.codes] >= 0
        self.hashes, self.codes = self.hashes[there], number[self.codes[there]]
        self.known, self.flat, self.held = self.known.take(pa.array(kept)), flat, len(flat)
        self.starts, self.sizes = (np.cumsum(sizes) - sizes).astype(np.int32), sizes
        self.uses = np.ones(len(kept), np.uint8)
        self.uses[0] = 255

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks, and how many each text has."""
        if not self.spaces:
            lists = pc.ascii_split_whitespace(texts)
            return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        mixed = pc.match_substring_regex(texts, _MIXED)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(marked, "\0")
        if pc.any(mixed).as_py():
            slow = mixed.to_pylist()
            given = texts.to_pylist()
            lists = lists.to_pylist()
            lists = pa.array([_CHUNK.findall(t) if s else x for t, s, x in zip(given, slow, lists)], pa.list_(pa.string()))
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    def _codes(self, units: pa.Array) -> np.ndarray:
        """The code of each unit; new ones are encoded."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary
        hashes = _hashes(distinct)
        codes = self.codes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)]
        # equal hashes alone are not trusted
        new = np.flatnonzero(~pc.equal(self.known.take(pa.array(codes)), distinct).to_numpy(zero_copy_only=False))
        if len(new):
            codes[new] = len(self.known) + np.arange(len(new), dtype=np.int32)
            self._learn(distinct.take(pa.array(new)))
            order = np.argsort(merged := np.concatenate([self.hashes, hashes[new]]), kind="stable")
            self.hashes, self.codes = merged[order], np.concatenate([self.codes, codes[new]])[order]
        self.uses[codes] = np.minimum(self.uses[codes], 254) + 1
        return codes[coded.indices.to_numpy()]

    def _learn(self, units: pa.Array) -> None:
        ids, sizes = self.encode(units.to_pylist())
        held = self.held + len(ids)
        if held > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(held, np.int32)])
        self.flat[self.held : held] = ids
        self.starts = np.concatenate([self.starts, (self.held + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.uses = np.append(self.uses, np.zeros(len(sizes), np.uint8))
        self.known, self.held = pa.concat_arrays([self.known, units]), held

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        texts = texts.cast(pa.string())
        if len(self.known) > self.remembered:
            self._forget()
        chunks, counts = self._split(texts)
        if not len(chunks):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        chunks = chunks.dictionary_encode()
        distinct, of = chunks.dictionary, chunks.indices.to_numpy()
        tailed = pc.match_substring_regex(distinct, _TAILED)
        heads = pc.if_else(tailed, pc.utf8_rtrim(distinct, _TAIL), distinct)
        tail_sizes = pc.subtract(pc.utf8_length(distinct), pc.utf8_length(heads)).to_numpy(zero_copy_only=False)
        tails = np.full(len(distinct), "", object)
        some = np.flatnonzero(tail_sizes)
        tails[some] = [s[-k:] for s, k in zip(distinct.take(pa.array(some)).to_pylist(), tail_sizes[some].tolist())]
        pairs = np.stack([self._codes(heads), self._codes(pa.array(tails, pa.string()))], axis=1)
        unit_sizes = self.sizes[pairs]
        chunk_sizes = unit_sizes.sum(axis=1)
        # ids of each distinct chunk, one after the other; then each occurrence is a copy of one run
        flat = self._runs(self.flat, self.starts[pairs].ravel(), unit_sizes.ravel())
        ids = self._runs(flat, (np.cumsum(chunk_sizes) - chunk_sizes)[of], chunk_sizes[of])
        ends = np.concatenate([[0], np.cumsum(chunk_sizes[of], dtype=np.int64)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    @staticmethod
    def _runs(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """source[start : start + size] of each pair, joined."""
        ends = np.cumsum(sizes, dtype=np.int64)
        where = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return source[where]


_LOADED: dict = {}


def tokenizer_encoder(source: str, spaces: bool, remembered: int = REMEMBERED) -> ChunkEncoder:
    """One encoder per worker process for a tokenizers file given as its JSON text; strings of special tokens in a text
    are ordinary text."""
    key = (hash(source), len(source), spaces)
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.encode_special_tokens = True

        def encode(units):
            parts, sizes = [np.empty(0, np.int32)], np.empty(len(units), np.int64)
            for i in range(0, len(units), 1000):
                ids = [e.ids for e in tokenizer.encode_batch_fast(units[i : i + 1000], add_special_tokens=False)]
                sizes[i : i + 1000] = [len(x) for x in ids]
                parts.append(np.fromiter(chain.from_iterable(ids), np.int32))
            return np.concatenate(parts), sizes

        _LOADED.clear()
        _LOADED[key] = ChunkEncoder(encode, spaces, remembered)
    return _LOADED[key]

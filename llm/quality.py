"""Quality rules by compression bands.

Zstandard ratios (bytes / compressed bytes) of the whole text and of fixed chunks are held against limits that depend
on the length: above the band a text repeats itself, below it the text is close to random. Word-level base rules run
first. One narrow pass, no shuffle; each row is judged alone, so lost executors cost only their own rows.

Null text counts as empty (no words, hence base_failed); repeated rows are judged alike; an empty table gives no rows;
other columns are ignored by `score_quality` and kept by `filter_quality`, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import WORD_PATTERN, documents, narrow

#: (up to so many bytes, least ratio, largest ratio) of a whole text; a short text compresses less, so bands rise. The
#: least ratios lie above random words of letters of both cases and digits (1.26 at 512 bytes, 1.38 at 2048, 1.41 from
#: 8192 on; base64 less) and below ordinary text of the length; from 2048 bytes on also above lower-case ones (1.59).
WHOLE_BANDS = (
    (384, 1.2, 3.0), (448, 1.24, 3.0), (512, 1.28, 3.0), (1024, 1.38, 3.5), (2048, 1.42, 3.5), (8192, 1.6, 4.0),
    (1 << 62, 1.6, 5.0),
)
CHUNK_BYTES = 2048
#: The same for one full chunk; a text is rejected if over BAD_CHUNKS of its full chunks are outside.
CHUNK_BAND = (1.56, 4.5)
BAD_CHUNKS = 0.5
LEVEL = 3
#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

_SCHEMA = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,
 kept boolean, whole_ratio double, n_chunks long, n_bad_chunks long"""


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that are found twice or more in the text, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[str, int] = {}
    a = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    pairs = a[:-1] * len(codes) + a[1:]
    if len(codes) > 2_000_000:  # three codes no longer fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(codes) + a[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: str, word: re.Pattern) -> int:
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif word.search(line):
            seen.add(line)
    return found


class Judge:
    """Base counts and the compression verdict of one text."""

    def __init__(self, whole_bands=WHOLE_BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND, bad_chunks=BAD_CHUNKS):
        self.whole_bands, self.chunk_bytes = whole_bands, chunk_bytes
        self.chunk_band, self.bad_chunks = chunk_band, bad_chunks
        self.word = re.compile(WORD_PATTERN)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.packer.compress(data))

    def in_band(self, data: bytes) -> tuple[bool, float, int, int]:
        """Verdict, whole ratio, full chunks, full chunks outside their band."""
        if not data:
            return False, 0.0, 0, 0
        whole = self.ratio(data)
        low, high = next((lo, hi) for most, lo, hi in self.whole_bands if len(data) <= most)
        chunks = range(0, len(data) - self.chunk_bytes + 1, self.chunk_bytes)
        lo, hi = self.chunk_band
        bad = sum(not lo <= self.ratio(data[i : i + self.chunk_bytes]) <= hi for i in chunks)
        return low <= whole <= high and bad <= self.bad_chunks * len(chunks), whole, len(chunks), bad

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        words = self.word.findall(text)
        repeats = repeated_words(words)
        failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * len(words)
        good, whole, chunks, bad = self.in_band(text.encode())
        return (
            len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text, self.word), repeats,
            failed, good and not failed, whole, chunks, bad,
        )


def _judged(**limits):
    @F.pandas_udf(_SCHEMA)
    def judged(texts: pd.Series) -> pd.DataFrame:
        judge = Judge(**limits)
        names = [c.split()[0] for c in _SCHEMA.split(",")]
        return pd.DataFrame([judge(t) for t in texts], columns=names)

    return judged


def score_quality(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measured ratios. limits: the arguments of Judge."""
    return narrow(docs).select("doc_id", _judged(**limits)("text").alias("q")).select("doc_id", "q.*")


def filter_quality(docs: DataFrame, **limits) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    return docs.where(_judged(**limits)(F.coalesce(F.col("text"), F.lit("")))["kept"])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir))

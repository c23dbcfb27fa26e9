"""Secret scan: a linear-chain conditional random field tags tokens as secret begin, inside or outside.

Tokens are runs of word characters or single other characters. A token's score for a tag sums weights of its shape
(length, kind of characters, changes between them, share of digits, first characters), of the words and shapes of its
neighbours, and of its document (densities of punctuation and digits, language); tags add transition weights. Viterbi
finds the best tags of a whole text.

Training: windows around the base expressions' finds, and as many windows at hashed places of all texts, at most
TRAIN_WINDOWS of each by the least hashes (the documented bound of the sample; the base's finds are its labels). The
windows' gradient by forward and backward sums runs on the driver, whose data is so bounded. Some windows hide some
neighbours or the shapes, so that a secret without a keyword is found as well as one of another shape behind one.

Decoding covers every token of every text: a token whose margin for "outside" is above all that transitions and the next
token could win back is certainly outside, so only the runs between such tokens need the recursion; the tags are those
of Viterbi over the whole text. Model spans that touch a base span are dropped, base spans stay.

Null text: empty, no spans. Null doc_id: kept. Repeated rows give repeated rows; without any base find there is no model
and no model span; an empty table gives no rows; columns but doc_id, text and lang are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import BATCH_ROWS, documents, slices, stage

#: Fixed values of the contract: the base expressions, and the least length of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Windows of each sort that the model learns from; characters on each side of a window's middle; its tokens.
TRAIN_WINDOWS, REACH, WINDOW_TOKENS = 1500, 100, 48
STEPS, RATE, DECAY = 80, 0.3, 2e-5
#: Parts of windows that hide the neighbours at one place, or the tokens' own shapes.
HIDE_NEAR, HIDE_SHAPE = 0.5, 0.15
#: Alphabets and lengths of the secrets that take a window's own ones' place in its copy.
_ALNUM = string.ascii_letters + string.digits
ALPHABETS = (string.digits + "abcdef", string.digits + "ABCDEF", _ALNUM, _ALNUM + "+/", _ALNUM + "_-")
VARIED = (14, 64)
OUT, BEGIN, INSIDE = 0, 1, 2
#: Neighbours whose words and shapes count; learnt words of neighbours; tokens scored at once.
NEAR, WORDS, BLOCK = (-3, -2, -1, 1, 2), 2000, 1 << 18
TEXT_BYTES = 2 << 20

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
#: Any text with a base span matches one of these (RE2, linear).
_MAYBE = "(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the base, in order."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        least = LEAST[KINDS[kind]]
        found += [(m.start(), kind, m.end(), m.start()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return sorted(found)


def _byte_classes() -> np.ndarray:
    """0 white space, 1 word, 2 any other byte; the same for what words hold: 3 digit, 4 lower, 5 upper, 6 mark, 7 beyond ASCII."""
    out = np.full(256, 2, np.uint8)
    for c in range(256):
        x = chr(c)
        if c >= 128:
            out[c] = 7
        elif x.isdigit():
            out[c] = 3
        elif x.isalpha():
            out[c] = 4 if x.islower() else 5
        elif x in "+/_.-":
            out[c] = 6
        elif x in " \t\n\x0b\x0c\r":
            out[c] = 0
    return out


_CLASS = _byte_classes()
_KIND = np.where(_CLASS > 2, 1, _CLASS).astype(np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_HEXDIGIT = np.array([chr(c) in "0123456789abcdefABCDEF" for c in range(256)])
_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64])
_SHARES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4])
#: Sizes of the feature tables: shapes, mixtures, beginnings; short shapes of neighbours; of documents.
SHAPES, MIXES, HEADS, SHORT, FILES, LANGS = 12 * 10, 6 * 6, 512, 12 * 4, 8, 32


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, code of each token, its first byte from the text's start, its text) of all texts."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    kind = _KIND[data]
    new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)) if len(kind) else np.empty(0, bool)
    first = offsets[:-1] - offsets[0]
    new[first[first < len(data)]] = True
    starts = np.flatnonzero(new).astype(np.int32)
    real = np.flatnonzero(kind[starts] > 0)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, np.int32(len(data)))), pa.py_buffer(data)])
    coded = runs.take(pa.array(real)).dictionary_encode()
    at = starts[real]
    owner = np.searchsorted(offsets[1:] - offsets[0], at, "right")
    return coded.dictionary, coded.indices.to_numpy(), at - first[owner], owner


class Words:
    """Feature numbers of distinct tokens."""

    def __init__(self, words: pa.Array):
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begin, size = offsets[:-1] - offsets[0], np.diff(offsets)
        kind = _CLASS[data]

        def total(flags):
            sums = np.append(0, np.cumsum(flags))
            return sums[begin + size] - sums[begin]

        digit, lower, upper, mark, other, beyond = (total(kind == k) for k in (3, 4, 5, 6, 2, 7))
        letters = lower + upper
        hexed = total(_HEXDIGIT[data]) == size
        changed = total(np.append(False, kind[1:] != kind[:-1])) if len(data) else np.zeros(0, np.int64)
        changed -= (kind[begin] != kind[begin - 1]) & (begin > 0) if len(data) else 0
        self.size = size
        form = np.select(
            [other > 0, beyond > 0, digit == size, lower == size, upper == size, (upper == 1) & (lower + 1 == size),
             hexed & (digit > 0), (digit > 0) & (letters + digit == size), letters == size],
            range(9), 9,
        )
        bucket = np.searchsorted(_LENGTHS, size, "right")
        self.shape = (bucket * 10 + form).astype(np.int32)
        turns = np.searchsorted([1, 2, 4, 8, 16], changed, "right")
        share = np.searchsorted([0.001, 0.15, 0.35, 0.65, 0.999], digit / np.maximum(size, 1), "right")
        self.mix = (turns * 6 + share).astype(np.int32)
        place = np.arange(len(data)) - np.repeat(begin, size)
        low = _LOWER[data].astype(np.uint64) + np.uint64(1)
        sums = np.append(np.uint64(0), np.cumsum(low * _FACTORS[place & 63], dtype=np.uint64))
        self.hash = (sums[begin + size] - sums[begin] + size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        four = sums[begin + np.minimum(size, 4)] - sums[begin]
        self.head = np.where(size >= 8, 1 + (four * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(HEADS - 1), 0).astype(np.int32)
        self.short = (np.minimum(bucket, 11) * 4 + np.select([other > 0, digit > 0, letters > 0], range(3), 3)).astype(np.int32)


def file_features(texts: pa.Array, langs: list) -> np.ndarray:
    """(punctuation bucket, digit bucket, language) of each text."""
    out = np.zeros((len(texts), 3), np.int32)
    for i, (text, lang) in enumerate(zip(texts, langs)):
        data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer() or b"") else np.empty(0, np.uint8)
        n = np.bincount(_CLASS[data], minlength=8)
        shares = np.array([n[2] + n[6], n[3]]) / max(len(data), 1)
        mark = 0 if lang is None else 1 + int(hashlib.md5(str(lang).encode()).hexdigest(), 16) % (LANGS - 1)
        out[i] = (*np.searchsorted(_SHARES, shares, "right"), mark)
    return out


class Field:
    """Weights of the conditional random field; every table has a column for each tag."""

    def __init__(self, words: np.ndarray):
        self.words = words  # sorted hashes of the neighbours' words that have weights
        self.own = {"shape": np.zeros((SHAPES, 3)), "mix": np.zeros((MIXES, 3)), "head": np.zeros((HEADS, 3))}
        self.near = {k: (np.zeros((len(words) + 1, 3)), np.zeros((SHORT + 1, 3))) for k in NEAR}
        self.file = [np.zeros((FILES, 3)), np.zeros((FILES, 3)), np.zeros((LANGS, 3))]
        self.steps = np.zeros((3, 3))

    def tables(self) -> list[np.ndarray]:
        return [*self.own.values(), *(t for pair in self.near.values() for t in pair), *self.file, self.steps]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word among the learnt ones; the last row: unknown."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == hashes, at, len(self.words)) if len(self.words) else np.zeros(len(hashes), np.int64)

    def transitions(self) -> np.ndarray:
        """Scores of a tag after another; a text begins and ends outside; inside stands after begin or inside alone."""
        out = self.steps.copy()
        out[OUT, INSIDE] = -np.inf
        return out

    def scorer(self, words: Words):
        """Scores by the tokens of some words: score(codes with 3 before and 2 after, feature rows of the documents)."""
        known = self.known(words.hash)
        # one more row: nothing stands there
        own = np.vstack([self.own["shape"][words.shape] + self.own["mix"][words.mix] + self.own["head"][words.head], np.zeros(3)])
        near = {k: np.vstack([a[known] + b[words.short], a[-1] + b[-1]]) for k, (a, b) in self.near.items()}

        def score(codes: np.ndarray, files: np.ndarray) -> np.ndarray:
            n = len(codes) - 5
            out = own[codes[3 : 3 + n]]
            for k in NEAR:
                out = out + near[k][codes[3 + k : 3 + k + n]]
            for j, table in enumerate(self.file):
                out += table[files[:, j]]
            return out

        return score


def varied(text: str, rng: np.random.Generator, bare: bool) -> tuple[str, list[tuple[int, int]]]:
    """A window with each secret replaced by a random one of another length and alphabet (bare: with its keyword), so
    that the model does not learn one issuer's shape alone; and where they stand."""
    out, places, last = "", [], 0
    for begin, _, end, start in base_spans(text):
        if begin >= last:
            letters, size = ALPHABETS[rng.integers(len(ALPHABETS))], rng.integers(*VARIED)
            out += text[last : begin if bare else start]
            secret = "".join(letters[i] for i in rng.integers(len(letters), size=size))
            places.append((len(out), len(out) + len(secret)))
            out += secret
            last = end
    return out + text[last:], places


def fit(windows: list[tuple[str, tuple[int, int, int]]], seed: int = 3) -> Field | None:
    """A field learnt from (text, document features) windows, labelled by the base; None without a base find."""
    rng = np.random.default_rng(seed)
    own = [[(s[3], s[2]) for s in base_spans(t)] for t, _ in windows]
    copies = [(*varied(t, rng, bare), f) for (t, f), found in zip(windows, own) if found for bare in (False, True)]
    windows = [(t, f, spans) for (t, f), spans in zip(windows, own)] + [(t, f, spans) for t, spans, f in copies]
    texts = pa.array([w[0] for w in windows], pa.string())
    if not len(windows):
        return None
    distinct, codes, at, owner = tokens(texts)
    place = np.arange(len(codes)) - np.searchsorted(owner, owner)
    some = place < WINDOW_TOKENS
    codes, at, owner, place = codes[some], at[some], owner[some], place[some]
    words = Words(distinct)
    wide = int(place.max()) + 1 if len(place) else 1
    n = len(windows)
    inside = np.zeros((n, wide), bool)
    inside[owner, place] = True
    sizes = words.size[codes]
    gold = np.zeros((n, wide), np.int64)
    by_text = np.searchsorted(owner, np.arange(n + 1))
    for i, (text, _, spans) in enumerate(windows):
        lo, hi = by_text[i], by_text[i + 1]
        for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
            a, b = len(text[:start].encode()), len(text[:end].encode())
            mine = np.flatnonzero((at[lo:hi] + sizes[lo:hi] > a) & (at[lo:hi] < b))
            if len(mine) and not gold[i, mine[0]]:
                gold[i, mine] = INSIDE
                gold[i, mine[0]] = BEGIN
    if not gold.any():
        return None
    hashes, counts = np.unique(words.hash[codes], return_counts=True)
    field = Field(np.sort(hashes[np.lexsort((hashes, -counts))][:WORDS]))
    known, none = field.known(words.hash), (len(field.words), SHORT)
    cell = owner * wide + place
    own_shown = (rng.random(n) >= HIDE_SHAPE)[owner]
    # (table, row, cell) of every feature that is there
    uses = [(t, f[codes][own_shown], cell[own_shown]) for t, f in zip(field.own.values(), (words.shape, words.mix, words.head))]
    grid = np.full((n, wide + 5), -1, np.int64)
    grid[owner, place + 3] = codes
    for k, (word_table, short_table) in field.near.items():
        near_shown = (rng.random(n) >= HIDE_NEAR)[owner]
        beside = grid[owner, place + 3 + k][near_shown]
        there = beside >= 0
        uses.append((word_table, np.where(there, known[np.maximum(beside, 0)], none[0]), cell[near_shown]))
        uses.append((short_table, np.where(there, words.short[np.maximum(beside, 0)], none[1]), cell[near_shown]))
    files = np.array([w[1] for w in windows])
    uses += [(t, files[owner, j], cell) for j, t in enumerate(field.file)]
    target = np.zeros((n, wide, 3))
    target[owner, place, gold[owner, place]] = 1
    pairs = np.zeros((3, 3))
    before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
    np.add.at(pairs, (before[inside], gold[inside]), 1)
    last = inside.sum(axis=1) - 1
    np.add.at(pairs, (gold[np.arange(n), np.maximum(last, 0)], np.zeros(n, np.int64)), 1)
    seen = [np.full(t.shape, 1e-8) for t in field.tables()]
    for _ in range(STEPS):
        scores = np.zeros((n * wide, 3))
        for table, row, where in uses:
            scores[where] += table[row]  # a cell stands once in `where`
        marginal, both = _expected(scores.reshape(n, wide, 3), inside, field.transitions())
        off = ((target - marginal) * inside[:, :, None]).reshape(-1, 3)
        grads = []
        for table, row, where in uses:
            grads.append(np.stack([np.bincount(row, off[where, k], minlength=len(table)) for k in range(3)], axis=1))
        grads.append(np.where(np.isfinite(field.transitions()), pairs - both, 0.0))
        for table, grad, total in zip(field.tables(), grads, seen):
            grad = grad / n - DECAY * table
            total += grad * grad
            table += RATE * grad / np.sqrt(total)
    return field


def _expected(scores: np.ndarray, inside: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the tags of each token, and the expected number of each transition (begin and end: outside), by
    sums ahead and back that are scaled to 1 at every token."""
    n, wide, _ = scores.shape
    step = np.exp(steps)
    own = np.exp(scores - scores.max(axis=2, keepdims=True))
    own[~inside] = 1
    ahead, back = np.empty((wide, n, 3)), np.empty((wide, n, 3))
    scaled = lambda x: x / x.sum(axis=1, keepdims=True)
    ahead[0] = scaled(step[OUT] * own[:, 0])
    for t in range(1, wide):
        ahead[t] = np.where(inside[:, t, None], scaled((ahead[t - 1] @ step) * own[:, t]), ahead[t - 1])
    back[-1] = scaled(np.tile(step[:, OUT], (n, 1)))
    for t in range(wide - 2, -1, -1):
        back[t] = np.where(inside[:, t + 1, None], scaled((own[:, t + 1] * back[t + 1]) @ step.T), back[-1])
    marginal = ahead * back
    marginal /= marginal.sum(axis=2, keepdims=True)
    both = np.zeros((3, 3))
    first, last = inside[:, 0], np.maximum(inside.sum(axis=1) - 1, 0)
    both[OUT] += marginal[0, first].sum(axis=0)
    both[:, OUT] += marginal[last, np.arange(n)][first].sum(axis=0)
    for t in range(1, wide):
        on = inside[:, t]
        x = ahead[t - 1, on][:, :, None] * step * (own[on, t] * back[t, on])[:, None, :]
        both += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal.transpose(1, 0, 2), both


def best_tags(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """Viterbi over one run with "outside" on both sides."""
    step, best, back = steps.tolist(), None, []
    for row in scores.tolist():
        if best is None:
            best = [step[OUT][x] + row[x] for x in range(3)]
            continue
        source = [max(range(3), key=lambda a, x=x: best[a] + step[a][x]) for x in range(3)]
        best = [best[source[x]] + step[source[x]][x] + row[x] for x in range(3)]
        back.append(source)
    tag = max(range(3), key=lambda x: best[x] + step[x][OUT])
    tags = [tag]
    for source in reversed(back):
        tag = source[tag]
        tags.append(tag)
    return tags[::-1]


def most_won_back(steps: np.ndarray) -> float:
    """The most that another tag than "outside" can win by transitions, if an inside token after it would begin anew."""
    most = 0.0
    for a in range(3):
        for x in (BEGIN, INSIDE):
            for b in range(3):
                if b != INSIDE:
                    won = steps[a, x] + steps[x, b] - steps[a, OUT] - steps[OUT, b]
                else:
                    later = max(steps[INSIDE, c] - steps[BEGIN, c] for c in range(3))
                    won = steps[a, x] + steps[x, INSIDE] + later - steps[a, OUT] - steps[OUT, BEGIN]
                most = max(most, won)
    return most


def tagged(field: Field, texts: pa.Array, langs: list) -> list[tuple[int, int, int]]:
    """(text, first byte, last byte + 1) of the model's spans."""
    distinct, codes, at, owner = tokens(texts)
    if not len(codes):
        return []
    words, steps = Words(distinct), field.transitions()
    score, most, none = field.scorer(words), most_won_back(steps), len(distinct)
    files = file_features(texts, langs)
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    # five places where nothing stands between texts, so that neighbours never come from another text
    shift = np.zeros(len(codes), np.int64)
    shift[edge] = 5
    place = np.arange(len(codes)) + np.cumsum(shift) - 2
    spaced = np.full(place[-1] + 3, none, np.int64)
    spaced[place] = codes
    found = []
    keep_at, keep_scores = [], []
    for a in range(0, len(codes), BLOCK):
        b = min(a + BLOCK, len(codes))
        lo, hi = place[a] - 3, place[b - 1] + 3
        rows = np.zeros((hi - lo - 5, 3), np.int32)
        rows[place[a:b] - lo - 3] = files[owner[a:b]]
        scores = score(spaced[lo:hi], rows)[place[a:b] - lo - 3]
        # what the token after it could win by "inside" instead of "begin"; unknown at a block's end
        after = np.append(scores[1:, INSIDE] - scores[1:, BEGIN], np.inf if b < len(codes) else 0.0)
        last = np.append(owner[a + 1 : b] != owner[a : b - 1], b == len(codes) or owner[b] != owner[b - 1])
        won = most + np.where(last, 0, np.maximum(after, 0))
        open_ = np.flatnonzero(scores[:, OUT] - scores[:, 1:].max(axis=1) <= won)
        keep_at.append(open_ + a)
        keep_scores.append(scores[open_])
    open_, scores = np.concatenate(keep_at), np.concatenate(keep_scores)
    if not len(open_):
        return []
    cut = np.flatnonzero((np.diff(open_) > 1) | (owner[open_[1:]] != owner[open_[:-1]])) + 1
    for run, part in zip(np.split(open_, cut), np.split(scores, cut)):
        tags = best_tags(part, steps)
        for k, tag in enumerate(tags):
            token = run[k]
            end = int(at[token]) + int(words.size[codes[token]])
            if tag == BEGIN:
                found.append([int(owner[token]), int(at[token]), end])
            elif tag == INSIDE:
                found[-1][2] = end
    return [tuple(x) for x in found]


def training_windows(docs: DataFrame, most: int = TRAIN_WINDOWS) -> list[tuple[str, tuple[int, int, int]]]:
    """At most `most` windows around base finds and as many at any places, those with the least hashes."""
    schema = pa.schema([("found", pa.bool_()), ("text", pa.string()), ("file", pa.list_(pa.int32()))])

    def window(text: str, middle: int) -> str:
        a, b = max(0, middle - REACH), min(len(text), middle + REACH)
        piece = text[a:b]
        if a and " " in piece[:REACH]:
            piece = piece[piece.index(" ") + 1 :]
        return piece[: piece.rindex(" ")] if b < len(text) and " " in piece[-20:] else piece

    def emit(batches):
        for batch in slices(batches, TEXT_BYTES):
            maybe = pc.match_substring_regex(batch.column("text"), _MAYBE).to_pylist()
            any_place, out = batch.column("any").to_pylist(), []
            for i in range(batch.num_rows):
                if not maybe[i] and any_place[i] is None:
                    continue
                text = batch.column("text")[i].as_py()
                spans = base_spans(text) if maybe[i] else []
                middles = [(True, (s[0] + s[2]) // 2) for s in spans]
                if any_place[i] is not None:
                    middles.append((False, any_place[i] % (len(text) + 1)))
                if middles:
                    file = file_features(batch.column("text").slice(i, 1), [batch.column("lang")[i].as_py()])[0].tolist()
                    out += [(k, window(text, m), file) for k, m in middles]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # windows at any place: of the texts with the least hashes, by a threshold that leaves about three times `most`
    total = max(docs.count(), 1)
    share = min(1.0, 3.0 * most / total)
    place = F.xxhash64("text", F.lit(5))
    some = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    given = docs.withColumn("any", F.when(some, F.pmod(place, F.lit(1 << 31))))
    rows = stage(given.mapInArrow(emit, "found boolean, text string, file array<int>"), "secret-windows", BATCH_ROWS)
    key = F.xxhash64("text", "file")
    out = []
    for found in (True, False):
        out += rows.where(F.col("found") == found).distinct().orderBy(key, "text").limit(most).collect()
    return [(r["text"], tuple(r["file"])) for r in out]


_RESULT = """doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"""


def scan_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, the base's counts and hash, the number of model spans, and all spans."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    field = field or fit(training_windows(texts))
    schema = pa.schema([
        ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in (*KINDS, "model")), ("base_sha256", pa.string()), ("spans", pa.string()),
    ])

    def joined(spans):
        return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)

    def emit(batches):
        for batch in slices(batches, TEXT_BYTES):
            texts = batch.column("text")
            maybe = pc.match_substring_regex(texts, _MAYBE).to_pylist()
            base = {i: base_spans(texts[i].as_py()) for i in range(batch.num_rows) if maybe[i]}
            model: dict[int, list] = {}
            for i, a, b in tagged(field, texts, batch.column("lang").to_pylist()) if field else ():
                model.setdefault(i, []).append((a, b))
            out = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                spans = [(a, k, KINDS[k], b) for a, k, b, _ in base.get(i, [])]
                n = [sum(k == j for _, k, _, _ in spans) for j in range(len(KINDS))]
                own = joined(spans)
                more = _added(texts[i].as_py(), model[i], spans) if i in model else []
                out.append((doc_id, *n, len(more), hashlib.sha256(own.encode()).hexdigest(), joined(sorted(spans + more))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return texts.mapInArrow(emit, _RESULT)


def _added(text: str, spans: list[tuple[int, int]], base: list) -> list:
    """Byte spans as code points, without a full stop at their end and without those that touch a base span."""
    data = np.frombuffer(text.encode(), np.uint8)
    ahead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    taken = sorted((a, b) for a, _, _, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    out = []
    for a, b in spans:
        while b - a > 1 and data[b - 1] == 0x2E:
            b -= 1
        a, b = int(ahead[a]), int(ahead[b])
        before = np.searchsorted(starts, b)  # base spans that begin before its end
        if not before or reach[before - 1] <= a:
            out.append((a, len(KINDS), "model", b))
    return out


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))

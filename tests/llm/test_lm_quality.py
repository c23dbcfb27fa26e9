import base64
import math
import re
import string
import zlib
from collections import Counter
from pydoc_data.topics import topics

import numpy as np
import pytest

from llm import classlm
from llm.quality import Judge, filter_quality, op6_quality_rules, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_lm_query(spark, sf, texts):
    said = {i: tokens(t) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in said.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = classlm.op4_brown_class_lm(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = said[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        known = sum(counts[w] > 0 for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_learns_classes(spark):
    rnd = np.random.default_rng(5)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abcd"]
    rows = [(i, " ".join(kinds[(i + j) % 4][rnd.integers(12)] for j in range(80))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = classlm.score_documents(df, classes=8).collect()
    out = [r for r in got if r.held_out]
    perplexity = 10 ** (-sum(r.score for r in out) / sum(r.n_tokens for r in out))
    base = 10 ** (-sum(r.base_score for r in out) / sum(r.n_tokens for r in out))
    assert perplexity < 0.4 * base  # the next class is certain, its 12 words are not


def test_best_class_is_the_best_of_all_moves():
    rng = np.random.default_rng(2)
    words, classes = 12, 4
    n = rng.integers(0, 20, (words + 1, words + 1)).astype(float)
    of = np.array([0, *rng.integers(1, classes + 1, words)])

    def table(of):
        m = np.zeros((classes + 2, classes + 2))
        np.add.at(m, (of[:, None], of[None, :]), n)
        return m

    def likelihood(of):
        m = table(of)
        f = classlm._f
        return f(m).sum() - f(m.sum(axis=0)).sum() - f(m.sum(axis=1)).sum()

    for w in range(1, words + 1):
        others = np.arange(words + 1) != w
        left = np.bincount(of[others], n[others, w], minlength=classes + 2)
        right = np.bincount(of[others], n[w, others], minlength=classes + 2)
        got = classlm.best_class(left, right, n[w, w], of[w], table(of), range(1, classes + 1))
        moved = {c: likelihood(np.where(np.arange(words + 1) == w, c, of)) for c in range(1, classes + 1)}
        assert moved[got] == pytest.approx(max(moved.values()))


def test_best_classes_are_those_of_single_words():
    rng = np.random.default_rng(6)
    words, classes = 40, 5
    n = rng.integers(0, 9, (words + 1, words + 1)).astype(float) * (rng.random((words + 1, words + 1)) < 0.3)
    of = np.array([0, *rng.integers(1, classes + 1, words)])
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (of[:, None], of[None, :]), n)
    at = np.arange(1, words + 1)
    other = lambda w: np.arange(words + 1) != w
    left = np.array([np.bincount(of[other(w)], n[other(w), w], minlength=classes + 1) for w in at])
    right = np.array([np.bincount(of[other(w)], n[w, other(w)], minlength=classes + 1) for w in at])
    got = classlm.best_classes(left, right, n[at, at], of[at], table)
    one = [classlm.best_class(left[i], right[i], n[w, w], of[w], table, range(1, classes + 1)) for i, w in enumerate(at)]
    assert got.tolist() == one


@pytest.mark.parametrize("head, batch", [(24, 10_000), (24, 17)])
def test_lm_exchanges_words_outside_the_head(spark, monkeypatch, head, batch):
    """Most words stand between words outside the head; their classes follow from all neighbours, however texts are cut."""
    monkeypatch.setattr(classlm, "BATCH_ROWS", batch)
    rnd = np.random.default_rng(5)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "abcd"]
    rows = [(i, " ".join(kinds[(i + j) % 4][rnd.integers(60)] for j in range(80))) for i in range(300)]
    got = classlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), head=head, classes=8).collect()
    out = [r for r in got if r.held_out]
    perplexity = 10 ** (-sum(r.score for r in out) / sum(r.n_tokens for r in out))
    base = 10 ** (-sum(r.base_score for r in out) / sum(r.n_tokens for r in out))
    assert perplexity < 0.45 * base


@pytest.mark.parametrize("small", [1_000_000, 50])
def test_lm_scores_are_those_of_the_model_counted_anew(spark, monkeypatch, small):
    """Counts kept through all moves, cut into small pieces or not, are those of the texts under the final classes."""
    monkeypatch.setattr(classlm, "NEIGHBOURS_AT_ONCE", small)
    monkeypatch.setattr(classlm, "WORDS_AT_ONCE", small)
    monkeypatch.setattr(classlm, "CHUNK_BYTES", 4000)
    rnd = np.random.default_rng(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(words[int(j)] for j in rnd.zipf(1.4, rnd.integers(0, 60)) % 150)) for i in range(150)]
    held = next(i for i in range(900, 999) if classlm.is_held_out(i))
    rows += [(800, "w1 w1 w1 w2"), (801, None), (held, "W1 nowhere w2 elsewhere")]
    kept, numbered_chunks, settled = {}, classlm.numbered_chunks, classlm.settled

    def numbered(chunks, found):
        at = {r.chunk: r.words for r in chunks.select("chunk", "words").collect()}
        kept["ids"] = {
            at[r.chunk][p]: i for r in found.where("chunk >= 0").collect()
            for p, i in zip(classlm._unpack(r.places), classlm._unpack(r.ids).tolist())
        }
        return numbered_chunks(chunks, found)

    def final(*args):
        got = settled(*args)
        kept["classes"] = {r.part: classlm._unpack(r.nb) for r in got[0].select("part", "nb").collect()}
        return got

    monkeypatch.setattr(classlm, "numbered_chunks", numbered)
    monkeypatch.setattr(classlm, "settled", final)
    got = classlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), head=20, classes=6, rounds=3).collect()
    said = {i: [w or "" for w in tokens(t)] for i, t in rows}
    train = [ws for i, ws in said.items() if not classlm.is_held_out(i)]
    counts = Counter(w for ws in train for w in ws)
    n = sum(counts.values())

    def class_of(w):
        if w == "":
            return 0
        part, place = kept["ids"][w] >> classlm.PART_BIT, kept["ids"][w] & ((1 << classlm.PART_BIT) - 1)
        return int(kept["classes"][part][place])

    of = {w: class_of(w) for w in counts}
    assert set(of.values()) <= set(range(7)) and all(of[w] > 0 for w in counts if w)
    pairs = [(a, b) for ws in train for a, b in zip(["", *ws], ws)]
    moved = Counter((of[a], of[b]) for a, b in pairs)
    after = Counter(of[a] for a, _ in pairs)
    into = Counter(of[b] for _, b in pairs)
    once = Counter(of[a] for a, b in pairs if counts[b] == 1)
    overall = (sum(once.values()) + 0.5) / (n + 1)

    def chance(w, v):
        """P(w | v); an unknown v says nothing of its class, an unknown w stands for all of them."""
        if v in counts:
            unseen = min((once[of[v]] + classlm.UNSEEN_PRIOR * overall) / (after[of[v]] + classlm.UNSEEN_PRIOR), 0.5)
        else:
            unseen = overall
        if w not in counts:
            return unseen
        share = into[of[w]] / n
        move = (moved[of[v], of[w]] + classlm.PRIOR * share) / (after[of[v]] + classlm.PRIOR) if v in counts else share
        return (1 - unseen) * move * counts[w] / into[of[w]]

    for v in [*counts, "nowhere"]:
        assert sum(chance(w, v) for w in [*counts, "nowhere"]) == pytest.approx(1)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    for r in got:
        ws = said[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(chance(w, v)) for v, w in zip(["", *ws], ws)), rel=1e-9)


def test_lm_odd_rows(odd, odd_rows, empty, spark):
    rows = classlm.score_documents(odd, rounds=2).collect()
    assert len(rows) == len(odd_rows) and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in rows)
    assert classlm.score_documents(empty, rounds=1).collect() == []
    held = next(i for i in range(99) if classlm.is_held_out(i))
    alone = classlm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), rounds=1).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)


def slow_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_quality_query(spark, sf, texts):
    rows = op6_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_bands():
    rnd = np.random.default_rng(1)
    prose = " ".join("".join(chr(97 + c) for c in rnd.integers(0, 26, rnd.integers(2, 9))) for _ in range(900))
    judge = Judge()
    assert judge(prose)[6]
    assert not judge("buy now and save " * 300)[6]
    noise = " ".join("".join(chr(rnd.integers(33, 127)) for _ in range(40)) for _ in range(200))
    assert not judge(noise)[6]
    half = prose + "\n" + "\n".join(f"row {i % 3}" for i in range(4000))
    assert not judge(half)[6]


@pytest.mark.parametrize("size", [450, 573, 1000, 1843, 2048, 4200, 7582, 28528, 189608])
def test_quality_tells_noise_from_prose(size):
    rnd, judge = np.random.default_rng(size), Judge()
    letters = list(string.ascii_letters + string.digits)
    words = " ".join("".join(rnd.choice(letters, rnd.integers(2, 9))) for _ in range(size // 4))[:size]
    code = base64.b64encode(rnd.bytes(size)).decode()
    lines = "\n".join(code[i : i + 8] for i in range(0, size, 8))[:size]
    for noise in (words, lines):
        assert not judge.in_band(noise.encode())[0]
        assert not judge(noise)[6]
    manual = " ".join(re.sub(r"[^A-Za-z0-9 .,;:()\n'-]", "", topics[k]) for k in sorted(topics))
    least = next(low for most, low, _ in judge.whole_bands if size <= most)
    for start in range(0, len(manual) - size + 1, size):  # its tables of operators are over the upper limits
        part = manual[start : start + size].encode()
        assert judge.ratio(part) >= least
        if size >= judge.chunk_bytes:
            assert judge.ratio(part[: judge.chunk_bytes]) >= judge.chunk_band[0]


def test_quality_odd_rows(odd, odd_rows, empty):
    rows = score_quality(odd).collect()
    assert len(rows) == len(odd_rows)
    kept = filter_quality(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert score_quality(empty).collect() == [] and filter_quality(empty).collect() == []

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

from llm import simhash
from llm.components import components
from llm.minhash import (
    MinHash,
    fingerprint,
    fingerprint_with_next,
    likeness,
    near_duplicates,
    op2_minhash_fingerprints,
)


def expected(items):
    """items: (doc_id, text) by descending doc_id."""
    hasher, out = MinHash(), {}
    for k, (doc_id, text) in enumerate(items):
        after = items[(k + 1) % len(items)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, other, ahead = map(hasher.signature, (text, edited, after))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out[doc_id] = (len(text), sha, fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, ahead))
    return out


def test_minhash_query(spark, sf, texts):
    rows = op2_minhash_fingerprints(spark, sf).collect()
    want = expected(sorted(texts.items(), reverse=True))
    assert len(rows) == len(texts) and all(tuple(r)[1:] == want[r.doc_id] for r in rows)


def test_minhash_estimates_jaccard(texts):
    hasher, errors = MinHash(), []
    items = sorted(texts.values(), key=len)[-60:]
    for a in items:
        b = a[: len(a) * 4 // 5]
        x, y = set(hasher.shingles(a).tolist()), set(hasher.shingles(b).tolist())
        errors.append(abs(likeness(hasher.signature(a), hasher.signature(b)) - len(x & y) / len(x | y)))
    assert np.mean(errors) < 0.06


def test_minhash_odd_rows(spark, odd, odd_rows, empty):
    rows = fingerprint_with_next(odd).collect()
    assert len(rows) == len(odd_rows)
    assert sorted(r.n_chars for r in rows) == sorted(len(r[1] or "") for r in odd_rows)
    of = defaultdict(set)
    for r in rows:
        of[r.doc_id].add(r.fingerprint)
    assert len(of[3]) == 1 and of[3] == of[34] and of[30] == of[31] == of[32]
    assert fingerprint_with_next(empty).collect() == []
    one = fingerprint_with_next(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_minhash_classes_are_those_of_all_verified_pairs(spark, odd_rows, empty):
    rnd = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    originals = [list(rnd.choice(words, n)) for n in (60, 60, 120, 200, 300, 4)]
    rows = []
    for i in range(120):  # groups of near copies, each with edits of its own
        copy = list(originals[i % 6])
        for _ in range(rnd.integers(0, 4)):
            copy[rnd.integers(len(copy))] = str(rnd.choice(words))
        rows.append((i, " ".join(copy)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "a b"), (504, "a b"), (505, " ".join(rnd.choice(words, 80)))]
    hasher = MinHash()
    sets = [(i, frozenset(hasher.shingles(t or "").tolist())) for i, t in rows]
    near = lambda x, y: x == y or (x and len(x & y) >= 0.8 * len(x | y))
    want = slow_components(sets, near)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert near_duplicates(empty).collect() == []
    odd = near_duplicates(spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert odd.count() == len(odd_rows)


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(items, near):
    """items: (id, value); the least id that each reaches."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if near(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in items}


def test_simhash_query(spark, sf, texts):
    prints = {i: slow_simhash(t) for i, t in texts.items()}
    want = slow_components(sorted(prints.items()), lambda a, b: (a ^ b).bit_count() <= 2)
    rows = simhash.op3_simhash_near_dedup(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.fingerprint == "%016x" % prints[r.doc_id] and r.component_id == want[r.doc_id] for r in rows)


def test_simhash_hot_buckets_lose_no_link(spark):
    rng, base = np.random.default_rng(1), 0x923456789ABCDEF0
    values = {int(x) for x in rng.integers(0, 1 << 63, 200)}
    for _ in range(700):
        y = base
        for b in rng.choice(20, rng.integers(0, 6), replace=False):
            y ^= 1 << int(b * 3)
        values.add(y)
    items = [(i, v) for i, v in enumerate(sorted(values))]
    want = slow_components(items, lambda a, b: (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(simhash._signed(v),) for _, v in items], "fp long")
    groups = defaultdict(set)
    for i, v in items:
        groups[want[i]].add(simhash._signed(v))
    rows = components(simhash.links_within(df, 2, bucket=8)).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.root].add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_covering_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks((1 << 64) - 1, 2)
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_simhash_odd_rows(odd, odd_rows, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    of = {r.doc_id: (r.fp, r.component_id) for r in rows if r.doc_id is not None}
    assert of[30] == of[31] == of[32] == (0, 30) and of[3][1] == 3 and of[34][1] == 3
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted({r.component_id for r in rows})
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_first(empty).collect() == []


def test_simhash_keeps_a_row_of_every_component(spark):
    rnd = np.random.default_rng(4)
    text = lambda: " ".join(f"w{i}" for i in rnd.integers(0, 5000, 120))
    clean, shared, copied = [text() for _ in range(6)], [text() for _ in range(3)], text()
    rows = [(None, t) for t in clean] + [(None, clean[0])]  # only null ids in each component
    rows += [(7, t) for t in shared] + [(7, shared[1])] + [(7, copied), (3, copied), (None, copied)]
    want = sorted([(None, t) for t in clean] + [(7, t) for t in shared] + [(3, copied)], key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_first(df).collect()), key=str) == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}

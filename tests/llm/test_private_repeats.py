import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from llm import pii, suffix_dedup

#: The base expressions as given, for Python's own matcher.
RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base(text):
    spans, counts = [], []
    for kind, pattern in RAW.items():
        n = 0
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                n += 1
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return counts, ",".join(spans)


def rows_with_contexts(n=120):
    rnd, words, rows = random.Random(2), "the of and in on at blue green call house river".split(), []
    some = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    for i in range(n):
        x = i % 10
        email = f"u{i}(at)example.com" if x in (3, 7) else f"u{i}@mail.example.com"
        phone = f"(555) 555-{1000 + i}" if x in (2, 5) else f"+1 (555) 555-{1000 + i}"
        rows.append((i, f"{some(8)} Email: {email} {some(5)} reach me: {phone} {some(4)} the {10**15 + i} {some(3)}"))
    return rows


def test_private_query(spark, sf, texts):
    rows = pii.op5_private_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, spans = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(filter(None, r.spans.split(",")))


def test_private_base_against_python(spark):
    rnd, letters = random.Random(3), "a.@-+_%0129 5()é😀:\n"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))) for i in range(1500)]
    rows += [(5001, "a" * 100_000), (5002, "1" * 50_000), (5003, "1 " * 20_000), (5004, "x@y.zz 4111 1111 1111 1111")]
    rows += [(5005, "a@b.c_x@y.zz"), (5006, "1.2.3.4.5.6.7.8 999.1.1.1 0255.001.1.1"), (5007, "+1 ((((((" * 500)]
    rows += [(5008, "a." * 20_000 + "@" + "b." * 20_000), (5009, "+12 34-56.78(9) 123456789012345678")]
    got = {r.doc_id: r for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        counts, spans = base(text)
        r = got[i]
        assert ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.base) == spans, text[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts


def test_private_contexts_discover_more(spark):
    rows = rows_with_contexts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = dict(rows)
    for r in pii.find_private(df).collect():
        more = sorted(of[r.doc_id][s.start : s.stop] for s in r.spans if s not in r.base)
        i = r.doc_id
        want = [f"(555) 555-{1000 + i}"] * (i % 10 in (2, 5)) + [f"u{i}(at)example.com"] * (i % 10 in (3, 7))
        assert more == want  # and the number after an ordinary word stays
    masked = {r.doc_id: r.text for r in pii.mask_private(df).collect()}
    assert all("555-" not in t and "example.com" not in t and t.count("[phone]") == 1 for t in masked.values())


def test_private_contexts_discover_addresses(spark):
    hidden = ["10[.]0[.]0[.]1", "10 . 20 . 30 . 44", "192(dot)168(dot)7(dot)9", "10 dot 1 dot 2 dot 3", "2001:db8::8a2e:370:7334"]
    hidden += ["fe80::1", "2001:db8:0:0:1:0:0:1", "2001:db8::"]
    others = ["999.1.1.1:80", "999[.]1[.]1[.]1", "1.2.3.256", "12:30:45", "std::vector", "1::2::3", "1:2:3:4:5:6:7:8:9", "aa:bb:cc:dd:ee:ff"]
    rows = [(i, f"seen from host {f'10.9.8.{i}'} today") for i in range(80)]
    rows += [(100 + i, f"seen from host {h}, again") for i, h in enumerate(hidden)]
    rows += [(200 + i, f"seen from host {o} again") for i, o in enumerate(others)]
    rows += [(300 + i, f"an ordinary word {h} again") for i, h in enumerate(hidden)]
    of = dict(rows)
    for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        more = [(s.kind, of[r.doc_id][s.start : s.stop]) for s in r.spans if s not in r.base]
        assert more == ([("ip", hidden[r.doc_id - 100])] if 100 <= r.doc_id < 200 else []), of[r.doc_id]


def test_private_odd_rows(odd, odd_rows, empty):
    assert pii.find_private(odd).count() == len(odd_rows)
    masked = pii.mask_private(odd)
    assert masked.columns == odd.columns and masked.count() == len(odd_rows)
    assert pii.find_private(empty).collect() == [] and pii.mask_private(empty).collect() == []


def brute_repeats(rows):
    raws, seen = [(i, (t or "").encode()) for i, t in rows], defaultdict(int)
    for _, r in raws:
        for k in range(len(r) - 199):
            seen[r[k : k + 200]] += 1
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [text(60) for _ in range(6)] + ["a" * 700, "xyz" * 150]
    shared += [shared[0][:203], shared[1][10:215]]
    rows = []
    for i in range(100):
        t = text(rnd.randrange(0, 150))
        for _ in range(rnd.randrange(0, 3)):
            t += rnd.choice(["", " "]) + rnd.choice(shared) + text(rnd.randrange(0, 40))
        rows.append((i, t))
    rows += [(200, rows[3][1]), (3, rows[3][1]), (None, text(80)), (None, None), (201, ""), (202, "x" * 199)]
    return rows + [(203, "a" * 5000), (204, rows[5][1][:1] + "q" + rows[5][1][3:]), (205, "ab" * 3000 + text(100))]


@pytest.mark.parametrize("bucket_runs", [50_000, 1])
def test_repeats_against_brute_force(spark, passages, bucket_runs):
    df = spark.createDataFrame(passages, "doc_id long, text string")
    got = suffix_dedup.find_repeats(df, bucket_runs=bucket_runs).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(passages)


def test_repeats_query(spark, sf, texts):
    got = suffix_dedup.op10_suffix_dedup(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(texts.items())


def test_identifiers_stand_for_strings():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 2, 3000).astype(np.uint8)
    for depth in (8, 32, 200):
        ids = suffix_dedup.identifiers(data, depth)
        strings = [data[i : i + depth].tobytes() for i in range(len(data) - depth + 1)]
        assert len(ids) == len(strings) and len(set(ids.tolist())) == len(set(strings))
        assert len(set(zip(ids.tolist(), strings))) == len(set(strings))


def test_long_texts_are_cut_without_loss(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    texts = ["".join(map(chr, rnd.integers(97, 100, n))) for n in (0, 5, 199, 200, 201, 3000, 777)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    found = defaultdict(list)
    for data, sizes, of, offsets in suffix_dedup.blocks(pa.record_batch({"text": texts})):
        runs = suffix_dedup.Runs(data, sizes, True)
        for text, start, size in zip(runs.text.tolist(), runs.start.tolist(), runs.size.tolist()):
            found[int(of[text])] += range(start + int(offsets[text]), start + int(offsets[text]) + size)
    assert all(sorted(found[i]) == list(range(max(0, len(t) - 199))) for i, t in enumerate(texts))


def test_repeats_odd_rows(odd, odd_rows, empty):
    got = suffix_dedup.find_repeats(odd).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats([(r[0], r[1]) for r in odd_rows])
    left = suffix_dedup.remove_repeats(odd)
    assert left.columns == odd.columns
    kept = {r.doc_id: r.text for r in left.collect()}
    assert kept[35] == "" and kept[31] == "" and kept[30] is None
    assert suffix_dedup.find_repeats(empty).collect() == [] and suffix_dedup.remove_repeats(empty).collect() == []


def test_repeats_of_rows_without_ids(spark, sf):
    """Rows that share an id, or have none, get what their own texts give, also when copies are many."""
    from llm.suffix_dedup import find_repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in find_repeats(docs).collect())
    for doc_id in ("null", "7"):
        same = docs.selectExpr(f"CAST({doc_id} AS BIGINT) AS doc_id", "text")
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in find_repeats(same).collect()) == want

import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import packing, sharding, wavelet


def ids_of(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def pieces(items):
    out = []
    for doc_id, ids in items:
        ids = ids + [1]
        out += [(doc_id, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    return sorted(out, key=str)


def check_packed(rows, want):
    assert sorted((tuple(r[:5]) for r in rows), key=str) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        spots.sort()
        assert [o for o, _ in spots] == np.cumsum([0, *(n for _, n in spots[:-1])]).tolist()
        assert sum(n for _, n in spots) <= 4096
    return len(places)


def test_packing_query(spark, sf, texts):
    rows = packing.op7_best_fit_packing(spark, sf).collect()
    n = check_packed(rows, pieces(zip(texts, ids_of("word_bpe_49k.json", texts.values()))))
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_odd_rows(odd, odd_rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(packing.token_pieces(odd, path)).collect()
    check_packed(rows, pieces(zip((r[0] for r in odd_rows), ids_of("word_bpe_49k.json", (r[1] for r in odd_rows)))))
    assert packing.pack(packing.token_pieces(empty, path)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 50, 20_000])
def test_plans_use_every_piece_and_come_close(n):
    rnd = np.random.default_rng(n)
    lengths = Counter(np.clip(rnd.lognormal(6.3, 1.0, n).astype(int), 1, 4096).tolist())
    runs = packing.plan(dict(lengths))
    used = Counter()
    for count, inside in runs:
        assert sum(inside) <= 4096
        for x in inside:
            used[x] += count
    assert used == lengths
    least = -(-sum(k * v for k, v in lengths.items()) // 4096)
    assert sum(count for count, _ in runs) <= 1.01 * least + 1


def test_fullest_is_the_best_subset_sum():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        sizes = rnd.integers(5, 60, 5).tolist()
        limits = rnd.integers(0, 4, 5).tolist()
        sums = {0}
        for size, limit in zip(sizes, limits):
            sums = {s + k * size for s in sums for k in range(limit + 1)}
        used = packing.fullest(20, sizes, limits, 120)
        assert all(u <= m for u, m in zip(used, limits))
        assert sum(u * s for u, s in zip(used, sizes)) == max(s for s in sums if s <= 100)


def test_wavelet_query(spark, sf, texts):
    want, start = [], 0
    for doc_id, ids in sorted(zip(texts, ids_of("byte_bpe_50k.json", texts.values()))):
        want.append((doc_id, start, len(ids) + 1, crc(ids + [2])))
        start += len(ids) + 1
    assert sorted(map(tuple, wavelet.op8_wavelet_shards(spark, sf).collect())) == want


def test_wavelet_rank_and_select():
    rnd = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (17, 3), (5000, 300), (20_000, 50_257), (3000, 70_000)):
        ids = rnd.integers(0, top, n)
        built = wavelet.Shard(np.arange(3), np.array([n, 0, 0]), wavelet.WaveletMatrix.build(ids))
        matrix = wavelet.Shard.from_bytes(built.to_bytes()).matrix
        assert (matrix.ids() == ids).all()
        for i in rnd.integers(0, max(n, 1), 20 if n else 0).tolist():
            assert matrix.access(i) == ids[i]
        for value in rnd.integers(0, top, 20).tolist():
            where, end = np.flatnonzero(ids == value), int(rnd.integers(0, n + 1))
            assert matrix.count(value) == len(where) and matrix.count(value, end) == (where < end).sum()
            assert [matrix.locate(value, k) for k in range(len(where[:3]) + 1)][: len(where[:3])] == where[:3].tolist()
            assert matrix.locate(value, len(where)) == -1


def test_wavelet_odd_rows_and_small_shards(spark, odd, odd_rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = wavelet.write_shards(odd, path, shard_tokens=1000)
    rows = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r.start)
    assert shards.count() > 3 and len(shards.inputFiles()) >= shards.count()
    want = sorted((crc(i + [2]) for i in ids_of("byte_bpe_50k.json", (r[1] for r in odd_rows))))
    assert sorted(r.ids_crc32 for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x))
    assert wavelet.read_documents(wavelet.write_shards(empty, path)).collect() == []


def check_shards(rows, texts):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(k, 0) for k in range(24)), default=0) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    got = sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str)
    assert got == sorted(((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts), key=str)


def test_shards_query(spark, sf, texts):
    rows = sharding.op9_hypergeometric_shards(spark, sf).collect()
    check_shards(rows, texts.items())
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sorted(map(tuple, sharding.op9_hypergeometric_shards(spark, sf).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_shards_in_many_buckets(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    check_shards(sharding.op9_hypergeometric_shards(spark, sf).collect(), texts.items())


def test_matrix_has_the_margins(spark):
    counts = [(i * 3, (i * 37) % 11) for i in range(13)]
    total = sum(n for _, n in counts)
    sizes = [total // 5 + (j < total % 5) for j in range(5)]
    rows = sharding.communication_matrix(spark.createDataFrame(counts, "part int, n long"), sizes).collect()
    assert {r.part: sum(r.sent) for r in rows} == dict(counts)
    assert np.array([r.sent for r in rows]).sum(axis=0).tolist() == sizes and min(min(r.sent) for r in rows) >= 0


def test_draws_are_hypergeometric(spark):
    draw = sharding._hypergeometric(sharding._uniform("7", "id"), "100L", "30L", "20L")
    n = 20_000
    got = {r.x: r.n for r in spark.range(n).selectExpr(f"{draw} AS x").groupBy("x").agg({"*": "count"}).toDF("x", "n").collect()}
    chi = sum((got.get(k, 0) - e) ** 2 / e for k in range(1, 12) for e in [n * comb(30, k) * comb(70, 20 - k) / comb(100, 20)])
    assert chi < 35


def test_shards_odd_rows(odd, odd_rows, empty):
    from pyspark.sql import functions as F

    rows = sharding.uniform_shards(odd.select("doc_id", F.lit("x").alias("n"), F.lit(1).alias("part"))).collect()
    assert len(rows) == len(odd_rows) and Counter(r.slot for r in rows)[0] == min(24, len(odd_rows))
    assert sharding.uniform_shards(empty.select("doc_id")).collect() == []

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from llm.bpe import DuckBPE, decode_documents, encode_documents, op1_byte_bpe, read_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encodes_as_the_library(library):
    rnd = random.Random(1)
    some = ["", "   ", "a" * 5000, "ab" * 2000, " \n\t foo  bar\n\n \n x", "\x00 hi\x1c\x1d there", "don't we'll I'M", "!!??..,, a.,b,."]
    some += ["日本語 テスト　全角 x", "..foo,. bar.,", "<|endoftext|> x", "\x85  z  　 q\x1cq !\x1c!", "é combining é."]
    some += ["".join(rnd.choice("ab .,\n\t\x1c é1!'s<|>ß") for _ in range(rnd.randrange(80))) for _ in range(800)]
    some += ["".join(chr(rnd.randrange(32, 0x2100)) for _ in range(60)) for _ in range(200)]
    codec = DuckBPE(read_ranks(PATH), public_tokenizers.PATTERN)
    ids, counts = codec.encode(pa.array(some))
    decoded = codec.decode(ids, counts)
    end = 0
    for text, n, back in zip(some, counts.tolist(), decoded):
        assert ids[end : end + n].tolist() == library.encode_ordinary(text), text
        assert back == text.encode()
        end += n


def test_a_rank_order_that_merges_must_wait_for():
    # "abc" ranks below "ab": after one merge the next pair of the same rank has to wait
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4, b"cab": 5}
    ranks |= {bytes([i]): 10 + i for i in range(256) if bytes([i]) not in (b"a", b"b", b"c")}
    own = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec = DuckBPE(ranks, r"\S+|\s+")
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14))) for _ in range(300)]
    ids, counts = codec.encode_words(words)
    assert ids.tolist() == [x for w in words for x in own.encode_ordinary(w)]


def test_query(spark, sf, texts, library):
    rows = op1_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_and_round_trip(odd, odd_rows, empty, library):
    encoded = encode_documents(odd, PATH, public_tokenizers.PATTERN)
    got = sorted((r.ids for r in encoded.collect()), key=str)
    assert got == sorted((library.encode_ordinary(r[1] or "") for r in odd_rows), key=str)
    back = decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r[1] or "").encode() for r in odd_rows)
    assert round_trip(empty, PATH, public_tokenizers.PATTERN).collect() == []

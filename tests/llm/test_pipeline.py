import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm.quality import Judge
from tests_llm_helpers import base_masked, brute_kept, first_of_groups


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    judge = Judge()
    want = {i: r for i, r in rows.items() if judge(r["text"])[6]}
    found = corpus_pipeline.quality(spark, docs, sf)
    assert {r.doc_id for r in found.collect()} == set(want) and found.columns == docs.columns

    keep = first_of_groups({i: r["text"] for i, r in want.items()})
    found = corpus_pipeline.near_dedup(spark, corpus_pipeline.stage(found, "a"), sf)
    assert {r.doc_id for r in found.collect()} == keep and found.columns == docs.columns

    texts = brute_kept({i: rows[i]["text"] for i in keep})
    found = corpus_pipeline.repeats(spark, corpus_pipeline.stage(found, "b"), sf)
    got = {r.doc_id: r for r in found.collect()}
    assert {i: r.text for i, r in got.items()} == texts and found.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got.values())

    found = corpus_pipeline.private(spark, corpus_pipeline.stage(found, "c"), sf)
    got = {r.doc_id: r for r in found.collect()}
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    masked = {i: base_masked(t) for i, t in texts.items()}
    assert {i: r.text for i, r in got.items()} == masked

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    packed = corpus_pipeline.run(spark, sf).collect()
    totals = {}
    for r in packed:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == sizes


def test_stages_are_the_given_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "suffix-array dedup", "PII", "best-fit packing",
    ]


def test_pipeline_of_odd_and_no_rows(spark, odd, empty):
    for docs in (odd, empty):
        rows = docs
        for name, function in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.stage(function(spark, rows, ""), "odd")
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() >= (docs is odd)

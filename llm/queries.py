"""The registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from llm import dualtree, repair, suffix_dedup
from llm.bpe import op1_byte_bpe
from llm.classlm import op4_brown_class_lm
from llm.dualtree import op11_dual_tree_search
from llm.minhash import op2_minhash_fingerprints
from llm.packing import op7_best_fit_packing
from llm.pii import op5_private_data
from llm.quality import op6_quality_rules
from llm.repair import op13_conversation_repair
from llm.secrets_crf import op12_secret_scan
from llm.sharding import op9_hypergeometric_shards
from llm.simhash import op3_simhash_near_dedup
from llm.suffix_dedup import op10_suffix_dedup
from llm.wavelet import op8_wavelet_shards

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_minhash_fingerprints,
        op3_simhash_near_dedup,
        op4_brown_class_lm,
        op5_private_data,
        op6_quality_rules,
        op7_best_fit_packing,
        op8_wavelet_shards,
        op9_hypergeometric_shards,
        op10_suffix_dedup,
        op11_dual_tree_search,
        op12_secret_scan,
        op13_conversation_repair,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = {
    "op10_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op11_dual_tree_search": dualtree.ORACLE_SQL,
    "op13_conversation_repair": repair.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

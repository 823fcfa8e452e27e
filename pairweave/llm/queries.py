"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pairweave.llm.bpe import op11_byte_bpe
from pairweave.llm.bwt_dedup import op9_repeated_bytes
from pairweave.llm.compaction import OP8_SQL, op8_sharding
from pairweave.llm.decontam import OP10_SQL, op10_decontaminate
from pairweave.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from pairweave.llm.katz import op5_katz_scores
from pairweave.llm.langid import op4_language_id
from pairweave.llm.mixing import OP3_SQL, op3_mix_sources
from pairweave.llm.neardup import OP6_SQL, op6_near_duplicates
from pairweave.llm.quality_rules import OP1_SQL, op1_quality_rules
from pairweave.llm.sstable import op7_token_shards
from pairweave.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_language_id": op4_language_id,
    "op5_katz_scores": op5_katz_scores,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_shards": op7_token_shards,
    "op8_sharding": op8_sharding,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_decontaminate": op10_decontaminate,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_hard_negatives": op12_hard_negatives,
}

ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op3_mix_sources": OP3_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op8_sharding": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
}

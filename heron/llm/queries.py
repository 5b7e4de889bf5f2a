"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from heron.llm import html, negatives, resample, topk, warc
from heron.llm.chunks import op4_chunk_dedup
from heron.llm.neardup import op6_minhash
from heron.llm.packing import op2_packing
from heron.llm.pieces import op3_sentencepiece
from heron.llm.quality import op1_quality_rules
from heron.llm.sharding import op13_sharding
from heron.llm.suffix import op5_suffix_array
from heron.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_suffix_array": op5_suffix_array,
    "op6_minhash": op6_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_html": html.op8_html,
    "op9_warc": warc.op9_warc,
    "op10_topk": topk.op10_topk,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_sharding": op13_sharding,
}
ORACLES: dict[str, str] = {
    "op8_html": html.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_topk": topk.ORACLE,
    "op11_importance_resampling": resample.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}

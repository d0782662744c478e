"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from granary.llm import bpe, langid, linededup, neardup, packing, quality_model, quality_rules, sharding, spelling, topk, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_chunk_reuse_bpe": bpe.op1_chunk_reuse_bpe,
        "op2_line_windows": linededup.op2_line_windows,
        "op3_content_addressed_warc": warc.op3_content_addressed_warc,
        "op4_odd_sketch_neardup": neardup.op4_odd_sketch_neardup,
        "op5_ecoc_langid": langid.op5_ecoc_langid,
        "op6_mcd_rules": quality_rules.op6_mcd_rules,
        "op7_block_topk": topk.op7_block_topk,
        "op8_ftrl_quality": quality_model.op8_ftrl_quality,
        "op9_swap_packing": packing.op9_swap_packing,
        "op10_bounded_ring": sharding.op10_bounded_ring,
        "op11_toxic_grammar": toxicity.op11_toxic_grammar,
        "op12_aho_halves": spelling.op12_aho_halves,
        "op13_exact_whitening": whitening.op13_exact_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_windows": linededup.ORACLE_SQL,
        "op3_content_addressed_warc": warc.ORACLE_SQL,
        "op7_block_topk": topk.ORACLE_SQL,
    }

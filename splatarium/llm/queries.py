"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from . import attention_lm, bpe, chat_format, filter_audit, grammar_store, jaccard_join, line_dedup, ordinal_quality, periodic, quality_rules, source_mix, tiff, warc

QUERIES = {
    "op1_quality_divergence": quality_rules.op1_quality_divergence,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_repair_shards": grammar_store.op3_repair_shards,
    "op4_ordinal_quality": ordinal_quality.op4_ordinal_quality,
    "op5_tiff_pages": tiff.op5_tiff_pages,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_site_line_frequency": line_dedup.op7_site_line_frequency,
    "op8_chunked_bpe": bpe.op8_chunked_bpe,
    "op9_source_mix": source_mix.op9_source_mix,
    "op10_warc_transactions": warc.op10_warc_transactions,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_attention_lm": attention_lm.op12_attention_lm,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_divergence": quality_rules.OP1_SQL,
    "op2_chat_format": chat_format.OP2_SQL,
    "op6_ngram_jaccard_join": jaccard_join.OP6_SQL,
    "op7_site_line_frequency": line_dedup.OP7_SQL,
    "op9_source_mix": source_mix.OP9_SQL,
    "op10_warc_transactions": warc.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}

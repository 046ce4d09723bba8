"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from codeloom.llm import bpe, chat, crosspolytope, decontam, langid, lmscore, merkle, quality, simhash, spelling, suffixdedup, urlfilter, warc

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_url_filters": urlfilter.op3_url_filters,
    "op4_warc": warc.op4_warc,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_suffix_dedup": suffixdedup.op6_suffix_dedup,
    "op7_lm_scoring": lmscore.op7_lm_scoring,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_id": langid.op9_language_id,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_spelling": spelling.op11_spelling,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_nearest": crosspolytope.op13_nearest,
}

ORACLE_SQL = {"op1_decontamination": decontam.OP1_SQL, "op2_chat_formatting": chat.OP2_SQL, "op3_url_filters": urlfilter.OP3_SQL, "op4_warc": warc.OP4_SQL, "op6_suffix_dedup": suffixdedup.OP6_SQL, "op9_language_id": langid.OP9_SQL, "op10_quality_rules": quality.OP10_SQL, "op11_spelling": spelling.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL}

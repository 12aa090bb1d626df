"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from seqweft.llm import byte_bpe, exact_dedup, fixity, language_id, licenses, lm_score, media, mixing, pii, simhash

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_warc_fixity": fixity.op6_warc_fixity,
    "op7_pii": pii.op7_pii,
    "op8_media": media.op8_media,
    "op9_language_id": language_id.op9_language_id,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op1_licenses": licenses.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_warc_fixity": fixity.OP6_SQL,
}

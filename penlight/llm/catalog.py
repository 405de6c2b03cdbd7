"""The queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from penlight.llm import bpe, kd_search, language_id, lexical_search, mixing, ngram_join, pii, quality_crf, sharding, token_files, toxicity, vp_search, whitening

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_kd_search": kd_search.op2_kd_search,
    "op3_vp_search": vp_search.op3_vp_search,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": bpe.op5_bpe,
    "op6_pii": pii.op6_pii,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_sharding": sharding.op8_sharding,
    "op9_token_files": token_files.op9_token_files,
    "op10_quality_crf": quality_crf.op10_quality_crf,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_whitening": whitening.op12_whitening,
    "op13_toxicity": toxicity.op13_toxicity,
}

#: The other operators are models, searches or codecs that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = {
    "op2_kd_search": kd_search.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
}

"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprints, importance, line_dedup, mixing, near_dups, packing, quality, suffix_dedup, token_store, toxicity, warc, whitening

QUERIES = {
    "op1_fingerprint": fingerprints.op1_fingerprint,
    "op2_near_dups": near_dups.op2_near_dups,
    "op3_packing": packing.op3_packing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_token_store": token_store.op5_token_store,
    "op6_quality": quality.op6_quality,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc": warc.op9_warc,
    "op10_mix": mixing.op10_mix,
    "op11_importance": importance.op11_importance,
    "op12_bpe": bpe.op12_bpe,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {
    "op2_near_dups": near_dups.OP2_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_mix": mixing.OP10_SQL,
    "op11_importance": importance.OP11_SQL,
}

"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, language, packing, quality, simhash, token_files, warc, weighted_minhash

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_html_text": html_text.op4_html_text,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_fingerprints": weighted_minhash.op7_fingerprints,
    "op8_warc": warc.op8_warc,
    "op9_language_id": language.op9_language_id,
    "op10_quality": quality.op10_quality,
}

ORACLES = {"op2_exact_dedup": exact_dedup.SQL, "op8_warc": warc.SQL}

"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, brown, decontaminate, exact_dedup, fim, main_text, quality, resample, sanitise, simhash, token_files, toxicity, warc

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_quality": quality.query,
    "op3_decontaminate": decontaminate.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_brown": brown.query,
    "op6_toxicity": toxicity.query,
    "op7_warc": warc.query,
    "op8_sanitise": sanitise.query,
    "op9_main_text": main_text.query,
    "op10_simhash": simhash.query,
    "op11_fim": fim.query,
    "op12_token_files": token_files.query,
    "op13_resample": resample.query,
}

ORACLE = {"op4_exact_dedup": exact_dedup.ORACLE, "op7_warc": warc.ORACLE, "op11_fim": fim.ORACLE}

"""Queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from papyra.llm import chat, collocations, decontaminate, html, langid, minhash, packing, quality, simhash, substrings, tokenfile, toxicity, whitening


def queries() -> dict:
    return {
        "op1_language_id": langid.query,
        "op2_toxicity": toxicity.query,
        "op3_chat_format": chat.query,
        "op4_simhash": simhash.query,
        "op5_html_text": html.query,
        "op6_token_files": tokenfile.query,
        "op7_packing": packing.query,
        "op8_fingerprints": minhash.query,
        "op9_quality": quality.query,
        "op10_decontaminate": decontaminate.query,
        "op11_collocations": collocations.query,
        "op12_whitening": whitening.query,
        "op13_substring_dedup": substrings.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_decontaminate": decontaminate.ORACLE, "op11_collocations": collocations.ORACLE, "op13_substring_dedup": substrings.ORACLE}

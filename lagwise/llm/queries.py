"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import alignment, decontaminate, fuzzy_lines, linkrank, media, mixing, ngram_join, ordinal, simhash, spelling, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_link_trust": linkrank.query,
        "op2_ordinal_quality": ordinal.query,
        "op3_mixing": mixing.query,
        "op4_fuzzy_lines": fuzzy_lines.query,
        "op5_string_kernel_toxicity": toxicity.query,
        "op6_media_columns": media.query,
        "op7_warc": warc.query,
        "op8_simhash": simhash.query,
        "op9_decontamination": decontaminate.query,
        "op10_token_counts": token_counts.query,
        "op11_token_alignment": alignment.query,
        "op12_spelling_variants": spelling.query,
        "op13_ngram_join": ngram_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_link_trust": linkrank.oracle(),
        "op3_mixing": mixing.oracle(),
        "op7_warc": warc.oracle(),
        "op9_decontamination": decontaminate.oracle(),
    }

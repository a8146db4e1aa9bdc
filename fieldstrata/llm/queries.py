"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import archives, decontam, licenses, lines, mixing, neardup, pii, quality, runs, spelling, styletree, tokens, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        tokens.op1_token_blocks,
        licenses.op2_license_scan,
        pii.op3_pii_surrogates,
        decontam.op4_decontamination,
        archives.op5_arc_to_warc,
        mixing.op6_mix_sources,
        lines.op7_fuzzy_lines,
        neardup.op8_near_duplicates,
        toxicity.op9_toxicity,
        quality.op10_quality_rules,
        runs.op11_periodic_runs,
        spelling.op12_spelling_variants,
        styletree.op13_html_main_text,
    )
}

ORACLES = {"op5_arc_to_warc": archives.ORACLE, "op6_mix_sources": mixing.ORACLE}

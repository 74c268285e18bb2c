"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from annalist.llm import decontamination, html, jaccard, language, lexical, mixing, neighbours, packing, periodic, quality, suffixes, toxicity, warc

QUERIES = {
    "op1_language": language.op1_language,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_html": html.op9_html,
    "op10_packing": packing.op10_packing,
    "op11_lexical": lexical.op11_lexical,
    "op12_mixing": mixing.op12_mixing,
    "op13_periodic": periodic.op13_periodic,
}
ORACLES = {"op4_decontamination": decontamination.ORACLE, "op5_warc": warc.ORACLE, "op11_lexical": lexical.ORACLE, "op12_mixing": mixing.ORACLE}

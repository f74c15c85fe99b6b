"""Every query of this subpackage, and its SQL where SQL can express it."""

from . import (
    op1_prefix_fingerprints,
    op2_secret_scan,
    op3_mixing,
    op4_simhash,
    op5_toxicity,
    op6_suffix_dedup,
    op7_automaton_dedup,
    op8_bpe,
    op9_language_mixture,
    op10_png_media,
)

MODULES = (
    op1_prefix_fingerprints,
    op2_secret_scan,
    op3_mixing,
    op4_simhash,
    op5_toxicity,
    op6_suffix_dedup,
    op7_automaton_dedup,
    op8_bpe,
    op9_language_mixture,
    op10_png_media,
)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}

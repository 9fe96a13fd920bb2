"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, host_rules, length_histogram, line_index, nbest_pieces, ngram_join, pii, quality, relative_lz, token_files


def queries():
    return {
        "op1_contextual_pii": pii.op1_query,
        "op2_relative_lz": relative_lz.op2_query,
        "op3_quality_discriminant": quality.op3_query,
        "op4_ngram_join": ngram_join.op4_query,
        "op5_template_leaks": decontaminate.op5_query,
        "op6_line_dedup": line_index.op6_query,
        "op7_length_histogram": length_histogram.op7_query,
        "op8_host_rules": host_rules.op8_query,
        "op9_nbest_pieces": nbest_pieces.op9_query,
        "op10_token_files": token_files.op10_query,
    }


def oracle_sql():
    return {"op2_relative_lz": relative_lz.OP2_SQL, "op6_line_dedup": line_index.OP6_SQL, "op8_host_rules": host_rules.OP8_SQL}

"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, language, line_dedup, near_dup, neighbours, quality, secrets, warc

QUERIES = {
    "op1_near_dup": near_dup.op1_near_dup,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_html_text": html_text.op3_html_text,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality": quality.op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_language_id": language.op9_language_id,
    "op10_secrets": secrets.op10_secrets,
}

ORACLES = {
    "op4_decontamination": decontaminate.ORACLE_OP4,
    "op6_line_dedup": line_dedup.ORACLE_OP6,
    "op8_warc": warc.ORACLE_OP8,
    "op10_secrets": secrets.oracle_op10(),
}

"""The queries of this subpackage, for the driver."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import class_lm, decontaminate, html_text, near_dedup, pieces, pii, pu_quality, repetition, tool_calls, warc


def queries() -> dict[str, Callable]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontamination": decontaminate.query,
        "op2_sentencepiece": pieces.query,
        "op3_pii": pii.query,
        "op4_warc": warc.query,
        "op5_near_dedup": near_dedup.query,
        "op6_class_lm": class_lm.query,
        "op7_pu_quality": pu_quality.query,
        "op8_tool_calls": tool_calls.query,
        "op9_repetition_rules": repetition.query,
        "op10_html_extraction": html_text.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE, "op4_warc": warc.ORACLE, "op8_tool_calls": tool_calls.ORACLE}

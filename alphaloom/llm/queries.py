"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alphaloom.llm import bpe, chat, decontaminate, html_text, line_dedup, near_dedup, pii, quality_rules, runs, substring_dedup, token_files, url_filters, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1,
        "op2_pii": pii.op2,
        "op3_substring_dedup": substring_dedup.op3,
        "op4_quality_rules": quality_rules.op4,
        "op5_html_text": html_text.op5,
        "op6_token_files": token_files.op6,
        "op7_bpe": bpe.op7,
        "op8_url_filters": url_filters.op8,
        "op9_chat_perspectives": chat.op9,
        "chat_dialogues": chat.chat_dialogues,
        "op10_minhash_near_dedup": near_dedup.op10,
        "op11_embedding_whitening": whitening.op11,
        "op12_periodic_runs": runs.op12,
        "op13_line_dedup": line_dedup.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": url_filters.OP8_SQL, "op9_chat_perspectives": chat.OP9_SQL, "chat_dialogues": chat.DIALOGUES_SQL}

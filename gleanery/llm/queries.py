"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import chat, decontaminate, fim, html_text, jaccard, licenses, lines, mixing, negatives, pii, quality, spans, tokens
from gleanery.session import new_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict[str, Query] = {
    "op1_decontaminate": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op2_html_text": lambda s, d: html_text.extract(table(s, d, "pages")),
    "op3_jaccard_join": lambda s, d: jaccard.report(table(s, d, "documents")),
    "op4_mix_sources": lambda s, d: mixing.report(table(s, d, "documents")),
    "op5_sentence_spans": lambda s, d: spans.report(table(s, d, "documents")),
    "op6_token_files": lambda s, d: tokens.report(table(s, d, "documents"), new_path(s, "tokens"), tokenizer_path()),
    "op7_license_scan": lambda s, d: licenses.scan(table(s, d, "documents"), licenses.known_texts(s)),
    "op8_quality_rules": lambda s, d: quality.report(table(s, d, "documents")),
    "op9_line_dedup": lambda s, d: lines.report(table(s, d, "documents")),
    "op10_tool_calls": lambda s, d: chat.report(table(s, d, "conversations")),
    "op11_fill_in_middle": lambda s, d: fim.report(table(s, d, "documents")),
    "op12_hard_negatives": lambda s, d: negatives.report(table(s, d, "embeddings")),
    "op13_personal_data": lambda s, d: pii.report(table(s, d, "documents")),
}
ORACLES: dict[str, str] = {"op7_license_scan": licenses.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op12_hard_negatives": negatives.ORACLE}

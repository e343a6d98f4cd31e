"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from skarn.llm.fm_index import op3_decontamination
from skarn.llm.pieces import op4_pieces
from skarn.llm.quality import op10_quality
from skarn.llm.secrets_scan import op7_secrets
from skarn.llm.simhash import op9_simhash
from skarn.llm.token_counts import op1_token_counts
from skarn.llm.token_files import op2_token_files
from skarn.llm.toxicity import op8_toxicity
from skarn.llm.url_filter import OP6_SQL, op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_token_files": op2_token_files,
    "op3_decontamination": op3_decontamination,
    "op4_pieces": op4_pieces,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op6_url_filter": OP6_SQL}

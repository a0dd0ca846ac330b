"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.audio import op9_telephony
from quire.llm.chat import op2_chat_format
from quire.llm.decontam import OP8_SQL, op8_decontamination
from quire.llm.jaccard import op7_jaccard_join
from quire.llm.langid import op3_language_id
from quire.llm.packing import op5_packing
from quire.llm.secrets import op10_secret_scan
from quire.llm.substring import op4_substring_dedup
from quire.llm.tokens import op6_token_ids
from quire.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_token_ids": op6_token_ids,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontamination": op8_decontamination,
    "op9_telephony": op9_telephony,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {"op8_decontamination": OP8_SQL}

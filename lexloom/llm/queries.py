"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import chat, decontaminate, embeddings, licenses, urls, warc
from lexloom.llm.bpe import op7_bpe
from lexloom.llm.chat import op4_chat_format
from lexloom.llm.decontaminate import op9_decontaminate
from lexloom.llm.embeddings import op8_embedding_dedup
from lexloom.llm.simhash import op1_simhash_dedup
from lexloom.llm.store import op6_token_store
from lexloom.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_warc": warc.op3_warc,
        "op4_chat_format": op4_chat_format,
        "op5_url_filter": urls.op5_url_filter,
        "op6_token_store": op6_token_store,
        "op7_bpe": op7_bpe,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_decontaminate": op9_decontaminate,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.oracle_sql(),
        "op3_warc": warc.oracle_sql(),
        "op4_chat_format": chat.oracle_sql(),
        "op5_url_filter": urls.oracle_sql(),
        "op8_embedding_dedup": embeddings.oracle_sql(),
        "op9_decontaminate": decontaminate.oracle_sql(),
    }

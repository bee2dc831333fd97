"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, conversation_repair, embedding_join, fill_in_middle, fingerprints, language_id, mixing, multi_index, ngram_join, sentencepiece_scan, sharding, suffix_dedup, url_filter
from .common import fewer



def result(f: Callable[[SparkSession, str], DataFrame], table: str) -> Callable[[SparkSession, str], DataFrame]:
    """f, whose rows are left in as many files as its table is large: many small ones would cost more than they spread."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fewer(f(spark, sf_dir), spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return run


#: What the queries read, where it isn't documents.
TABLES = {"op2_url_filter": "pages", "op6_embedding_near_dedup": "embeddings", "op9_chat_format": "conversations", "op12_multi_index": "embeddings", "op13_conversation_repair": "conversations"}
QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_language_id": language_id.op3_language_id,
    "op4_sharding": sharding.op4_sharding,
    "op5_mixing": mixing.op5_mixing,
    "op6_embedding_near_dedup": embedding_join.op6_embedding_near_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_sentencepiece": sentencepiece_scan.op8_sentencepiece,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_multi_index": multi_index.op12_multi_index,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
QUERIES = {name: result(f, TABLES.get(name, "documents")) for name, f in QUERIES.items()}
ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_embedding_near_dedup": embedding_join.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}

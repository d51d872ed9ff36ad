"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cuesheet.llm import chat, decontam, extract, langid, mixing, neardup, neighbours, periods, pii, repair, shards, tokens, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokens.read_model())


def op2_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = chat.as_records(rows.unionByName(chat.probe(spark)))
    return chat.format_conversations(records).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        "loss_chars",
        "loss_sha256",
        "formatted_chars",
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op5_contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontam.contaminated(docs, benchmark).drop("key")


def op6_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(_table(spark, sf_dir, "pages"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(_table(spark, sf_dir, "pages")))


def op8_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(_table(spark, sf_dir, "documents"))


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return periods.run_digests(periods.with_planted_runs(docs))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_format_conversations": op2_format_conversations,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_mix_documents": op4_mix_documents,
        "op5_contaminated_documents": op5_contaminated_documents,
        "op6_extract_main_text": op6_extract_main_text,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_identify_language": op8_identify_language,
        "op9_shard_documents": op9_shard_documents,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_repair_conversations": op11_repair_conversations,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_personal_data": op13_personal_data,
        "pipeline": corpus_pipeline.run,
    }

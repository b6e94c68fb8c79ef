"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapter import spread
from . import chat, decontaminate, minhash, oracles, packing, quality, sharding, substring, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), urls.build(urls.rules_frame(spark)))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.with_tools(_read(spark, sf_dir, "conversations"))).withColumn("problems", F.concat_ws("; ", "problems"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(_read(spark, sf_dir, "documents")))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ledger: what each rule rejects, what only it rejects, and what stays without it."""
    return quality.ablations(quality.ledger(_read(spark, sf_dir, "documents")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity_mil,
        op2_extendible_sharding,
        op3_substring_dedup,
        op4_url_filter,
        op5_best_fit_packing,
        op6_warc_round_trip,
        op7_chat_format,
        op8_minhash_near_dedup,
        op9_quality_ledger,
        op10_benchmark_decontamination,
        pipeline,
        quality_ablations,
    )
}
#: Trained scores (op1) and tokenizer ids (op5, pipeline) are beyond SQL; they are held against brute force in tests.
ORACLES: dict[str, str] = {
    "op2_extendible_sharding": sharding.ORACLE,
    "op3_substring_dedup": oracles.SUBSTRING,
    "op4_url_filter": urls.ORACLE,
    "op6_warc_round_trip": warc.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op8_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op9_quality_ledger": quality.ORACLE,
    "quality_ablations": quality.ABLATIONS,
    "op10_benchmark_decontamination": oracles.CONTAINED,
}

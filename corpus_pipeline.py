"""A corpus pipeline: toxic documents go, near copies go, repeated passages go, contaminated documents
go, and what is left is packed. Each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, minhash, packing, substring, toxicity
from cairn.llm._shared import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.3 or more. Labels are learned from the documents of this stage."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: its least id, and of the rows with that id the least. Rows with a null id all stay."""
    made = cut(minhash.near_duplicates(docs), "near")
    gone = made.where("not kept").select("doc_id").distinct()
    repeated = cut(made.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    once = docs.join(gone.union(repeated), "doc_id", "left_anti").select(docs.columns)
    # inner names, so that no column can clash; a min is pre-aggregated, however often an id occurs
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = names[docs.columns.index("doc_id")]
    many = docs.toDF(*names).join(repeated.withColumnRenamed("doc_id", key), key, "left_semi")
    least = many.groupBy(key).agg(F.min(F.struct(*names)).alias("row")).select("row.*").toDF(*docs.columns)
    return once.union(least)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document has; n_chars, where there is one, follows the text."""
    return substring.cut_repeats(docs, chars_col="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item to 80 % of its five-word shingles."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row for each piece."""
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores and tokenizer ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None

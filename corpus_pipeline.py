"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, tokens."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import bpe, decontam, neardup, pii, quality
from gridmill.llm.common import ARROW_BYTES, cut, small_batches


#: Bytes of keys that may be broadcast, so that texts stay where they are; beyond it a shuffled join drops them.
BROADCAST_BYTES = 32 << 20


def bounded(stage):
    """A stage whose Arrow batches are small. Its result is lazy, so the session keeps the setting; :func:`run` sets it back."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ARROW_BYTES, str(8 << 20))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more. It learns from the labelled rows of the documents it is given."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


@bounded
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: of the rows with the smallest doc_id, the least by its columns. Rows without a doc_id stay."""
    found = cut(neardup.near_duplicates(docs).select("doc_id", "kept").where("doc_id is not null"), "found")
    gone = cut(found.where("not kept").select("doc_id").distinct(), "gone")
    small = gone.count() * 16 <= BROADCAST_BYTES
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)
    again = cut(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


@bounded
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the new text."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@bounded
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every document."""
    return bpe.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("tokens", to_tokens),
]

#: The stages are a trained model, MinHash, alignment, a keyed permutation and a tokenizer; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next; the last one's rows as written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs

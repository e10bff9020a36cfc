"""From raw documents to a training order of token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and
returns a DataFrame; what it returns is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.llm import bpe, jaccard, line_templates, mixing, quality
from failcast.scratch import discard, materialize

#: Texts can be long, so Arrow batches are kept to few rows.
ARROW_ROWS = "1000"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field accept; the field is trained on ``labels``."""
    _batches(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; n_chars follows the text."""
    made = line_templates.without_repeated_lines(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else made


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity of 0.8 or more over five-word shingles."""
    _batches(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: documents in training order, as often as their source's target asks for."""
    _batches(spark)
    return mixing.training_order(docs).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), their number, and whether they decode to the text."""
    _batches(spark)
    path = tokenizer_path()
    made = bpe.with_decoded(bpe.with_tokens(docs, path), path)
    return made.select("doc_id", "lang", "source", F.col("n_tokens").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality rules", keep_good), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", keep_one_of_each),
          ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", to_tokens)]

#: SQL can express neither the line field nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
        if before is not None:
            discard(before)  # nothing reads it any more
        before = docs
    return docs

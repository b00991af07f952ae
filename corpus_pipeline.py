"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it and rereads it as the
next one's docs. All but the last return the columns of ``documents``; the last has doc_id, lang, source, n_chars and the
tokens.

Defined results: null texts count as empty; rows of a null id go through every stage but are neither deduplicated nor
searched; repeated rows are treated alike up to the near duplicates, where rows of one id share their fate; empty tables
give empty results; extra columns of any name pass through all stages but the last; n_chars follows the text where there is such a column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import byte_bpe, decontaminate, line_dedup, minhash_dedup, quality_classifier
from meterlake.llm.spark_tools import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (score below 0.5)."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the later of matching lines out of the texts; n_chars follows the text."""
    aside = {c: f"__{c}" for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed(aside), min_words=1).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in aside.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80, bands=32, rows_per_band=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts, decode the ids, and say whether the bytes came back."""
    kept = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    hashed = docs.select(*kept, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    back = byte_bpe.encode(hashed, TOKENIZER, PATTERN, decoded=True)
    return back.select(*kept, "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("bpe", tokens)]

#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents to training tokens, in stages that each write a table the next one reads."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import decontamination, line_dedup, ngram_jaccard, piece_sampling, toxicity
from tablescope.operators.order import shared_folder

PIECES = os.path.join(os.environ.get("TOKENIZER_FILES", "/opt/tokenizers"), "piece_bpe_32k.model")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; a document that loses all its lines with words goes with them. ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs)
    done = done.where("NOT (n_removed > 0 AND trim(BOTH '\\n\\t ' FROM text) = '')")
    if "n_chars" in docs.columns:
        done = done.selectExpr(*["CAST(length(text) AS bigint) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])
    return done.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_jaccard.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item go."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, checked by decoding."""
    return piece_sampling.encode(docs, PIECES)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_passages),
    ("piece_sampling", encode),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

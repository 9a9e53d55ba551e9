"""The queries of this subpackage on the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm import conversation_repair, decontamination, html_text, line_dedup, multiset_hash, ngram_jaccard, piece_sampling, secrets_crf, source_divergence, token_counts, top_products, toxicity, wavelet
from tablescope.operators.order import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


#: Where the public tokenizer files are.
TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_crf.secrets(_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, folder, "documents"))
    return done.select("doc_id", "text", "n_lines", "n_removed")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat token files of all documents, scanned; documents are told by their place, files being written in table order."""
    path = f"{shared_folder(spark).rstrip('/')}/flat-{uuid.uuid4().hex}"
    docs = _table(spark, folder, "documents")
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as file:
        token_counts.write_flat(docs, path, file.read())
    places = docs.select("doc_id", F.monotonically_increasing_id().alias("place"))
    places = places.select("doc_id", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = places.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    ranks = places.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("row")).alias("doc_no"))
    return token_counts.token_counts(spark, path).join(ranks, "doc_no", "left").select("doc_id", "doc_no", "start", "n_tokens")


def op5_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return piece_sampling.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


def op6_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as file:
        wavelet.write_ids(_table(spark, folder, "documents"), path, file.read())
    return wavelet.read_documents(spark, path)


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def op8_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.edited_fingerprints(_table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, folder, "documents"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergences(_table(spark, folder, "documents"))


def op12_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return top_products.top_products(_table(spark, folder, "embeddings"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damaged(_table(spark, folder, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(rows, present="present"))


_ALL = (
    op1_secrets,
    op2_decontamination,
    op3_line_dedup,
    op4_token_counts,
    op5_piece_sampling,
    op6_wavelet,
    op7_html_text,
    op8_multiset_hash,
    op9_toxicity,
    op10_ngram_jaccard,
    op11_source_divergence,
    op12_top_products,
    op13_conversation_repair,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op11_source_divergence": source_divergence.SQL, "op12_top_products": top_products.SQL}

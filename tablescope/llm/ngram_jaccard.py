"""N-gram Jaccard join of documents (operator 10), by set relations.

A document's set is its distinct five-word shingles over lower-cased words; with fewer words, all of
them as one; without words, empty. Documents link when 100 * overlap >= 80 * union, exactly. Index
lists are kept by position so that blocks which cannot reach the overlap are skipped, and a document
very similar to the first one of a list takes its answer from that one (see ``setjoin``).

Defined cases: a missing text is empty; empty documents link with nothing and are their own component;
equal texts and repeated rows share a component; rows with a missing id are kept, with the smallest
known id of their component, or none. Only the id and the text column are looked at; others may have any name.
Two different sets share a 64-bit id with a chance of N^2 / 2^65 for N distinct texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import gram_hashes, sorted_sets, words
from tablescope.llm.components import components
from tablescope.llm.setjoin import Join, links
from tablescope.llm.sides import counted, row_key, spare


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The set of each text of a piece, in the form ``setjoin`` takes."""
    _, _, hashes, firsts = words(data, offsets, folded=True)
    values, bounds = sorted_sets(*gram_hashes(hashes, firsts, 5))
    rows = np.arange(len(offsets) - 1)
    return values, bounds, rows, np.zeros(len(rows), np.int64)


def _place(doc_id: str = "doc_id", row: str = "row"):
    """What orders documents: the id, a missing one last, then the row key."""
    return F.struct(F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("doc"), F.col(doc_id).isNull().alias("missing"), F.col(row).alias("row"))


def _grouped(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per document (doc_id, row, n_shingles, smallest): size of its set and first place in its component, if that has several documents."""
    pairs = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), row_key(id_column, text_column).alias("row")
    )
    surveyed, linked = links(pairs, Join(shingle_sets, signature=True))
    rows = surveyed.where("kind = 0").select("doc_id", "row", F.col("id").alias("set_id"), F.col("n").cast("long").alias("n_shingles"))
    groups = components(linked).withColumnRenamed("node", "set_id")
    filled = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min(_place()).alias("least"), F.count(F.lit(1)).alias("copies"))
    filled = filled.join(groups, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = filled.groupBy("component").agg(F.min("least").alias("smallest"), F.sum("copies").alias("rows"))
    shared = filled.join(least.where("rows > 1"), "component").select("set_id", "smallest")
    return rows.join(shared, "set_id", "left").select("doc_id", "row", "n_shingles", "smallest")


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document (doc_id, n_shingles, component_id): size of its set and smallest id that links reach."""
    known = F.when(~F.col("smallest.missing"), F.col("smallest.doc"))
    return _grouped(docs, id_column, text_column).select("doc_id", "n_shingles", F.coalesce(known, "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first document of each component: the one with the smallest id, a missing id last, and of different texts that
    share an id or have none the one with the smallest hash. Repeated rows (same id and text) go or stay together."""
    name = spare(docs, "_gone")
    gone = _grouped(docs, id_column, text_column).where(F.col("smallest") < _place()).select(F.col("row").alias(name)).distinct()
    return docs.join(counted(gone), row_key(id_column, text_column) == F.col(name), "left_anti")

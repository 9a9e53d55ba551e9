"""Line dedup (operator 3): an exact set-similarity join of lines.

A line is the set of its lower-cased words. Words are ordered by rarity over all lines; prefix,
positional, length and parity-bitmap filters choose pairs, whose Jaccard similarity is then
verified on the sets. A line goes if its words equal those of a line before it, or if their similarity with a line before
it is 0.8 or more; before means a smaller (doc_id, line number), a missing id last, and a smaller hash where different texts share an id or have none.
The line before may itself be removed.

Defined cases: a missing text stays missing; lines without a word are never compared and stay; a text whose
every line with words goes becomes empty. Rows with the same id and text count as one document, so repeated rows
get the same text; rows that only share an id, or have none, are decided each by itself. Extra columns pass through; columns
``n_lines`` and ``n_removed`` of the input are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import sorted_sets, words
from tablescope.llm.setjoin import Join, first_places, links
from tablescope.llm.sides import release, row_key, spare


def line_sets(data: np.ndarray, offsets: np.ndarray):
    """The set of words of each line of a piece, in the form ``setjoin`` takes."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    units = np.arange(len(rows)) - np.searchsorted(rows, rows)
    _, _, hashes, firsts = words(data, np.append(starts, len(data)), folded=True)
    values, bounds = sorted_sets(hashes, firsts)
    return values, bounds, rows, units


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with later similar lines removed from the text, and added ``n_lines`` and ``n_removed``."""
    key = row_key(id_column, text_column)
    keyed, own, gone_lines = (spare(docs, name) for name in ("_key", "_own", "_gone"))
    pairs = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), key.alias("row"))
    surveyed, later = links(pairs, Join(line_sets, bitmap=True, sketch_bits=23, skip_single=True, only_earlier=True))
    release(docs.sparkSession)  # the joins' shuffles, before the texts are moved
    decided = first_places(surveyed).join(later.withColumn("later", F.lit(True)), "id", "left").where("later OR rows > 1")
    decided = decided.select("id", F.col("row").alias("first_row"), F.col("place.unit").alias("first_unit"), "later")
    gone = (
        surveyed.where("kind = 0")
        .join(decided, "id")
        .where("coalesce(later, false) OR row != first_row OR unit != first_unit")
        .groupBy(F.col("row").alias(own))
        .agg(F.collect_set("unit").alias(gone_lines))
    )
    text = F.col(f"`{text_column}`")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone_lines, i))
    done = docs.withColumn(keyed, key).join(gone.hint("shuffle_hash"), F.col(keyed) == F.col(own), "left")
    new = F.when(F.col(gone_lines).isNull(), text).otherwise(F.array_join(kept, "\n"))
    return done.select(
        *[new.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(text.isNotNull(), F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0).alias("n_lines"),
        F.coalesce(F.size(gone_lines), F.lit(0)).alias("n_removed"),
    )

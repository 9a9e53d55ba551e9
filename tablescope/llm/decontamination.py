"""Benchmark decontamination (operator 2): greedy string tiling of documents with test items.

Runs of ``min_match`` words that an item and a document share are the seeds. Of each document and item with a
seed, the longest match that touches no marked word on either side is marked, again and again, until no match of
``min_match`` words is left; matches grow from seeds by Karp-Rabin hashes of words. The share of an
item's words that tiles cover is its coverage, whatever their order in the document.

Items are taken in blocks of bounded size, each sent to the tasks; documents are only scanned, never shuffled, so a
passage in many documents weighs on no single task.

Defined cases: missing or empty texts and items match nothing; an item shorter than ``min_match``
words must be there whole; repeated rows give repeated results; equal lengths are tiled from the left of the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import give_back, gram_hashes, pieces, ranges, words
from tablescope.llm.sides import counted, received, row_key, shared, spare

BLOCK_CHARS = 16 << 20
_FILTER_BITS = 22


@dataclass(frozen=True)
class Seeds:
    """Runs of words of one length in the items, ordered by their hash and then by that of the run one word before."""

    grams: np.ndarray  # different hashes, sorted
    before: np.ndarray  # different hashes of runs one word before, sorted; none counts as 0
    key: np.ndarray  # number of the hash and number of the one before, of every run, sorted
    owner: np.ndarray  # item of every run
    place: np.ndarray  # its place in it
    near: np.ndarray  # a filter of hashes
    every: np.ndarray  # hashes of all runs in order of items
    bounds: np.ndarray  # where each item's begin, and the end


@dataclass(frozen=True)
class Items:
    """Words of a block of items, and their seeds by length."""

    ids: list
    tokens: np.ndarray
    firsts: np.ndarray
    seeds: dict[int, Seeds]


def index_items(rows: list, min_match: int) -> Items:
    texts = pa.array([r["text"] for r in rows], pa.large_string())
    tokens, counts = [np.zeros(0, np.uint64)], []
    for _, _, data, offsets in pieces(texts):
        _, _, hashes, firsts = words(data, offsets, folded=True)
        tokens.append(hashes)
        counts.append(np.diff(firsts))
    tokens = np.concatenate(tokens)
    counts = np.concatenate([*counts, np.zeros(0, np.int64)])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    seeds = {}
    for size in range(1, min_match + 1):
        use = np.flatnonzero(counts == size) if size < min_match else np.flatnonzero(counts >= size)
        if not len(use):
            continue
        grams, bounds = gram_hashes(tokens, firsts, size, whole_if_short=False)
        n = bounds[use + 1] - bounds[use]
        at = ranges(bounds[use], n)
        owner, place = np.repeat(use, n), ranges(np.zeros(len(use), np.int64), n)
        near = np.zeros(1 << _FILTER_BITS, bool)
        near[(grams[at] & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        previous = np.where(place > 0, grams[np.maximum(at - 1, 0)], np.uint64(0))
        kinds, gram_of = np.unique(grams[at], return_inverse=True)
        earlier, before_of = np.unique(previous, return_inverse=True)
        key = gram_of.astype(np.int64) * (len(earlier) + 1) + before_of
        order = np.argsort(key, kind="stable")
        seeds[size] = Seeds(kinds, earlier, key[order], owner[order], place[order], near, grams, bounds)
    return Items([r["item_id"] for r in rows], tokens, firsts, seeds)


def tiles(doc: np.ndarray, item: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray, runs: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the document, place in the item) from runs of seeds of ``size`` words."""
    heap = [(-(n + size - 1), d, i) for n, d, i in zip(runs.tolist(), doc_at.tolist(), item_at.tolist())]
    heapq.heapify(heap)
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = ~(used_doc[d : d + n] | used_item[i : i + n]) & (doc[d : d + n] == item[i : i + n])
        if free.all():
            used_doc[d : d + n] = True
            used_item[i : i + n] = True
            found.append((n, d, i))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= size:
                heapq.heappush(heap, (a - b, d + a, i + a))
    return found


def _matches(items: Items, hashes: np.ndarray, firsts: np.ndarray, size: int):
    """Runs of document grams that are an item's: document, place in it, item, place in it, grams; ordered by document and item.

    Only their beginnings are looked up: a gram meets the item grams of its hash that follow another gram than it does.
    """
    s = items.seeds[size]
    grams, bounds = gram_hashes(hashes, firsts, size, whole_if_short=False)
    at = np.flatnonzero(s.near[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    kind = np.minimum(np.searchsorted(s.grams, grams[at]), len(s.grams) - 1)
    known = s.grams[kind] == grams[at]
    at, kind = at[known], kind[known]
    doc = np.searchsorted(bounds, at, "right") - 1
    first = at == bounds[doc]
    previous = grams[np.maximum(at - 1, 0)]
    number = np.minimum(np.searchsorted(s.before, previous), len(s.before) - 1)
    same = (s.before[number] == previous) & ~first
    base = kind.astype(np.int64) * (len(s.before) + 1)
    low, high = np.searchsorted(s.key, base), np.searchsorted(s.key, base + len(s.before), "right")
    cut = np.where(same, np.searchsorted(s.key, base + number), high)
    rest = np.where(same, np.searchsorted(s.key, base + number, "right"), high)
    seed = np.concatenate([ranges(low, cut - low), ranges(rest, high - rest)])
    gram = np.concatenate([np.repeat(at, cut - low), np.repeat(at, high - rest)])
    doc = np.concatenate([np.repeat(doc, cut - low), np.repeat(doc, high - rest)])
    item, place = s.owner[seed], s.place[seed]
    runs = np.ones(len(seed), np.int64)
    open_, there = np.arange(len(seed)), s.bounds[item] + place
    while len(open_):  # a step for each gram of the longest run
        d, i = gram[open_] + runs[open_], there[open_] + runs[open_]
        inside = (d < bounds[doc[open_] + 1]) & (i < s.bounds[item[open_] + 1])
        open_, d, i = open_[inside], d[inside], i[inside]
        open_ = open_[grams[d] == s.every[i]]
        runs[open_] += 1
    order = np.lexsort((place, gram, item, doc))
    doc, gram, item, place, runs = (x[order] for x in (doc, gram, item, place, runs))
    return doc, gram - bounds[doc], item, place, runs


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    min_match: int = 5,
    coverage: float = 0.5,
) -> DataFrame:
    """One row per document and item covered to ``coverage`` or more:
    (doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile)."""
    items = benchmark.select(F.col(f"`{item_column}`").cast("long").alias("item_id"), F.col(f"`{item_text_column}`").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_words int, covered_words int, coverage double, n_tiles int, longest_tile int"
    found = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        index = shared(docs.sparkSession, index_items(rows, min_match))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            give_back()
            items = received(index)
            for batch in batches:
                out = []
                ids = batch.column(0)
                for first, _, data, offsets in pieces(batch.column(1)):
                    _, _, hashes, firsts = words(data, offsets, folded=True)
                    for size in items.seeds:
                        doc, doc_at, item, item_at, runs = _matches(items, hashes, firsts, size)
                        cuts = np.flatnonzero(np.concatenate([[len(doc) > 0], (np.diff(doc) != 0) | (np.diff(item) != 0)])[: len(doc)])
                        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(doc)).tolist()):
                            d, i = doc[a], item[a]
                            tokens = items.tokens[items.firsts[i] : items.firsts[i + 1]]
                            got = tiles(hashes[firsts[d] : firsts[d + 1]], tokens, doc_at[a:b], item_at[a:b], runs[a:b], size)
                            covered = sum(t[0] for t in got)
                            if covered >= coverage * len(tokens):
                                out.append((ids[int(first + d)].as_py(), items.ids[i], len(tokens), covered, covered / len(tokens), len(got), max(t[0] for t in got)))
                columns = list(zip(*out)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

        part = texts.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that cover no item; each row is decided by its own text."""
    row, name = row_key(id_column, text_column), spare(docs, "_gone")
    keyed = docs.select(row.alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    gone = counted(contaminated(keyed, benchmark, **options).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, row == F.col(name), "left_anti")

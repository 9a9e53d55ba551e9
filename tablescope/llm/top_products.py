"""Exact top-k search (operator 12): the largest inner products, from vectors bucketed by length.

Vectors are ordered by length and cut into buckets of neighbouring lengths. The product of a query q with a vector
of a bucket is at most |q| times the greatest length in it, so with a lower bound b of the query's k-th product only
vectors whose cosine with q is b / (|q| * greatest length) or more matter: the bucket's local threshold. Above 1 the
whole bucket is skipped. A high threshold leaves narrow ranges for each coordinate of the normalised vector, and the
vectors in the ranges of q's largest coordinates are looked up in sorted coordinate lists; a low one leaves only the bound on
length, so a leading run of the bucket is taken. What remains is multiplied out in whole numbers.

The bounds start from a few buckets picked by a hash, which every block of queries is held against first, and rise as
buckets are done. Query blocks then meet the buckets in cells: a cell has a fixed number of queries at most in memory and
streams its buckets past them. Cells give their candidates, at most k a query, to a final ranking.

Components are floor(scale * x). Defined cases: vectors that are missing, or hold a missing or non-finite component,
take no part; products are only formed between vectors of one dimension, so a vector of no components has product 0
with others like it; ties go to the smaller id, a missing id last; rows that share an id are vectors of their own, each a query of its own
if the id is one, and only the query's own row is left out; a product beyond 64 bits is ranked exactly and given as the nearest 64-bit
number; a component too large to be scaled counts as non-finite; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.sides import received, shared
from tablescope.operators.order import materialize

BUCKET = 2048  # vectors of a bucket at most
QUERIES = 512  # queries multiplied at once
START = 8  # buckets every query is held against first
CELL_BYTES = 96 << 20  # queries of a cell
CELL_VECTORS = 1 << 19  # vectors that stream past them, roughly
COORDINATES_FROM = 0.8  # local thresholds from which coordinate lists are used
FOCUS = 3  # coordinates looked at
EXACT = float(1 << 53)
LARGE = 10**300

_PACKED = "cell int, kind int, width int, length double, ids binary, rows binary, lengths binary, bounds binary, vectors binary"
_NO_ID = np.iinfo(np.int64).max


def _vectors(df: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    x = F.col(f"`{vector_column}`").cast("array<double>")
    known = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v * scale) < F.lit(float("inf"))))
    return known.where(F.col("x").isNotNull() & finite)


def _matrix(column: pa.ListArray, width: int, scale: float) -> np.ndarray:
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)


def _block(cell: int, kind: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> dict:
    return {
        "cell": cell, "kind": kind, "width": vectors.shape[1], "length": float(lengths.max(initial=0.0)), "ids": ids.tobytes(), "rows": rows.tobytes(),
        "lengths": lengths.tobytes(), "bounds": bounds.tobytes(), "vectors": vectors.tobytes(),
    }


class _Block:
    def __init__(self, row: dict):
        self.width = row["width"]
        self.ids, self.rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        self.lengths, self.bounds = np.frombuffer(row["lengths"], np.float64), np.frombuffer(row["bounds"], np.float64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), self.width)


def packed(numbered: DataFrame, scale: float, kind: int, size: int, copies: int | None = None) -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension, from rows (id, row, x) in order of falling length.

    With ``copies``, a block keeps that many of equal vectors, those with the smallest ids: no more can be among
    the ``copies`` - 1 best of a query besides its own row.
    """
    schema = _arrow_schema()
    length = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    ordered = numbered.withColumn("_width", F.size("x")).withColumn("_length", length)
    keys = [F.col("_width"), F.col("_length").desc(), F.col("id"), F.col("row")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "row", "x", "_width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (ids, rows, vectors) of one dimension
        count = 0

        def give() -> pa.RecordBatch:
            nonlocal held, count
            ids, rows, vectors = (np.concatenate([h[k] for h in held]) for k in range(3))
            with np.errstate(over="ignore"):
                lengths = np.sqrt((vectors * vectors).sum(axis=1))
            order = np.lexsort((rows, ids, -lengths))
            if copies is not None and vectors.shape[1]:
                _, which = np.unique(vectors[order], axis=0, return_inverse=True)
                by = np.argsort(which.reshape(-1), kind="stable")
                starts = np.flatnonzero(np.diff(which.reshape(-1)[by], prepend=-1))
                nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
                order = order[np.sort(by[nth < copies])]
            held, count = [], 0
            return pa.RecordBatch.from_pylist([_block(0, kind, ids[order], rows[order], vectors[order], lengths[order], np.full(len(order), -np.inf))], schema=schema)

        for batch in batches:
            widths = batch.column("_width").to_numpy()
            cuts = np.flatnonzero(np.diff(widths, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                width = int(widths[a])
                if held and held[0][2].shape[1] != width:
                    yield give()
                while a < b:
                    part = batch.slice(a, min(b - a, size - count))
                    ids = part.column("id").fill_null(_NO_ID).to_numpy()
                    held.append((ids, part.column("row").to_numpy(), _matrix(part.column("x"), width, scale)))
                    count += part.num_rows
                    a += part.num_rows
                    if count == size:
                        yield give()
        if held:
            yield give()

    return ordered.mapInArrow(run, _PACKED)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("width", pa.int32()), ("length", pa.float64()), *[(c, pa.binary()) for c in ("ids", "rows", "lengths", "bounds", "vectors")]])


class _Best:
    """The leading products of a block of queries: at most k each, by score and id."""

    def __init__(self, queries: _Block, k: int):
        self.queries, self.k = queries, k
        self.bounds = queries.bounds.copy()
        self.query, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, object), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(query):
            return
        query, ids, rows = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.row, rows)))
        score = np.concatenate([self.score.astype(score.dtype) if not len(self.score) else self.score, score])
        order = np.lexsort((rows, ids, -score, query)) if score.dtype != object else np.array(
            sorted(range(len(query)), key=lambda n: (query[n], -score[n], ids[n], rows[n])), np.int64
        )
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        sizes = np.diff(np.append(starts, len(order)))
        keep = order[np.arange(len(order)) - np.repeat(starts, sizes) < self.k]
        self.query, self.score, self.id, self.row = query[keep], score[keep], ids[keep], rows[keep]
        at = order[starts[sizes >= self.k] + self.k - 1]
        reached = np.array([_below(v) for v in score[at].tolist()], np.float64)
        self.bounds[query[at]] = np.maximum(self.bounds[query[at]], reached)


def _below(score) -> float:
    """A double not above a whole number of any size."""
    if isinstance(score, float) or abs(score) <= EXACT:
        return float(score)
    return -np.inf if score < -LARGE else float(min(score, LARGE)) * (1 - 1e-15 if score > 0 else 1 + 1e-15)


def _ordered(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    digits = str(abs(score)).encode()
    key = len(digits).to_bytes(2, "big") + digits
    return b"\x01" + key if score >= 0 else b"\x00" + bytes(255 - x for x in key)


class Bucket:
    """Vectors of neighbouring lengths, longest first, with a sorted list per coordinate when one is asked for."""

    def __init__(self, block: _Block):
        self.block = block
        self.longest = float(block.lengths[0]) if len(block.lengths) else 0.0
        self.largest = float(np.abs(block.vectors).max(initial=0.0))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unit: np.ndarray | None = None

    def coordinate(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if self.unit is None:
            self.unit = self.block.vectors / np.where(self.block.lengths > 0, self.block.lengths, 1.0)[:, None]
        if c not in self.lists:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.lists[c] = (self.unit[order, c], order)
        return self.lists[c]

    def in_ranges(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Vectors that may have this cosine or more with a unit vector: each focus coordinate must lie in its feasible range."""
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        half = np.sqrt(max(0.0, 1 - cosine * cosine)) * np.sqrt(np.maximum(0.0, 1 - unit[focus] ** 2)) + 1e-9
        low, high = unit[focus] * cosine - half, unit[focus] * cosine + half
        # beyond a cosine of the coordinate itself, the range reaches the pole
        high = np.where(unit[focus] >= cosine, 1.0 + 1e-9, high)
        low = np.where(-unit[focus] >= cosine, -1.0 - 1e-9, low)
        ends = []
        for k, c in enumerate(focus.tolist()):
            values, _ = self.coordinate(c)
            ends.append((np.searchsorted(values, low[k], "left"), np.searchsorted(values, high[k], "right")))
        shortest = min(range(len(focus)), key=lambda k: ends[k][1] - ends[k][0])
        some = self.lists[int(focus[shortest])][1][ends[shortest][0] : ends[shortest][1]]
        for k, c in enumerate(focus.tolist()):
            if k != shortest:
                some = some[(self.unit[some, c] >= low[k]) & (self.unit[some, c] <= high[k])]
        return some


def _products(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number products; ``exact`` says that doubles hold every partial sum."""
    if exact:
        return queries @ vectors.T
    whole = [np.vectorize(int, otypes=[object])(m) if m.size else m.astype(object) for m in (queries, vectors)]
    return whole[0] @ whole[1].T if queries.shape[1] else np.zeros((len(queries), len(vectors)), object)


def search(bucket: Bucket, best: _Best) -> dict[str, int]:
    """Hold a block of queries against a bucket; tells how many (query, vector) products each way of pruning left."""
    own, q = bucket.block, best.queries
    done = {"skipped": 0, "coordinates": 0, "length": 0}
    if own.width != q.width or not len(own.ids) or not len(q.ids):
        return done
    exact = max(1, own.width) * bucket.largest * float(np.abs(q.vectors).max(initial=0.0)) < EXACT
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        slack = 1e-9 * q.lengths * bucket.longest
        most = q.lengths * bucket.longest + slack
        cosine = np.where(best.bounds > 0, (best.bounds - slack) / most, -1.0) if exact else np.full(len(q.ids), -1.0)
        live = (most >= best.bounds) | ~np.isfinite(best.bounds) if exact else np.ones(len(q.ids), bool)
    done["skipped"] = int((~live).sum()) * len(own.ids)
    narrow = live & (cosine >= COORDINATES_FROM)
    found: list[tuple] = []
    for i in np.flatnonzero(narrow).tolist():
        some = bucket.in_ranges(q.vectors[i] / q.lengths[i], float(cosine[i]))
        done["coordinates"] += len(some)
        if len(some):
            score = own.vectors[some] @ q.vectors[i]
            ok = (score >= best.bounds[i]) & (own.rows[some] != q.rows[i])
            found.append((np.full(int(ok.sum()), i), score[ok], some[ok]))
    wide = np.flatnonzero(live & ~narrow)
    if len(wide):
        run = len(own.ids)
        if exact:  # vectors shorter than the least bound over |q| cannot reach it
            with np.errstate(invalid="ignore", divide="ignore"):
                least = np.where(q.lengths[wide] > 0, best.bounds[wide] / q.lengths[wide], -np.inf).min() * (1 - 1e-9)
            run = int(np.searchsorted(-own.lengths, -least, "right")) if least > 0 else run
        done["length"] += len(wide) * run
        score = _products(q.vectors[wide], own.vectors[:run], exact)
        i, j = np.nonzero((score >= best.bounds[wide][:, None]) & (own.rows[:run][None, :] != q.rows[wide][:, None]))
        if len(i) > best.k * len(wide):  # bounds are still loose: only the leading ones of each query
            i, j = _leading(score, own, q.rows[wide], best.k)
        found.append((wide[i], score[i, j], j))
    if found:
        query, score, at = (np.concatenate([f[k] for f in found]) for k in range(3))
        best.add(query, score, own.ids[at], own.rows[at])
    return done


def _leading(score: np.ndarray, own: _Block, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, vector) of each query's ``k`` best, all that tie with the last one included."""
    if score.shape[1] <= k + 1:
        i, j = np.nonzero(own.rows[None, : score.shape[1]] != rows[:, None])
        return i, j
    if score.dtype == object:
        cut = np.array([sorted(s, reverse=True)[k] for s in score], object)
    else:
        cut = np.partition(score, score.shape[1] - k - 1, axis=1)[:, score.shape[1] - k - 1]  # one more, as the own row may be among them
    return np.nonzero((score >= cut[:, None]) & (own.rows[None, : score.shape[1]] != rows[:, None]))


def _bounded(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Query blocks with a lower bound of each query's k-th product, from ``START`` buckets picked by a hash."""
    spark = queries.sparkSession
    chosen = buckets.select(F.xxhash64("rows").alias("h")).orderBy("h").limit(START)
    first = buckets.withColumn("h", F.xxhash64("rows")).join(F.broadcast(chosen), "h", "left_semi").drop("h").limit(START)
    sent = shared(spark, [r.asDict() for r in first.collect()])
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = [Bucket(_Block(row)) for row in received(sent)]
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                best = _Best(_Block(row), k)
                for bucket in start:
                    search(bucket, best)
                row["bounds"] = best.bounds.tobytes()
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return queries.mapInArrow(run, _PACKED)


def top_products(
    df: DataFrame, k: int = 5, queries: str = "id % 50 = 0", scale: float = 256, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest products of each query, a row for which ``queries`` holds, with all other rows."""
    vectors = _vectors(df, id_column, vector_column, scale).withColumn("row", F.monotonically_increasing_id())
    vectors = materialize(vectors)
    buckets = materialize(packed(vectors, scale, 1, BUCKET, k + 1))
    blocks = packed(vectors.where(queries), scale, 0, QUERIES)
    blocks = materialize(_bounded(materialize(blocks), buckets, k))
    sizes = blocks.agg(F.coalesce(F.sum(F.octet_length("vectors") + 40 * F.octet_length("ids")), F.lit(0)).alias("bytes")).first()
    across = max(1, -(-int(sizes["bytes"]) // CELL_BYTES))  # groups of queries
    down = max(1, -(-buckets.count() * BUCKET // CELL_VECTORS), int(df.sparkSession.sparkContext.defaultParallelism) // across)
    n = F.lit(across)
    of_query = F.pmod(F.xxhash64("ids"), n).cast("int")
    of_bucket = F.pmod(F.xxhash64("ids"), F.lit(down)).cast("int")
    rest = [F.col(c) for c in ("kind", "width", "length", "ids", "rows", "lengths", "bounds", "vectors")]
    left = blocks.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda i: (i * n + of_query).cast("int"))).alias("cell"), *rest)
    right = buckets.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda i: (of_bucket * n + i).cast("int"))).alias("cell"), *rest)
    cells = left.union(right).repartition(across * down, "cell").sortWithinPartitions("cell", "kind", F.desc("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Best] = []
        cell = None

        def give() -> Iterator[pa.RecordBatch]:
            for best in held:
                if len(best.query):
                    score = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in best.score]
                    ids = pa.array(best.id, mask=best.id == _NO_ID)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(best.queries.ids[best.query]), pa.array(best.queries.rows[best.query]), ids, pa.array(score, pa.int64()), pa.array([_ordered(int(s)) for s in best.score], pa.binary())],
                        names=["query_id", "row", "vec_id", "score", "order"],
                    )

        for batch in batches:
            for m in range(batch.num_rows):
                row = batch.slice(m, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from give()
                    held, cell = [], row["cell"]
                if row["kind"] == 0:
                    held.append(_Best(_Block(row), k))
                else:
                    bucket = Bucket(_Block(row))
                    for best in held:
                        search(bucket, best)
        yield from give()

    found = cells.mapInArrow(run, "query_id long, row long, vec_id long, score long, order binary")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("order"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB, for a table ``embeddings`` of vectors of one dimension.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Co-moments of many column pairs in one scan: masked Gram matrices per batch, merged exactly.

Each batch of rows gives, for every pair (i, j), the number of rows where both are present, the mean and the sum of squares of i
over those rows, and the sum of products: four products of the value matrix and its presence mask, taken around the batch's own
column means. Two such tables merge by the gap of their means, so no sum is ever taken far from its values, and a
task's table has one fixed size whatever its rows. Tables travel as one row per column and are merged as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_AT_ONCE = 4096
_EPS = float(np.finfo(float).eps)
PARTS = "first int, n binary, mean binary, squares binary, products binary"


class CoMoments:
    """Pairs of columns i (rows) and j: n and products are symmetric, mean and squares are those of i where j is present."""

    def __init__(self, n, mean, squares, products):
        self.n, self.mean, self.squares, self.products = n, mean, squares, products

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """Of a matrix with NaN for missing cells."""
        here = ~np.isnan(x)
        count = here.sum(axis=0)
        lead = x[here.argmax(axis=0), np.arange(x.shape[1])]
        lead = np.where(np.isfinite(lead), lead, 0.0)
        d = np.where(here, x - lead, 0.0)
        middle = d.sum(axis=0) / np.maximum(count, 1)
        d = np.where(here, d - middle, 0.0)  # a constant column is exactly 0 here
        centre = lead + middle
        mask = here.astype(np.float64)
        if here.all():
            n = np.full((x.shape[1],) * 2, float(len(x)))
            sums = np.repeat(d.sum(axis=0)[:, None], x.shape[1], axis=1)
            raw = np.repeat((d * d).sum(axis=0)[:, None], x.shape[1], axis=1)
        else:
            n, sums, raw = mask.T @ mask, d.T @ mask, (d * d).T @ mask
        at = np.maximum(n, 1)
        squares = raw - sums * sums / at
        squares[squares <= 4 * _EPS * at * raw] = 0.0
        return cls(n, np.where(n > 0, centre[:, None] + sums / at, 0.0), squares, d.T @ d - sums * sums.T / at)

    def merged(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        both = self.n * other.n / np.maximum(n, 1)
        gap = np.where(both > 0, other.mean - self.mean, 0.0)
        mean = np.where(self.n == 0, other.mean, self.mean + gap * other.n / np.maximum(n, 1))
        return CoMoments(n, mean, self.squares + other.squares + gap * gap * both, self.products + other.products + gap * gap.T * both)


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Columns as doubles, NaN where missing."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], axis=1) if len(names) else np.zeros((batch.num_rows, 0))


def pair_moments(values: DataFrame) -> DataFrame:
    """One row per column but the last, with its moments against each later column packed, from one scan of a table of doubles."""
    names = values.columns
    return merged_rows(values.mapInArrow(lambda batches: _folded(batches, names), PARTS))


def _folded(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    return folded(matrix(batch.slice(k, ROWS_AT_ONCE), names) for batch in batches for k in range(0, batch.num_rows, ROWS_AT_ONCE))


def folded(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The moments of all pairs of columns of a task's matrices."""
    total = None
    with np.errstate(all="ignore"):
        for x in matrices:
            own = CoMoments.of(x)
            total = own if total is None else total.merged(own)
    if total is not None:
        yield packed(total)


def folded_pairs(matrices: Iterator[np.ndarray], left: np.ndarray, right: np.ndarray, size: int = 64) -> Iterator[pa.RecordBatch]:
    """The moments of chosen pairs of columns only, ``size`` pairs to a row."""
    totals: list[tuple] = []
    cuts = range(0, len(left), size)
    with np.errstate(all="ignore"):
        for x in matrices:
            own = [_pair_tables(x[:, left[k : k + size]], x[:, right[k : k + size]]) for k in cuts]
            totals = [merged_tables(a, b) for a, b in zip(totals, own)] if totals else own
    if totals:
        cells = [pa.array([np.ascontiguousarray(t[k]).tobytes() for t in totals], pa.binary()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals), dtype=np.int32)), *cells], names=_FIELDS)


def _pair_tables(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    here = ~(np.isnan(a) | np.isnan(b))
    n = here.sum(axis=0).astype(np.float64)
    at = np.maximum(n, 1)
    means = [np.where(here, v, 0.0).sum(axis=0) / at for v in (a, b)]
    da, db = (np.where(here, v - m, 0.0) for v, m in zip((a, b), means))
    return n, np.concatenate(means), np.concatenate([(d * d).sum(axis=0) for d in (da, db)]), (da * db).sum(axis=0)


def merged_tables(a: tuple, b: tuple) -> tuple[np.ndarray, ...]:
    """Merge two packed tables (n, mean and squares of both sides, products) of the same pairs."""
    n, mean, squares, products = b
    before, at, s, p = a
    share = n / np.maximum(before + n, 1)
    both = before * share
    gap = np.where(np.tile(both, 2) > 0, mean - at, 0.0)
    at = np.where(np.tile(before, 2) == 0, mean, at + gap * np.tile(share, 2))
    half = len(n)
    return before + n, at, s + squares + gap * gap * np.tile(both, 2), p + products + gap[:half] * gap[half:] * both


def packed(total: CoMoments) -> pa.RecordBatch:
    """Row i holds, for each j after i: n, mean and squares of i then those of j, products."""
    rows = range(len(total.n) - 1)
    columns = [
        [total.n[i, i + 1 :] for i in rows],
        [np.concatenate([total.mean[i, i + 1 :], total.mean[i + 1 :, i]]) for i in rows],
        [np.concatenate([total.squares[i, i + 1 :], total.squares[i + 1 :, i]]) for i in rows],
        [total.products[i, i + 1 :] for i in rows],
    ]
    cells = [pa.array([np.ascontiguousarray(v).tobytes() for v in c], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), *cells], names=_FIELDS)


_FIELDS = ["first", "n", "mean", "squares", "products"]


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], np.float64) for c in _FIELDS[1:])


def merged_rows(parts: DataFrame) -> DataFrame:
    """Merge the tables of all tasks, row by row: each key's rows pass by as a stream, none is gathered."""
    ordered = parts.repartition("first").sortWithinPartitions("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in total]], names=_FIELDS)

        with np.errstate(all="ignore"):
            for batch in batches:
                for row in batch.to_pylist():
                    own = _unpacked(row)
                    if row["first"] != key:
                        if total is not None:
                            yield give()
                        key, total = row["first"], own
                    else:
                        total = merged_tables(total, own)
        if total is not None:
            yield give()

    return ordered.mapInArrow(run, PARTS)


def correlations(values: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(col1, col2, r, n)`` of all pairs of columns of a table of doubles; r is NULL where a side is constant."""
    names = list(labels)
    return named(pair_moments(values), lambda i, n: ([names[i]] * n, names[i + 1 :]))


def named(parts: DataFrame, label) -> DataFrame:
    """``(col1, col2, r, n)`` from merged rows; ``label(first, pairs)`` names the two sides of a row's pairs."""
    schema = pa.schema([("col1", pa.string()), ("col2", pa.string()), ("r", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for batch in batches:
                for row in batch.to_pylist():
                    n, mean, squares, products = _unpacked(row)
                    half = len(n)
                    varies = squares > np.tile(n, 2) * (mean * (8 * _EPS)) ** 2  # less is what rounding makes of a constant
                    r = products / (np.sqrt(squares[:half]) * np.sqrt(squares[half:]))
                    known = varies[:half] & varies[half:] & np.isfinite(r)
                    a, b = label(row["first"], half)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(r, mask=~known), pa.array(n.astype(np.int64))], schema=schema)

    return parts.mapInArrow(run, "col1 string, col2 string, r double, n long")

"""Average ranks of many columns at once: one range shuffle of (group, value) cells, whatever the number of columns.

Groups with few different values need no shuffle: their values are counted, and the ranks looked up where the rows are.
Cells of other groups are ordered by group, value and row, so a heavy value is spread over partitions. They are written once; each partition
then tells how many cells of each group it has and how many hold its first and its last value, from which every partition
knows where its cells stand and how far the ties at its borders reach. What travels to the driver is one row per
partition and group it holds, with the lengths of its runs of ``LONG_RUN`` equal values or more: shorter ones are kept until they
end, longer ones pass by. The number of partitions follows the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.moments import PARTS
from tablescope.operators.order import BROADCAST_ROWS, materialize

KNOWN_VALUES = BROADCAST_ROWS  # values of all rank tables together
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 21  # of a partition, more or less
LONG_RUN = 1 << 16


def partitions_for(df: DataFrame, cells: int) -> int:
    """Enough partitions for ``MOST_CELLS`` each, and for all cores while they have ``LEAST_CELLS``."""
    return max(1, ceil(cells / MOST_CELLS), min(df.sparkSession.sparkContext.defaultParallelism, ceil(cells / LEAST_CELLS)))


def few_valued(sizes: dict[int, int]) -> list[int]:
    """The groups, by their numbers of different values, whose rank tables together stay below ``KNOWN_VALUES``."""
    out, total = [], 0
    for group, size in sorted(sizes.items(), key=lambda item: (item[1], item[0])):
        total += size
        if total > KNOWN_VALUES:
            break
        out.append(group)
    return sorted(out)


class RankTable:
    """The values of a group in order, with the rank and the number of the cells that hold each."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(values)
        self.values, self.ties = values[order], counts[order]
        self.ranks = np.cumsum(self.ties) - self.ties + (self.ties + 1) / 2

    def at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, ties) of values that occur."""
        where = np.searchsorted(self.values, x)
        return self.ranks[where], self.ties[where]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Ranks, NaN where a value is missing."""
        out = np.full(len(x), np.nan)
        here = ~np.isnan(x)
        out[here] = self.at(x[here])[0]
        return out


def rank_tables(frame: DataFrame, cells: Sequence[tuple[int, str]]) -> dict[int, RankTable]:
    """Tables of the groups of few values, from counts of their cells."""
    counted = group_cells(frame, cells, []).groupBy("group", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    groups, values, n = (counted.column(c).to_numpy() for c in ("group", "value", "n"))
    return {g: RankTable(values[groups == g], n[groups == g]) for g, _ in cells}


def ranked(cells: DataFrame, tie_breaker: str, parts: int | None = None) -> DataFrame:
    """Add ``rank`` (the mean 1-based position of equal values) and ``ties`` (how many there are) to cells (``group``, ``value``, ...) without missing values.

    ``tie_breaker`` names a column that tells the cells of one value apart; ``parts`` is the number of partitions, Spark's if left out.
    """
    keys = ["group", "value", tie_breaker]
    known = cells.withColumn("value", F.col("value") + F.lit(0.0))  # one zero
    placed = materialize(known.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions("group", "value").withColumn("_part", F.spark_partition_id()))
    borders = _borders(placed)
    schema = T.StructType([*cells.schema.fields, T.StructField("rank", T.DoubleType()), T.StructField("ties", T.LongType())])
    return placed.mapInArrow(lambda batches: _positions(batches, borders), schema)


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, values, first cell of each run of equal ones)."""
    groups, values = batch.column("group").to_numpy(), batch.column("value").to_numpy()
    change = np.ones(len(groups), bool)
    change[1:] = (groups[1:] != groups[:-1]) | (values[1:] != values[:-1])
    return groups, values, np.flatnonzero(change)


def _borders(placed: DataFrame) -> dict[int, dict[int, tuple]]:
    """Per partition and group: (cells of the group before it, cells that equal its first value before it, all of them, all that equal its last value, that value, long runs between)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []  # part, group, n, first value, cells of it, last value, cells of it, long runs between: values, cells
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            groups, values, starts = _runs(batch)
            for a, b in _outer(groups, starts, batch.num_rows):
                group, first, last = int(groups[a]), float(values[a]), float(values[b - 1])
                head, tail = _count(values[a:b], first, True), _count(values[a:b], last, False)
                if found and found[-1][1] == group:
                    row = found[-1]
                    ended = row[6] + (head if first == row[5] else 0)
                    if ended >= LONG_RUN and row[5] not in (row[3], last):
                        row[7].append(row[5])
                        row[8].append(ended)
                    if row[4] == row[2] and row[3] == first:
                        row[4] += head
                    row[6] = row[6] + tail if last == row[5] and tail == b - a else tail
                    row[2] += b - a
                    row[5] = last
                else:
                    found.append([part, group, b - a, first, head, last, tail, [], []])
        if found:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["part", "grp", "n", "first", "first_n", "last", "last_n", "long", "long_n"])

    schema = "part long, grp long, n long, first double, first_n long, last double, last_n long, long array<double>, long_n array<long>"
    rows = placed.select("_part", "group", "value").mapInArrow(run, schema).collect()
    out: dict[int, dict[int, tuple]] = {}
    for group, own in groupby(sorted(rows, key=lambda r: (r["grp"], r["part"])), key=lambda r: r["grp"]):
        before, runs, joined, value = 0, [], [], None
        for r in own:
            start = len(runs) - 1 if runs and r["first"] == value else len(runs)
            if start == len(runs):
                runs.append(0)
            ahead = runs[start]
            runs[start] += r["first_n"]
            end = start
            if r["last"] != r["first"]:
                runs.append(r["last_n"])
                end = len(runs) - 1
            joined.append((r["part"], before, ahead, start, end, r["last"], dict(zip(r["long"], r["long_n"]))))
            before, value = before + r["n"], r["last"]
        for part, offset, ahead, start, end, last, long in joined:
            out.setdefault(part, {})[group] = (offset, ahead, runs[start], runs[end], last, long)
    return out


def _outer(groups: np.ndarray, starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches of one group each."""
    heads = starts[np.append(True, groups[starts[1:]] != groups[starts[:-1]])].tolist()
    return list(zip(heads, [*heads[1:], n]))


def _count(values: np.ndarray, value: float, leading: bool) -> int:
    """Cells at one end of ordered values that equal ``value``."""
    return int(np.searchsorted(values, value, "right")) if leading else len(values) - int(np.searchsorted(values, value, "left"))


def _positions(batches: Iterator[pa.RecordBatch], borders: dict[int, dict[int, tuple]]) -> Iterator[pa.RecordBatch]:
    """Ranks of a partition's cells; the cells of its last value so far wait for the next batch, unless their number is known."""
    group, done = None, 0  # cells of the group given so far
    held: list[pa.RecordBatch] = []
    passing: tuple | None = None  # group, value, rank and ties of a run whose cells need not wait

    def known(batch: pa.RecordBatch) -> tuple | None:
        nonlocal group, done
        part, own, value = (batch.column(c)[0].as_py() for c in ("_part", "group", "value"))
        if own != group:
            group, done = own, 0
        offset, ahead, first_total, last_total, last, long = borders[part][own]
        total = first_total if done == 0 else last_total if value == last else long.get(value)
        return total and (own, value, offset + done - (0 if done else ahead) + (total + 1) / 2, total)

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal done
        done += batch.num_rows
        return finished(batch, np.full(batch.num_rows, passing[2]), np.full(batch.num_rows, passing[3], np.int64))

    def give(batch: pa.RecordBatch, closing: bool) -> pa.RecordBatch:
        nonlocal group, done
        part = batch.column("_part")[0].as_py()
        groups, _, starts = _runs(batch)
        sizes = np.diff(np.append(starts, batch.num_rows))
        at, total = np.zeros(len(starts)), sizes.astype(np.int64)
        heads = np.flatnonzero(np.append(True, groups[starts[1:]] != groups[starts[:-1]]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(starts)]):
            own = int(groups[starts[a]])
            if own != group:
                group, done = own, 0
            offset, ahead, first_total, last_total, _, _ = borders[part][own]
            at[a:b] = offset + done + np.cumsum(sizes[a:b]) - sizes[a:b]
            if done == 0:
                at[a] -= ahead
                total[a] = first_total
            done += int(sizes[a:b].sum())
            if b < len(starts) or closing:  # the group's last value here goes on in later partitions
                total[b - 1] = max(int(total[b - 1]), last_total)
        return finished(batch, np.repeat(at + (total + 1) / 2, sizes), np.repeat(total, sizes))

    def finished(batch: pa.RecordBatch, rank: np.ndarray, ties: np.ndarray) -> pa.RecordBatch:
        kept = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "_part"]
        names = [n for n in batch.schema.names if n != "_part"]
        return pa.RecordBatch.from_arrays([*kept, pa.array(rank), pa.array(ties)], names=[*names, "rank", "ties"])

    for batch in batches:
        if not batch.num_rows:
            continue
        groups, values, starts = _runs(batch)
        if passing and (int(groups[0]), float(values[0])) == passing[:2]:
            end = int(starts[1]) if len(starts) > 1 else batch.num_rows
            yield passed(batch.slice(0, end))
            if end == batch.num_rows:
                continue
            batch, starts = batch.slice(end), starts[1:] - end
        passing = None
        cut = int(starts[-1])
        fresh = held and (held[-1].column("group")[-1] != batch.column("group")[0] or held[-1].column("value")[-1] != batch.column("value")[0])
        if held and (fresh or cut):
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)] if not fresh else held).combine_chunks().to_batches()[0]
            if fresh and cut:
                whole = pa.Table.from_batches([whole, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
            yield give(whole, False)
        elif cut:
            yield give(batch.slice(0, cut), False)
        held.append(batch.slice(cut))
        passing = known(held[0])
        if passing:
            yield from map(passed, held)
            held = []
    if held:
        yield give(pa.Table.from_batches(held).combine_chunks().to_batches()[0], True)


def by_row(cells: DataFrame, width: int, parts: int, use, rows: DataFrame | None = None, tables: dict[int, RankTable] | None = None) -> DataFrame:
    """Send ranked cells (``row``, ``group``, ``rank``) back to their rows and hand matrices of ``width`` groups, NaN where missing, to ``use``.

    ``rows`` holds each ``row`` once with ``values``, those of the groups of ``tables``, which are ranked there.
    ``use(matrices)`` takes an iterator of matrices and yields record batches of moments.
    """
    cells = cells.select("row", "group", "rank")
    if rows is not None:
        own = rows.select("row", F.lit(-1).alias("group"), F.lit(0.0).alias("rank"), "values")
        cells = cells.withColumn("values", F.lit(None).cast("array<double>")).unionByName(own)
    ordered = cells.repartition(parts, "row").sortWithinPartitions("row")
    few = list(tables or {})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row").to_numpy()
            cut = int(np.searchsorted(row, row[-1]))
            if cut:
                yield dense(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = [batch.slice(cut)]
            elif rest and rest[-1].column("row")[0] != batch.column("row")[0]:
                yield dense(pa.Table.from_batches(rest))
                rest = [batch]
            else:
                rest.append(batch)
        if rest:
            yield dense(pa.Table.from_batches(rest))

    def dense(table: pa.Table) -> np.ndarray:
        row, group, rank = (table.column(c).to_numpy() for c in ("row", "group", "rank"))
        each, at = np.unique(row, return_inverse=True)
        out = np.full((len(each), width), np.nan)
        ranks = group >= 0
        out[at[ranks], group[ranks]] = rank[ranks]
        if few:
            values = pa.compute.list_flatten(table.column("values")).to_numpy().reshape(-1, len(few))  # one list a row, in their order
            for k, g in enumerate(few):
                out[:, g] = tables[g].ranked(values[:, k])
        return out

    return ordered.mapInArrow(lambda batches: use(matrices(batches)), PARTS)


def group_cells(frame: DataFrame, values: Sequence[tuple[int, str]], carried: Sequence[str]) -> DataFrame:
    """Cells (group, value, ...) of SQL expressions, without missing ones."""
    among = ", ".join(f"named_struct('group', {g}, 'value', {value})" for g, value in values)
    keep = [F.col(c) for c in carried]
    return frame.select(*keep, F.expr(f"inline(array({among}))")).where("value IS NOT NULL").select("group", "value", *keep)

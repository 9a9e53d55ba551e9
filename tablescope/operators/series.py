"""Rolling statistics, autocorrelation and trends over an ordered column.

Rows are numbered in parallel; no window spans the whole table. Rolling windows are put together from two summaries
of blocks of rows; lags run inside blocks of consecutive rows that also hold the few rows before the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.stats import pearson_sql
from tablescope.kinds import datetime_columns, numeric_columns, string_columns, quoted
from tablescope.operators.order import with_row_index
from tablescope.operators.select import to_datetime, to_numeric

BLOCK_ROWS = 20_000


def ordered_values(df: DataFrame, ts: str | None, value: str, order_by=None) -> DataFrame:
    """``(ts, value)`` with both present; ``ts`` is parsed as a time unless another order is named."""
    when = to_datetime(df, ts) if order_by is None else quoted(ts or order_by)
    return df.select(when.alias("ts"), to_numeric(df, value).alias("value")).filter(
        F.col("ts").isNotNull() & F.col("value").isNotNull()
    )


def _blocks(indexed: DataFrame, reach: int) -> DataFrame:
    """Cut numbered rows into blocks; each block also gets the ``reach`` rows before it as ``halo``."""
    size = max(BLOCK_ROWS, 4 * reach)
    block = F.floor(F.col("idx") / size).cast("bigint")
    near_end = F.col("idx") % size >= size - reach
    copies = F.when(
        near_end,
        F.array(F.struct(block.alias("block"), F.lit(False).alias("halo")), F.struct((block + 1).alias("block"), F.lit(True).alias("halo"))),
    ).otherwise(F.array(F.struct(block.alias("block"), F.lit(False).alias("halo"))))
    return indexed.select("*", F.inline(copies))


def rolling_stats(df: DataFrame, ts: str, value: str, window: int | None = None, order_by=None) -> DataFrame:
    """``(idx, ts, value, rolling_mean, rolling_std)``; the first window - 1 rows have no statistics.

    The default window is a tenth of the rows, at least 3. Rows of one time are ordered by value, at every length. Rows are
    cut into blocks of one window: each window is the end of a block and the beginning of the next, whose numbers, means and sums of
    squares are merged, so that neither cost nor rounding depends on the window.
    """
    rows = ordered_values(df, ts, value, order_by)
    indexed = with_row_index(rows, ["ts", "value"], "idx")
    if window is None:
        window = max(3, indexed.count() // 10)
    return _windows(indexed, window)


def _windows(indexed: DataFrame, window: int) -> DataFrame:
    placed = indexed.withColumn("_part", F.spark_partition_id())
    borders = _borders(placed, window)
    begun = placed.sortWithinPartitions("idx").mapInArrow(
        lambda batches: _running(batches, window, borders, False), "idx long, ts {}, value double, mean double, squares double".format(indexed.schema["ts"].dataType.simpleString())
    )
    ended = placed.select("idx", "value", "_part").sortWithinPartitions(F.desc("idx")).mapInArrow(
        lambda batches: _running(batches, window, borders, True), "_last long, _mean double, _squares double"
    )
    # the rest of a block meets the row where the window that starts there ends
    both = begun.join(ended, F.col("idx") == F.col("_last"), "left")
    new = (F.col("idx") % window + 1).cast("double")
    old = F.lit(float(window)) - new
    gap = F.col("mean") - F.col("_mean")
    mean = F.when(old == 0, F.col("mean")).otherwise(F.col("_mean") + gap * new / window)
    squares = F.when(old == 0, F.col("squares")).otherwise(F.col("squares") + F.col("_squares") + gap * gap * new * old / window)
    full = F.col("idx") >= window - 1
    return both.select(
        "idx", "ts", "value", F.when(full, mean).alias("rolling_mean"), F.when(full, F.sqrt(F.greatest(squares, F.lit(0.0)) / F.nullif(F.lit(window - 1.0), F.lit(0.0)))).alias("rolling_std")
    )


def _moments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running mean and sum of squares along the last axis, taken around its first value."""
    lead = values[..., :1]
    d = values - lead
    n = np.arange(1, values.shape[-1] + 1)
    sums, raw = np.cumsum(d, axis=-1), np.cumsum(d * d, axis=-1)
    return lead + sums / n, np.maximum(raw - sums * sums / n, 0.0)


def _merged(n, mean, squares, m, other, more):
    """Moments of two groups of n and m values together."""
    gap = other - mean
    return mean + gap * (m / (n + m)), squares + more + gap * gap * (n * m / (n + m))


def _segments(values: np.ndarray, first: int, window: int, state: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Running moments within blocks of ``window`` of rows numbered from ``first``; ``state`` is (n, mean, squares) of the open block."""
    mean, squares = np.empty(len(values)), np.empty(len(values))
    head = min(len(values), (-first) % window)
    body = (len(values) - head) // window * window
    parts = [(0, head)] if head else []
    if body:
        blocks = values[head : head + body].reshape(-1, window)
        mean[head : head + body], squares[head : head + body] = (x.reshape(-1) for x in _moments(blocks))
    if head + body < len(values):
        parts.append((head + body, len(values)))
    for a, b in parts:
        mean[a:b], squares[a:b] = _moments(values[a:b])
        n, at, sum_of = state if a == 0 and first % window else (0, 0.0, 0.0)
        if n:
            mean[a:b], squares[a:b] = _merged(n, at, sum_of, np.arange(1, b - a + 1), mean[a:b], squares[a:b])
    end = first + len(values)
    return mean, squares, ((end % window, float(mean[-1]), float(squares[-1])) if end % window else (0, 0.0, 0.0))


def _borders(placed: DataFrame, window: int) -> dict[int, tuple]:
    """Per partition, what the partitions before it hold of its first block, and those after it of its last block.

    Each partition tells the moments of its first and its last block's rows: two rows a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = low = high = None
        edge: dict[int, tuple] = {}
        for batch in batches:
            values, idx = batch.column("value").to_numpy(), batch.column("idx").to_numpy()
            if not len(idx):
                continue
            part = batch.column("_part")[0].as_py()
            low = int(idx[0]) if low is None else low
            blocks = idx // window
            for block in {int(blocks[0]), int(blocks[-1])}:
                own = values[blocks == block]
                mean, squares = (float(x[-1]) for x in _moments(own))
                old = edge.get(block)
                if old:
                    mean, squares = _merged(*old, len(own), mean, squares)
                edge[block] = ((old[0] if old else 0) + len(own), mean, squares)
            high = int(idx[-1])
            edge = {b: v for b, v in edge.items() if b in (low // window, high // window)}
        if part is not None:
            cells = [(part, low, block, *v) for block, v in edge.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], names=["part", "low", "block", "n", "mean", "squares"])

    found = placed.select("idx", "value", "_part").sortWithinPartitions("idx").mapInArrow(run, "part long, low long, block long, n long, mean double, squares double")
    rows = sorted(found.collect(), key=lambda r: (r["low"], r["block"]))
    out: dict[int, list] = {r["part"]: [(0, 0.0, 0.0), (0, 0.0, 0.0)] for r in rows}
    for side, ordered in ((0, rows), (1, rows[::-1])):
        block, total = None, (0, 0.0, 0.0)
        for r in ordered:
            if r["block"] != block:
                block, total = r["block"], (0, 0.0, 0.0)
            own = (r["n"], r["mean"], r["squares"])
            if total[0]:
                out[r["part"]][side] = total
                own = (total[0] + own[0], *_merged(*total, *own))
            total = own
    return {part: tuple(v) for part, v in out.items()}


def _running(batches: Iterator[pa.RecordBatch], window: int, borders: dict[int, tuple], backwards: bool) -> Iterator[pa.RecordBatch]:
    """Moments of each row's block from its beginning to the row, or from the row to its end."""
    state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        idx, values = batch.column("idx").to_numpy(), batch.column("value").to_numpy().astype(np.float64)
        if state is None:
            state = borders[batch.column("_part")[0].as_py()][int(backwards)]
        # backwards, row numbers count down to the beginning of a block, which is where a block of mirrored rows ends
        first = (-int(idx[0]) - 1) % window if backwards else int(idx[0])
        mean, squares, state = _segments(values, first, window, state)
        if backwards:
            yield pa.RecordBatch.from_arrays([pa.array(idx + window - 1), pa.array(mean), pa.array(squares)], names=["_last", "_mean", "_squares"])
        else:
            columns = [batch.column("idx"), batch.column("ts"), batch.column("value"), pa.array(mean), pa.array(squares)]
            yield pa.RecordBatch.from_arrays(columns, names=["idx", "ts", "value", "mean", "squares"])


def rolling_mean(df: DataFrame, order_by: str, value: str, window: int = 5, fill: str | float | None = "bfill") -> DataFrame:
    """``(idx, ts, value, rolling_mean)``; the incomplete head is back-filled, filled with a number, or empty."""
    out = rolling_stats(df, order_by, value, window, order_by=order_by).drop("rolling_std")
    if fill is None:
        return out
    if fill == "bfill":
        first = out.filter(F.col("idx") == window - 1).agg(F.max("rolling_mean")).scalar()
        return out.withColumn("rolling_mean", F.coalesce("rolling_mean", first))
    return out.withColumn("rolling_mean", F.coalesce("rolling_mean", F.lit(float(fill))))


def group_trend_3d(df: DataFrame, order_by: str, value: str, window: int = 5) -> DataFrame:
    """Row number, value and back-filled rolling mean, the three axes of a trend chart."""
    return rolling_mean(df, order_by, value, window, "bfill").select("idx", "value", "rolling_mean")


def autocorrelation(df: DataFrame, ts: str, value: str, max_lag: int = 20, order_by=None) -> DataFrame:
    """``(lag, r, n)`` for lags 1 … min(max_lag, n//2 - 1)."""
    rows = ordered_values(df, ts, value, order_by)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).first()
    lags = range(1, min(max_lag + 1, facts["n"] // 2))
    if not lags:
        return df.sparkSession.createDataFrame([], "lag int, r double, n bigint")
    blocks = _blocks(with_row_index(rows, "ts", "idx"), len(lags)).withColumn("lag0", F.col("value") - F.lit(facts["mean"]))
    lagged = [f"lag(lag0, {k}) OVER (PARTITION BY block ORDER BY idx) AS lag{k}" for k in lags]
    own = blocks.selectExpr("halo", "lag0", *lagged).filter(~F.col("halo"))

    def present(k: int) -> str:
        return f"(CASE WHEN lag{k} IS NOT NULL THEN lag0 END)"  # both sides over the same rows

    cells = [f"named_struct('lag', {k}, 'r', {pearson_sql(present(k), f'lag{k}')}, 'n', count(lag{k})) AS _{k}" for k in lags]
    return own.agg(*[F.expr(c) for c in cells]).select(F.expr(f"inline(array({', '.join(f'_{k}' for k in lags)}))"))


def detect_time_column(df: DataFrame) -> str | None:
    """The first time column, else the first text column whose values all parse as times."""
    times = datetime_columns(df)
    if times:
        return times[0]
    texts = string_columns(df)
    if not texts:
        return None
    checks = [
        F.struct(F.count(quoted(c)).alias("n"), F.count(to_datetime(df, c)).alias("parsed")).alias(f"_{i}") for i, c in enumerate(texts)
    ]
    row = df.agg(*checks).first()
    for i, c in enumerate(texts):
        if row[f"_{i}"]["n"] and row[f"_{i}"]["n"] == row[f"_{i}"]["parsed"]:
            return c
    return None


def time_trend(df: DataFrame, ts: str | None = None, value: str | None = None, bucket: str | None = None) -> DataFrame:
    """The first numeric column over time, in time order; with ``bucket`` averaged per time unit."""
    ts = ts or detect_time_column(df)
    if ts is None:
        raise ValueError("no time column found")
    numbers = [c for c in numeric_columns(df) if c != ts]
    value = value or (numbers[0] if numbers else None)
    if value is None:
        raise ValueError("no numeric column found")
    rows = ordered_values(df, ts, value)
    if bucket is None:
        return rows.orderBy("ts", "value")
    when: Column = F.date_trunc(bucket, F.col("ts")).cast("timestamp_ntz")
    return rows.groupBy(when.alias("ts")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).orderBy("ts")

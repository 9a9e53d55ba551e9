"""Filters, slices, pages, projections, sorts, top-k cuts and samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.kinds import (
    INTEGRAL,
    NESTED,
    column_kind,
    columns_of_kind,
    field_type,
    groupable_columns,
    missing_to_null,
    nested_text,
    plain_columns,
    quoted,
    string_columns,
)
from tablescope.operators.freq import value_counts
from tablescope.operators.order import file_order, materialize, order_columns, with_row_index

SHALLOW_ROWS = 100_000  # up to here a page is a top-k, beyond it its place is found by counting
BROADCAST_ROWS = 1 << 20
PAGE_SIZES = (10, 5000)
SORTED_AT_ONCE = 200_000  # rows among which a page is found by sorting
SPLITTERS = 32  # counted in one scan


# --- coercion -------------------------------------------------------------------------------------

def to_numeric(df: DataFrame, column: str) -> Column:
    """The column as a double; what does not parse, and NaN, becomes NULL."""
    dtype = field_type(df, column)
    if column_kind(dtype) == "numeric":
        return missing_to_null(column, dtype).cast("double")
    parsed = F.trim(quoted(column).cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def to_datetime(df: DataFrame, column: str, fmt: str | None = None) -> Column:
    """The column as a timestamp; what does not parse becomes NULL."""
    if column_kind(field_type(df, column)) == "datetime":
        return quoted(column).cast("timestamp_ntz")
    text = quoted(column).cast("string")
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return parsed.cast("timestamp_ntz")


def coerce_numeric(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, to_numeric(df, column))


def coerce_datetime(df: DataFrame, column: str, name: str | None = None, fmt: str | None = None) -> DataFrame:
    return df.withColumn(name or column, to_datetime(df, column, fmt))


# --- filters --------------------------------------------------------------------------------------

def filter_equals(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose value, written as text, is ``value``; numbers compare as numbers and push down."""
    c = quoted(column)
    if column_kind(field_type(df, column)) == "numeric":
        number = _number(value)
        return df.filter(F.lit(False) if number is None else c == F.lit(number))
    return df.filter(c.cast("string") == F.lit(str(value)))


def _number(value: object) -> float | int | None:
    try:
        as_float = float(str(value))
    except ValueError:
        return None
    return int(as_float) if as_float.is_integer() and abs(as_float) < 2**53 else as_float


def filter_greater(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(_compared(df, column, float(str(value)), greater=True))


def filter_less(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(_compared(df, column, float(str(value)), greater=False))


def _compared(df: DataFrame, column: str, value: float, greater: bool) -> Column:
    """A comparison that reaches the scan: bare column, bound of the column's own kind.

    Whole-number columns compare with the next whole number. NaN counts as missing, and sorts above every
    number, so only ``greater`` has to exclude it.
    """
    dtype, c = field_type(df, column), quoted(column)
    if isinstance(dtype, INTEGRAL) and abs(value) < 2**62:
        return c > F.lit(math.floor(value)) if greater else c < F.lit(math.ceil(value))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (c > F.lit(value)) & ~F.isnan(c) if greater else c < F.lit(value)
    number = to_numeric(df, column)
    return number > F.lit(value) if greater else number < F.lit(value)


def filter_contains(df: DataFrame, column: str, value: str, literal: bool = False) -> DataFrame:
    """Case-insensitive regular-expression search, or plain substring with ``literal``."""
    c = quoted(column).cast("string")
    if literal:
        return df.filter(F.contains(F.lower(c), F.lit(value.lower())))
    return df.filter(c.rlike("(?iu)" + value))


def apply_filter(df: DataFrame, column: str, condition: str, value: object, on_error: str = "raise") -> DataFrame:
    """Dispatch on ``condition``; an unknown condition keeps all rows.

    ``on_error="keep"`` returns the table unfiltered when the column or number is unusable.
    """
    rules = {
        "equals": filter_equals,
        "greater than": filter_greater,
        "less than": filter_less,
        "contains": lambda d, c, v: filter_contains(d, c, str(v)),
    }
    rule = rules.get(condition.lower())
    if rule is None:
        return df
    try:
        filtered = rule(df, column, value)
        filtered.schema  # analyse now, so that a bad column surfaces here
        return filtered
    except Exception:
        if on_error == "keep":
            return df
        raise


def clear_filter(df: DataFrame) -> DataFrame:
    """The unfiltered table: filters never change their input, so this is the input itself."""
    return df


# --- projections ----------------------------------------------------------------------------------

def select_columns(
    df: DataFrame, cols: Sequence[str] | None = None, tokens: Sequence[str] | None = None, kind: str | None = None
) -> DataFrame:
    """Keep named columns, columns whose name contains a token (all if none does), or one kind."""
    names = list(cols) if cols else df.columns
    if tokens:
        matching = [n for n in names if any(t in n for t in tokens)]
        names = matching or names
    if kind:
        names = columns_of_kind(df, kind, names)
    return df.select(*[quoted(n) for n in names])


def preview(df: DataFrame, n: int = 1000, max_chars: int = 50, order_by=None) -> DataFrame:
    """The first ``n`` rows as display text: long strings cut, floats with two decimals, missing empty."""
    shown = df.orderBy(*order_columns(order_by)) if order_by is not None else df
    cells = []
    for f in df.schema.fields:
        c = missing_to_null(f.name, f.dataType)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            text = F.format_string("%.2f", c)
            text = F.when(c.isNotNull(), text)
        else:
            text = c.cast("string")
            text = F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars - 3), F.lit("..."))).otherwise(text)
        cells.append(F.coalesce(text, F.lit("")).alias(f.name))
    return shown.limit(n).select(*cells)


# --- slices and pages -----------------------------------------------------------------------------

def slice_rows(df: DataFrame, start: int, end: int, cols: Sequence[str] | None = None, order_by=None, deep: bool | None = None) -> DataFrame:
    """Rows ``start`` … ``end`` (1-based, inclusive, clamped) of the ordered table.

    Without ``order_by`` the stored order of a Parquet scan is used. ``deep`` says whether rows are found by
    counting or by a top-k, which gives the same rows; by default that depends on how far down they are.
    """
    start, end = max(1, int(start)), int(end)
    if end < start:
        raise ValueError("invalid range")
    return _rows_between(df, start - 1, end - start + 1, cols, order_by, deep)


def page(
    df: DataFrame, page: int, page_size: int = 100, order_by=None, cols: Sequence[str] | None = None, deep: bool | None = None
) -> DataFrame:
    """Page ``page`` (from 0); the page size is clamped to 10 … 5000 and the page to the last one."""
    size = min(max(int(page_size), PAGE_SIZES[0]), PAGE_SIZES[1])
    number = max(0, int(page))
    if number:
        number = min(number, max(0, df.count() - 1) // size)
    return _rows_between(df, number * size, size, cols, order_by, deep)


def page_count(df: DataFrame, page_size: int = 100) -> int:
    size = min(max(int(page_size), PAGE_SIZES[0]), PAGE_SIZES[1])
    return max(0, df.count() - 1) // size + 1


def _rows_between(df: DataFrame, offset: int, count: int, cols, order_by, deep: bool | None = None) -> DataFrame:
    names = list(cols) if cols else df.columns
    if order_by is None:
        df, order_by = file_order(df), ["_file_path", "_file_row"]
    if deep is None:
        deep = offset + count > SHALLOW_ROWS
    if not deep:
        chosen = df.orderBy(*order_columns(order_by)).offset(offset).limit(count)
    elif all(isinstance(key, str) for key in ([order_by] if isinstance(order_by, str) else order_by if not isinstance(order_by, Column) else [order_by])):
        return _sought(df, offset, count, [order_by] if isinstance(order_by, str) else list(order_by)).select(*[quoted(n) for n in names])
    else:
        indexed = with_row_index(df, order_by, "_index")
        chosen = indexed.filter((F.col("_index") >= offset) & (F.col("_index") < offset + count))
    return chosen.select(*[quoted(n) for n in names])


def _sought(df: DataFrame, offset: int, count: int, keys: Sequence[str]) -> DataFrame:
    """Rows ``offset`` … of the ascending order of ``keys``, found by counting.

    A few splitting keys are drawn from the rows that are still in question, one scan counts the rows before each of them, and
    only the stretch between the two splitters around the wanted rows stays in question, until it is short enough to sort.
    Ties are ordered by a hash of the row, so what then still ties are copies.
    """
    hashable = [quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    marked = df.select("*", F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64(*hashable).alias("h")).alias("_at"))
    types = [f.dataType for f in marked.schema["_at"].dataType.fields]

    def literal(key) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(key, types))])

    low = high = None
    before, inside = 0, marked.count()
    count = max(0, min(count, inside - offset))
    for step in range(60):
        here = marked
        if low is not None:
            here = here.filter(F.col("_at") >= literal(low))
        if high is not None:
            here = here.filter(F.col("_at") < literal(high))
        if inside <= max(SORTED_AT_ONCE, 2 * count) or not count:
            break
        drawn = here.sample(fraction=min(1.0, 4 * SPLITTERS**2 / inside), seed=step).select("_at").limit(8 * SPLITTERS**2).distinct().orderBy("_at").collect()
        keys_drawn = [tuple(r["_at"]) for r in drawn]
        every = max(1, len(keys_drawn) // SPLITTERS)
        splitters = [k for k in keys_drawn[::every] if k != low]
        counted = here.agg(*[F.count_if(F.col("_at") < literal(k)).alias(f"_{i}") for i, k in enumerate(splitters)]).first() if splitters else ()
        base, end = before, before + inside
        left = right = None
        for k, n in zip(splitters, counted):
            if base + n <= offset:
                left, before = k, base + n
            elif base + n >= offset + count and right is None:
                right, end = k, base + n
        if left is None and right is None:
            # no key splits the rest: copies of the lowest key come first, then it can go on
            least = tuple(here.agg(F.min("_at").alias("m")).first()["m"])
            copies = here.filter(F.col("_at") == literal(least))
            same = copies.count()
            taken = max(0, min(count, before + same - offset))
            first = copies.limit(taken).drop("_at")
            return first if taken == count else first.unionByName(_sought(df, offset + taken, count - taken, keys)) if taken else _above(df, marked, literal(least), offset - before - same, count, keys)
        low, high = left or low, right or high
        inside = end - before
    return here.orderBy("_at").offset(offset - before).limit(count).drop("_at")


def _above(df: DataFrame, marked: DataFrame, least: Column, offset: int, count: int, keys: Sequence[str]) -> DataFrame:
    """Rows after all copies of a key."""
    return _sought(marked.filter(F.col("_at") > least).drop("_at"), offset, count, keys)


def head(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    return _rows_between(df, 0, n, None, order_by)


def tail(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """The last ``n`` rows: the first ``n`` of the reversed order."""
    names = df.columns
    if order_by is None:
        df, order_by = file_order(df), ["_file_path", "_file_row"]
    backwards = [c.desc_nulls_last() for c in order_columns(order_by)]
    return df.orderBy(*backwards).limit(n).select(*[quoted(x) for x in names])


# --- sorts ----------------------------------------------------------------------------------------

def sort_asc(df: DataFrame, by: str | None = None) -> DataFrame:
    """Ascending by the first (or named) column, missing values last."""
    c = by or df.columns[0]
    return df.orderBy(missing_to_null(c, field_type(df, c)).asc_nulls_last())


def sort_desc(df: DataFrame, by: str | None = None) -> DataFrame:
    """Descending by the first (or named) column, missing values last."""
    c = by or df.columns[0]
    return df.orderBy(missing_to_null(c, field_type(df, c)).desc_nulls_last())


# --- samples --------------------------------------------------------------------------------------

def sample_rows(df: DataFrame, n: int = 10, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer), the same ones for the same seed and rows, however they are laid out.

    Every row has a random place by a seeded hash of ``keys`` (all columns by default); the rows with the smallest places are
    taken, in their order. Copies have places of their own without being told apart: they are counted, and the
    smallest of c places are drawn one after another by their spacings, as far as a bound that leaves little more than ``n`` places.
    Rows that only agree in ``keys`` are copies too, of which any one stands for all.
    """
    names = list(keys) if keys else groupable_columns(df)
    cells = []
    for c in names:
        dtype = field_type(df, c)
        value = nested_text(quoted(c), dtype) if isinstance(dtype, NESTED) else quoted(c)
        cells += [value, quoted(c).isNull()]
    marked = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("_row"), *[F.xxhash64(F.lit(seed), F.lit(k), *cells).alias(x) for k, x in enumerate("ab")])
    counted = materialize(marked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")))
    total = counted.agg(F.sum("c")).first()[0] or 0
    if n >= total:
        return df
    wanted = min(1.0, (n + 8 * math.sqrt(n) + 40) / total)
    for share in (wanted, 1.0):  # the bound fails about once in 10^9 samples
        places = materialize(counted.mapInArrow(lambda batches: _smallest_places(batches, n, share), "a long, b long, place double"))
        if share == 1 or places.count() >= n:
            break
    chosen = places.orderBy("place", "a", "b").limit(n)
    small = (lambda side: F.broadcast(side)) if n <= BROADCAST_ROWS else (lambda side: side)
    rows = marked.join(small(chosen.select("a", "b").distinct()), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("_row").alias("_row"))
    return small(chosen).join(rows, ["a", "b"]).orderBy("place", "a", "b").select("_row.*")


def _uniform(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Numbers in (0, 1] from two hashes and a number."""
    x = a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((k * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _smallest_places(batches: Iterator[pa.RecordBatch], most: int, share: float) -> Iterator[pa.RecordBatch]:
    """The places under a bound of rows (a, b) that occur c times, at most ``most`` each: sums of exponential spacings over the copies left."""
    bound = math.inf if share >= 1 else -math.log1p(-share)
    for batch in batches:
        a, b, c = (batch.column(k).to_numpy() for k in range(3))
        place, step = np.zeros(len(a)), 0
        while len(a):
            place = place - np.log(_uniform(a, b, step)) / (c - step)
            step += 1
            some = place <= bound
            a, b, c, place = a[some], b[some], c[some], place[some]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(place)], names=["a", "b", "place"])
            more = (c > step) & (step < most)
            a, b, c, place = a[more], b[more], c[more], place[more]


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


# --- values and their counts ----------------------------------------------------------------------

def top_values(df: DataFrame, column: str | None = None, k: int | None = 10, dropna: bool = True) -> DataFrame:
    """``(value, n)`` of the ``k`` most frequent values (all with ``None``), ties by value."""
    c = column or df.columns[0]
    value = missing_to_null(c, field_type(df, c))
    counted = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if dropna:
        counted = counted.filter(F.col("value").isNotNull())
    ordered = counted.orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return ordered if k is None else ordered.limit(k)


def top_values_all(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """``(column, value, n, rank)``: the ``k`` most frequent values of every text column."""
    names = list(columns) if columns else string_columns(df)
    counted = value_counts(df, names, "string")
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_n_plus_others(df: DataFrame, column: str, n: int = 9, at_most: int | None = None) -> DataFrame:
    """``(value, n)``: the ``n`` most frequent values and one ``Others`` row for the rest.

    With ``at_most`` levels or fewer (``n + 1`` by default) nothing is merged.
    """
    limit = at_most if at_most is not None else n + 1
    value = missing_to_null(column, field_type(df, column)).cast("string")
    counted = (
        df.select(value.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )
    leading = counted.orderBy(F.desc("n"), F.asc("value")).limit(limit + 1)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.asc("value"))
    ranked = leading.withColumn("_rank", F.row_number().over(order)).withColumn("_levels", F.max("_rank").over(Window.partitionBy(F.lit(0))))
    kept = ranked.filter((F.col("_levels") <= limit) | (F.col("_rank") <= n)).select("value", "n")
    total = counted.agg(F.sum("n")).scalar()
    others = (
        kept.agg(F.sum("n").alias("_shown"))
        .select(F.lit("Others").alias("value"), (total - F.col("_shown")).alias("n"))
        .filter(F.col("n") > 0)
    )
    return kept.unionByName(others)


def value_set(df: DataFrame, limit: int | None = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value)``: distinct values of each column as text, the first ``limit`` in sorted order."""
    names = list(columns) if columns else plain_columns(df)
    distinct = value_counts(df, names, "string").select("column", "value")
    if limit is None:
        return distinct
    order = Window.partitionBy("column").orderBy("value")
    return distinct.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def sample_values(df: DataFrame, column: str, n: int = 50, order_by=None) -> DataFrame:
    """The first ``n`` non-missing values of a column in the order of ``order_by``."""
    value = missing_to_null(column, field_type(df, column))
    if order_by is None:
        df, order_by = file_order(df), ["_file_path", "_file_row"]
    return df.filter(value.isNotNull()).orderBy(*order_columns(order_by)).limit(n).select(value.alias(column))


def top_k(df: DataFrame, by: Column | str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``by``."""
    c = quoted(by) if isinstance(by, str) else by
    return df.orderBy(c.desc_nulls_last()).limit(k)



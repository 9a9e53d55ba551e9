"""The value table: one row per (column, value) with its count, for many columns in one shuffle."""

from __future__ import annotations

from collections.abc import Iterable
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.kinds import INTEGRAL, NESTED, field_type, groupable_columns, missing_to_null, nested_text, quoted

from tablescope.operators.order import materialize


def column_struct(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("column"), value.alias("value"))


def value_counts(df: DataFrame, columns: Iterable[str], as_type: str, keep_missing: bool = False) -> DataFrame:
    """``(column, value, n)`` for columns cast to one common type.

    Counting happens before the shuffle as well, so a value that fills a third of a column is one row
    per task by the time it moves.
    """
    cells = [column_struct(c, _value_as(df, c, as_type)) for c in columns]
    long = df.select(F.inline(F.array(*cells)))
    if not keep_missing:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _value_as(df: DataFrame, name: str, as_type: str) -> Column:
    dtype = field_type(df, name)
    if isinstance(dtype, NESTED):
        return F.when(quoted(name).isNotNull(), nested_text(quoted(name), dtype))
    return missing_to_null(name, dtype).cast(as_type)


def _comparable(df: DataFrame, name: str) -> Column:
    dtype = field_type(df, name)
    return _value_as(df, name, "string") if isinstance(dtype, NESTED) else missing_to_null(name, dtype)


def type_families(df: DataFrame, columns: Iterable[str]) -> dict[str, list[str]]:
    """Columns grouped by the narrowest common type that keeps their values apart."""
    families: dict[str, list[str]] = {}
    for c in columns:
        dtype = field_type(df, c)
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            family = "bigint"
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            family = "double"
        else:
            family = "string"
        families.setdefault(family, []).append(c)
    return families


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None, approx: bool = False) -> DataFrame:
    """``(column, n_unique)``: distinct non-missing values, exact unless ``approx``."""
    names = list(columns) if columns is not None else groupable_columns(df)
    if approx:
        wide = df.agg(
            *[
                F.struct(F.lit(c).alias("column"), F.approx_count_distinct(_comparable(df, c)).alias("n_unique")).alias(f"_{i}")
                for i, c in enumerate(names)
            ]
        )
        return wide.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(names))])))
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    dense = _dense_columns(df, names)
    counted = [_bitmap_counts(df, dense)] if dense else []
    for family, cols in type_families(df, [c for c in names if c not in dense]).items():
        cells = df.select(F.inline(F.array(*[column_struct(c, _value_as(df, c, family) if family != "string" else _identity(df, c)) for c in cols])))
        distinct = cells.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("one"))
        counted.append(distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")))
    found = reduce(DataFrame.unionByName, counted)
    return every.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("n_unique", F.lit(0).cast("bigint")).alias("n_unique")
    )


def _identity(df: DataFrame, name: str) -> Column:
    """A value's text as bytes if it is short, else a mark no text begins with and its SHA-256 digest."""
    text = _value_as(df, name, "string")
    return F.when(F.octet_length(text) <= 32, text.cast("binary")).otherwise(F.concat(F.unhex(F.lit("FF")), F.unhex(F.sha2(text, 256))))


def _whole(df: DataFrame, name: str) -> Column | None:
    """Whole numbers and dates as a number."""
    dtype = field_type(df, name)
    if isinstance(dtype, INTEGRAL):
        return quoted(name).cast("bigint")
    return F.datediff(quoted(name), F.lit("1970-01-01").cast("date")).cast("bigint") if isinstance(dtype, T.DateType) else None


def _dense_columns(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Columns of whole numbers whose values lie close enough that one bit for each possible one, in every task, is less than
    the values themselves; with the smallest value."""
    whole = {c: v for c in names if (v := _whole(df, c)) is not None}
    if not whole:
        return {}
    row = df.agg(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).alias(f"_{i}") for i, v in enumerate(whole.values())]).first()
    tasks = df.rdd.getNumPartitions()
    facts = {c: row[f"_{i}"] for i, c in enumerate(whole)}
    return {c: f["lo"] for c, f in facts.items() if f["n"] and (f["hi"] - f["lo"] + 1 + 32768) * tasks <= 64 * f["n"]}


def _bitmap_counts(df: DataFrame, dense: dict[str, int]) -> DataFrame:
    """Distinct counts from mergeable bitmaps of 32768 values each: what moves is 4 kB for each bitmap a task touches."""
    offsets = [column_struct(c, _whole(df, c) - F.lit(lo) + 1) for c, lo in dense.items()]
    cells = df.select(F.inline(F.array(*offsets))).filter(F.col("value").isNotNull())
    maps = cells.groupBy("column", F.bitmap_bucket_number("value").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bits"))
    return maps.groupBy("column").agg(F.sum(F.bitmap_count("bits")).alias("n_unique"))


def per_column(df: DataFrame, columns: Iterable[str], metrics: dict[str, object], chunk: int = 40) -> DataFrame:
    """One aggregate over all ``columns``, returned as one row per column.

    ``metrics`` maps an output name to a function of the column's missing-free expression and its type
    that returns an aggregate. Wide tables are cut into chunks to stay inside generated-code limits.
    """
    names = list(columns)
    if not names:
        raise ValueError("no suitable columns")
    cells = [(c, [(k, fn(missing_to_null(c, field_type(df, c)), field_type(df, c))) for k, fn in metrics.items()]) for c in names]
    shared = _SHARED.get()
    if shared is not None and shared.df is df:
        found = shared.rows(cells)
        if found is not None:
            return found
    parts = []
    for start in range(0, len(names), chunk):
        some = cells[start : start + chunk]
        structs = [F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in values]).alias(f"_{i}") for i, (c, values) in enumerate(some)]
        parts.append(df.agg(*structs).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(some))]))))
    return reduce(DataFrame.unionByName, parts)


_SHARED: ContextVar[SharedAggregates | None] = ContextVar("shared", default=None)


class SharedAggregates:
    """The aggregates that several calls of ``per_column`` on one table ask for, worked out together.

    While it is entered, calls tell it what they ask for; after ``compute`` they take their rows from its result. Equal
    aggregates of equal columns are worked out once.
    """

    MOST = 400  # aggregates of one scan

    def __init__(self, df: DataFrame):
        self.df = df
        self.wanted: dict[str, Column] = {}
        self.place: dict[str, tuple[int, str]] = {}
        self.results: list[DataFrame] = []

    def __enter__(self) -> SharedAggregates:
        self.token = _SHARED.set(self)
        return self

    def __exit__(self, *_) -> None:
        _SHARED.reset(self.token)

    def compute(self) -> None:
        texts = list(self.wanted)
        for part, start in enumerate(range(0, len(texts), self.MOST)):
            some = texts[start : start + self.MOST]
            self.place.update({t: (part, f"_{i}") for i, t in enumerate(some)})
            self.results.append(materialize(self.df.agg(*[self.wanted[t].alias(f"_{i}") for i, t in enumerate(some)])))

    def rows(self, cells: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame | None:
        asked = [(c, [(k, str(v)) for k, v in values]) for c, values in cells]
        if not self.results:
            self.wanted.update({str(v): v for _, values in cells for _, v in values})
            return None
        if any(t not in self.place for _, values in asked for _, t in values):
            return None
        by_part: dict[int, list] = {}
        for c, values in asked:
            if len({self.place[t][0] for _, t in values}) > 1:
                return None
            by_part.setdefault(self.place[values[0][1]][0], []).append(F.struct(F.lit(c).alias("column"), *[F.col(self.place[t][1]).alias(k) for k, t in values]))
        return reduce(DataFrame.unionByName, [self.results[p].select(F.inline(F.array(*structs))) for p, structs in by_part.items()])


def excluded_categories(df: DataFrame, columns: list[str], kept: Iterable[str]) -> DataFrame:
    """``(column, n_levels)`` of the text columns that the cardinality gate leaves out; the number is a sketch's estimate."""
    out = [c for c in columns if c not in set(kept)]
    schema = "column string, n_levels bigint"
    if not out:
        return df.sparkSession.createDataFrame([], schema)
    rough = df.agg(*[F.approx_count_distinct(quoted(c), 0.02).alias(f"_{i}") for i, c in enumerate(out)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_levels")) for i, c in enumerate(out)])
    return rough.select(F.inline(rows))


def gated_categories(df: DataFrame, columns: list[str], max_levels: int, min_levels: int = 1) -> dict[str, int]:
    """Columns with ``min_levels`` … ``max_levels`` distinct values, and their counts.

    A sketch first rules out columns far above the limit; the values of the others are few, so their sets
    are built in one aggregate that moves nothing else.
    """
    if not columns:
        return {}
    rough = df.agg(*[F.approx_count_distinct(quoted(c), 0.02).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if rough[f"_{i}"] <= 2 * max_levels + 10]
    if not near:
        return {}
    exact = df.agg(
        *[F.size(F.collect_set(missing_to_null(c, field_type(df, c)))).alias(f"_{i}") for i, c in enumerate(near)]
    ).first()
    return {c: exact[f"_{i}"] for i, c in enumerate(near) if min_levels <= exact[f"_{i}"] <= max_levels}

"""Data quality: missing values, duplicates, zeros and negatives, outliers, category overviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.stats import ratio
from tablescope.kinds import column_kind, field_type, missing_to_null, normalize_missing, groupable_columns, numeric_columns, plain_columns, quoted
from tablescope.operators.freq import distinct_counts, per_column
from tablescope.operators.quantiles import exact_quantiles

COPIES_PER_STEP = 100_000


def missing_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, cols or df.columns, {"missing": lambda c, _: F.count_if(c.isNull())})


def valid_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, cols or df.columns, {"valid": lambda c, _: F.count(c)})


def missing_pct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    def pct(c: Column, _) -> Column:
        return F.round(ratio(F.count_if(c.isNull()), F.count(F.lit(1))) * 100, 2)

    return per_column(df, cols or df.columns, {"missing_pct": pct})


def _is_missing(df: DataFrame, column: str) -> Column:
    return missing_to_null(column, field_type(df, column)).isNull()


def rows_with_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with a missing value in any of the columns."""
    return df.filter(reduce(Column.__or__, [_is_missing(df, c) for c in (cols or df.columns)]))


def columns_with_missing(df: DataFrame) -> DataFrame:
    return missing_count(df).filter(F.col("missing") > 0)


def _row_groups(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """Distinct rows with their number of copies; copies collapse before the shuffle."""
    names = list(cols) if cols else groupable_columns(df)
    return normalize_missing(df, names).groupBy(*[quoted(n) for n in names]).agg(F.count(F.lit(1)).alias("_copies"))


def duplicate_rows_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return _row_groups(df, cols).agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def duplicate_rows_all_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows in any group of two or more equal rows."""
    repeated = F.when(F.col("_copies") > 1, F.col("_copies")).otherwise(0)
    return _row_groups(df, cols).agg(F.coalesce(F.sum(repeated), F.lit(0)).alias("duplicates"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The rows after the first of each group of equal rows.

    Equal rows are interchangeable, so groups are counted and the copies written out again, in steps
    that spread a large group over many tasks.
    """
    names = list(cols) if cols else groupable_columns(df)
    extra = _row_groups(df, names).filter(F.col("_copies") > 1).withColumn("_extra", F.col("_copies") - 1)
    steps = extra.withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_extra") - 1, F.lit(COPIES_PER_STEP).cast("bigint")))
    )
    spread = steps.repartition(*[quoted(n) for n in plain_columns(df, names)], "_from")
    until = F.least(F.col("_extra"), F.col("_from") + COPIES_PER_STEP)
    return spread.select(*[quoted(n) for n in names], F.explode(F.sequence(F.col("_from"), until - 1)).alias("_i")).drop("_i")


def column_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows beyond the first of each value, missing counted as a value."""
    names = list(cols) if cols else groupable_columns(df)
    counts = per_column(df, names, {"n_rows": lambda c, _: F.count(F.lit(1)), "nulls": lambda c, _: F.count_if(c.isNull())})
    return counts.join(F.broadcast(distinct_counts(df, names)), "column").select(
        "column", (F.col("n_rows") - F.col("n_unique") - (F.col("nulls") > 0).cast("bigint")).alias("duplicates")
    )


def zero_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Zeros per column; columns that are not numeric have none."""

    def zeros(c: Column, dtype) -> Column:
        return F.count_if(c == 0) if column_kind(dtype) == "numeric" else F.count_if(F.lit(False))

    return per_column(df, cols or df.columns, {"zeros": zeros})


def all_zero_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows in which every numeric value is zero."""
    return df.agg(F.count_if(_all_numbers(df, cols, lambda c: c == 0)).alias("rows"))


def negative_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, numeric_columns(df, cols), {"negatives": lambda c, _: F.count_if(c < 0)})


def all_negative_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows in which every numeric value is negative."""
    return df.agg(F.count_if(_all_numbers(df, cols, lambda c: c < 0)).alias("rows"))


def _all_numbers(df: DataFrame, cols, test) -> Column:
    names = numeric_columns(df, cols)
    if not names:
        return F.lit(False)
    return reduce(Column.__and__, [F.coalesce(test(missing_to_null(c, field_type(df, c))), F.lit(False)) for c in names])


def fences(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Per numeric column the interval outside which a value is an outlier."""
    names = numeric_columns(df, cols)
    got = exact_quantiles(df, names, (0.25, 0.75))
    out = {}
    for c in names:
        if (None, c, 0.25) in got:
            q1, q3 = got[None, c, 0.25], got[None, c, 0.75]
            out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """``(column, lower, upper, outliers)`` for the numeric columns that have outliers."""
    limits = fences(df, cols, k)
    if not limits:
        return df.sparkSession.createDataFrame([], "column string, lower double, upper double, outliers bigint")
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(lo).alias("lower"),
            F.lit(hi).alias("upper"),
            F.count_if((missing_to_null(c, field_type(df, c)) < lo) | (missing_to_null(c, field_type(df, c)) > hi)).alias("outliers"),
        ).alias(f"_{i}")
        for i, (c, (lo, hi)) in enumerate(limits.items())
    ]
    wide = df.agg(*cells)
    return wide.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cells))]))).filter(F.col("outliers") > 0)


def iqr_outlier_rows(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """The rows whose ``column`` lies outside the fences."""
    lo, hi = fences(df, [column], k)[column]
    c = missing_to_null(column, field_type(df, column))
    return df.filter((c < lo) | (c > hi))


def category_overview(df: DataFrame, column: str) -> DataFrame:
    """One row: totals, missing, distinct, most common value and its share of all rows."""
    value = missing_to_null(column, field_type(df, column)).cast("string")
    counted = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    first = F.min(F.when(present, F.struct((-F.col("n")).alias("neg"), "value")))
    return counted.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count(F.when(present, F.lit(1))).alias("unique"),
        first.alias("_first"),
    ).select(
        "total",
        "missing",
        "unique",
        F.col("_first.value").alias("most_common"),
        (-F.col("_first.neg")).alias("frequency"),
        (ratio(-F.col("_first.neg"), F.col("total")) * 100).alias("frequency_pct"),
    )


def category_shares(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """``(value, n, pct)`` of the ``k`` most common values, in percent of all rows."""
    value = missing_to_null(column, field_type(df, column)).cast("string")
    counted = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    top = counted.filter(F.col("value").isNotNull()).orderBy(F.desc("n"), "value").limit(k)
    return top.select("value", "n", (ratio(F.col("n"), total) * 100).alias("pct"))


def frequency_of_frequencies(df: DataFrame, column: str) -> DataFrame:
    """``(times, values)``: how many values occur a given number of times."""
    value = missing_to_null(column, field_type(df, column))
    counted = df.select(value.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy("times").agg(F.count(F.lit(1)).alias("values"))

"""Crosstabs, transposition, long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.kinds import missing_to_null, field_type, plain_columns, quoted
from tablescope.operators.corr import corr_matrix
from tablescope.operators.order import materialize, order_columns, sized

MAX_WIDE_LEVELS = 1_000
MAX_TRANSPOSED_ROWS = 1_000


def _two(df: DataFrame, a: str | None, b: str | None) -> tuple[str, str]:
    if len(df.columns) < 2:
        raise ValueError("not enough columns")
    return a or df.columns[0], b or df.columns[1]


def crosstab(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``(v1, v2, n)`` for every combination that occurs; rows with a missing side are dropped."""
    a, b = _two(df, a, b)
    v1, v2 = missing_to_null(a, field_type(df, a)), missing_to_null(b, field_type(df, b))
    return (
        df.select(v1.cast("string").alias("v1"), v2.cast("string").alias("v2"))
        .filter(F.col("v1").isNotNull() & F.col("v2").isNotNull())
        .groupBy("v1", "v2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab_wide(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per level of ``a``, one column per level of ``b``, absent combinations 0."""
    a, b = _two(df, a, b)
    long = crosstab(df, a, b)
    levels = [r["v2"] for r in long.select("v2").distinct().orderBy("v2").limit(MAX_WIDE_LEVELS + 1).collect()]
    if len(levels) > MAX_WIDE_LEVELS:
        raise ValueError(f"{b} has more than {MAX_WIDE_LEVELS} levels; use crosstab()")
    return long.groupBy(F.col("v1").alias(a)).pivot("v2", levels).agg(F.sum("n")).na.fill(0)


def crosstab_heatmap(df: DataFrame, a: str, b: str, metric: str = "lift", max_levels: int | None = None) -> DataFrame:
    """``(v1, v2, n, value)`` over all levels of both columns, or their ``max_levels`` most frequent; value is the count or the lift.

    Margins are those of the table that remains after other levels are dropped.
    """

    def leading(column: str) -> list:
        value = missing_to_null(column, field_type(df, column)).cast("string")
        counts = df.select(value.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(max_levels).collect()]

    cells = crosstab(df, a, b)
    if max_levels is not None:
        cells = cells.filter(F.col("v1").isin(leading(a)) & F.col("v2").isin(leading(b)))
    n = F.col("n").cast("double")
    if metric != "lift":
        return cells.select("v1", "v2", "n", n.alias("value"))
    cells = materialize(cells)  # read for both margins
    rows, columns = (sized(cells.groupBy(v).agg(F.sum("n").alias(name))) for v, name in (("v1", "_r"), ("v2", "_c")))
    total = rows.agg(F.sum("_r")).first()[0]
    expected = F.greatest(F.col("_r").cast("double") * F.col("_c") / F.lit(total), F.lit(1e-9))
    return cells.join(rows, "v1").join(columns, "v2").select("v1", "v2", "n", (n / expected).alias("value"))


def transpose(df: DataFrame, n: int = 5, order_by=None) -> DataFrame:
    """The first ``n`` rows turned: one row per column, one text column per row."""
    if n > MAX_TRANSPOSED_ROWS:
        raise ValueError(f"transpose shows at most {MAX_TRANSPOSED_ROWS} rows")
    names = plain_columns(df)
    first = df.orderBy(*order_columns(order_by)).limit(n) if order_by is not None else df.limit(n)
    keys = order_columns(order_by) if order_by is not None else [F.monotonically_increasing_id()]
    numbered = first.select(
        *[quoted(c).cast("string").alias(c) for c in names],
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).alias("_row"),
    )
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), quoted(c).alias("value")) for i, c in enumerate(names)])
    long = numbered.select("_row", F.inline(cells))
    return (
        long.groupBy("position", "column")
        .pivot("_row", list(range(1, n + 1)))
        .agg(F.first("value"))
        .select("column", *[quoted(str(i)).alias(f"row{i}") for i in range(1, n + 1)])
    )


def unpivot(df: DataFrame, ids: Sequence[str | Column], values: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def stacked_correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The whole correlation matrix in long form: both orders of every pair, and the diagonal."""
    upper = corr_matrix(df, "pearson", cols).select("col1", "col2", "r")
    lower = upper.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r")
    names = upper.select(F.explode(F.array("col1", "col2")).alias("col1")).distinct()
    return upper.unionByName(lower).unionByName(names.select("col1", F.col("col1").alias("col2"), F.lit(1.0).alias("r")))

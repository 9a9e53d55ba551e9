"""Column profiles: one row per column, all columns in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.stats import corrected_kurtosis, corrected_skewness, ratio
from tablescope.kinds import (
    column_kind,
    double_sql,
    doubles,
    field_type,
    missing_to_null,
    name_sql,
    numeric_columns,
    groupable_columns,
    quoted,
    text_sql,
)
from tablescope.operators.freq import distinct_counts, per_column, type_families, value_counts
from tablescope.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _is_number(dtype: T.DataType) -> bool:
    return column_kind(dtype) == "numeric"


def _numeric(fn):
    """An aggregate for numeric columns, NULL for the others."""
    return lambda c, dtype: fn(c.cast("double")) if _is_number(dtype) else F.lit(None).cast("double")


COUNTS = {
    "n_rows": lambda c, _: F.count(F.lit(1)),
    "count": lambda c, _: F.count(c),
    "nulls": lambda c, _: F.count_if(c.isNull()),
}
BASICS = {"mean": _numeric(F.avg), "min": _numeric(F.min), "max": _numeric(F.max)}


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mean, std, min, max, skew, kurtosis)`` of numeric columns.

    One pass finds means and ranges, the second sums powers of the distance from the mean: four additions
    per cell and column instead of one central-moment buffer per statistic.
    """
    columns = list(columns)
    basics = {r["column"]: r for r in per_column(df, columns, BASICS).collect()}

    cells = []
    for i, c in enumerate(columns):
        facts = basics[c]
        gap = f"({name_sql(c)} - {double_sql(facts['mean'] or 0.0)})"
        known = ", ".join(f"'{k}', {'double(NULL)' if facts[k] is None else double_sql(facts[k])}" for k in ("mean", "min", "max"))
        sums = ", ".join(f"'s{k}', sum({' * '.join([gap] * k)})" for k in (1, 2, 3, 4))
        cells.append(F.expr(f"named_struct('column', {text_sql(c)}, 'n', double(count({name_sql(c)})), {known}, {sums}) AS _{i}"))
    long = doubles(df, columns).agg(*cells).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cells))])))
    return long.select("column", "mean", *(e.alias(k) for k, e in _shape(F.col("n"), F.col("max") > F.col("min")).items()), "min", "max")


def _shape(n: Column, varies: Column) -> dict[str, Column]:
    """Standard deviation, G1 and G2 from the power sums s1 … s4 around a point near the mean."""
    size = F.nullif(n, F.lit(0.0))
    d, a2, a3, a4 = (F.col(f"s{k}") / size for k in (1, 2, 3, 4))
    m2 = a2 - d * d
    m3 = a3 - 3 * d * a2 + 2 * d * d * d
    m4 = a4 - 4 * d * a3 + 6 * d * d * a2 - 3 * d * d * d * d
    variance = F.greatest(m2, F.lit(0.0)) * n / F.nullif(n - 1, F.lit(0.0))
    spread = F.nullif(m2, F.lit(0.0))
    return {
        "std": F.when(varies, F.sqrt(variance)).when(n > 1, 0.0),
        "skew": F.when(n < 3, None).when(~varies, 0.0).otherwise(corrected_skewness(m3 / (spread * F.sqrt(spread)), n)),
        "kurtosis": F.when(n < 4, None).when(~varies, 0.0).otherwise(corrected_kurtosis(m4 / (spread * spread) - 3, n)),
    }


def type_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    wanted = set(columns) if columns is not None else set(df.columns)
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields) if f.name in wanted]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUARTILES, names: Sequence[str] | None = None) -> DataFrame:
    """``(column, q…)``; runs the quantile passes now, the result is one row per column."""
    labels = list(names) if names else [f"q{round(p * 100)}" for p in probs]
    got = exact_quantiles(df, columns, probs)
    rows = [(c, *[got.get((None, c, p)) for p in probs]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{n} double" for n in labels))


def _without_moments(counts: DataFrame) -> DataFrame:
    names = ("mean", "std", "min", "max", "skew", "kurtosis")
    return counts.select("*", *[F.lit(None).cast("double").alias(n) for n in names])


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """dtype, missing, distinct, moments, exact quartiles, IQR and bias-corrected shape per column."""
    names = list(cols) if cols else groupable_columns(df)
    numbers = numeric_columns(df, names)
    counts = per_column(df, names, COUNTS)
    base = counts.join(F.broadcast(moments(df, numbers)), "column", "left") if numbers else _without_moments(counts)
    out = (
        type_table(df, names)
        .join(F.broadcast(base), "column")
        .join(F.broadcast(distinct_counts(df, names, approx)), "column")
        .join(F.broadcast(quantile_table(df, numbers)), "column", "left")
    )
    enough = F.col("count") > 2
    return out.select(
        "column",
        "dtype",
        "n_rows",
        "count",
        "nulls",
        F.col("n_unique").alias("unique"),
        (ratio(F.col("nulls"), F.col("n_rows")) * 100).alias("missing_pct"),
        "mean",
        "std",
        "min",
        "q25",
        "q50",
        "q75",
        "max",
        F.when(enough, F.col("q75") - F.col("q25")).alias("iqr"),
        "skew",
        "kurtosis",
    )


def column_profile_basic(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type, distinct values with missing as a value, missing, present, and min/max/mean of numbers."""
    names = list(cols) if cols else groupable_columns(df)
    base = per_column(df, names, COUNTS | BASICS)
    out = type_table(df, names).join(F.broadcast(base), "column").join(F.broadcast(distinct_counts(df, names)), "column")
    return out.select(
        "column",
        "dtype",
        (F.col("n_unique") + (F.col("nulls") > 0).cast("bigint")).alias("unique_incl_missing"),
        "nulls",
        "count",
        "min",
        "max",
        "mean",
    )


def quick_eda(df: DataFrame) -> DataFrame:
    """Rows, columns, type and missing count per column."""
    return (
        type_table(df)
        .join(F.broadcast(per_column(df, df.columns, {k: COUNTS[k] for k in ("n_rows", "nulls")})), "column")
        .select("column", "dtype", "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "nulls")
    )


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max of the numeric columns."""
    numbers = numeric_columns(df, cols)
    base = per_column(df, numbers, {"count": COUNTS["count"], "std": _numeric(F.stddev_samp)} | BASICS)
    return base.join(F.broadcast(quantile_table(df, numbers)), "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, distinct, most frequent value and its frequency of the text columns."""
    names = [c for c in (cols or groupable_columns(df)) if column_kind(field_type(df, c)) == "categorical"]
    counted = value_counts(df, names, "string")
    first = F.min(F.struct((-F.col("n")).alias("neg"), "value"))
    return counted.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), first.alias("_first")).select(
        "column", "count", "unique", F.col("_first.value").alias("top"), (-F.col("_first.neg")).alias("freq")
    )


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``describe`` and ``describe_categorical`` in one table."""
    parts = []
    if numeric_columns(df, cols):
        parts.append(describe(df, cols))
    if any(column_kind(f.dataType) == "categorical" for f in df.schema.fields if cols is None or f.name in cols):
        parts.append(describe_categorical(df, cols))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def table_info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-missing count of every column."""
    counts = per_column(df, df.columns, {"non_null": COUNTS["count"]})
    return type_table(df).join(F.broadcast(counts), "column").select("position", "column", "non_null", "dtype")


def dtypes(df: DataFrame) -> DataFrame:
    return type_table(df).select("column", "dtype")


def column_names(df: DataFrame) -> DataFrame:
    return type_table(df).select("position", "column")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def quality_summary(df: DataFrame) -> DataFrame:
    nulls = per_column(df, df.columns, {"nulls": COUNTS["nulls"]})
    return type_table(df).join(F.broadcast(nulls), "column").select("column", "dtype", "nulls")


def row_index_info(df: DataFrame) -> DataFrame:
    """The range a row index would cover."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(0).cast("bigint").alias("start"), F.col("n_rows").alias("stop"), F.lit(1).cast("bigint").alias("step")
    )


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and whether ``keys`` identify a row."""
    sizes = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn(
        "is_unique", F.col("n_rows") == F.col("n_keys")
    )


def nunique(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    return distinct_counts(df, cols, approx)


def unique_ratio(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-missing values in percent of the rows, two decimals."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    return distinct_counts(df, cols, approx).select(
        "column", F.round(ratio(F.col("n_unique"), rows) * 100, 2).alias("unique_pct")
    )


def _numeric_table(df, cols, metrics) -> DataFrame:
    return per_column(df, numeric_columns(df, cols), metrics)


def std(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _numeric_table(df, cols, {"std": _numeric(F.stddev_samp)})


def variance(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _numeric_table(df, cols, {"variance": _numeric(F.var_samp)})


def sem(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    def standard_error(c: Column) -> Column:
        return F.stddev_samp(c) / F.nullif(F.sqrt(F.count(c)), F.lit(0.0))

    return _numeric_table(df, cols, {"sem": _numeric(standard_error)})


def skewness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return moments(df, numeric_columns(df, cols)).select("column", "skew")


def kurtosis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return moments(df, numeric_columns(df, cols)).select("column", "kurtosis")


def min_max(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Smallest and largest value of every column, as text."""
    names = list(cols) if cols else groupable_columns(df)
    return per_column(
        df, names, {"min": lambda c, _: F.min(c).cast("string"), "max": lambda c, _: F.max(c).cast("string")}
    )


def quantiles(df: DataFrame, probs: Sequence[float] = QUARTILES, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, p, value)``, exact and linearly interpolated."""
    numbers = numeric_columns(df, cols)
    got = exact_quantiles(df, numbers, probs)
    rows = [(c, float(p), got.get((None, c, p))) for c in numbers for p in probs]
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")


def _modes(counted: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.col("n")).alias("neg"), "value"))
    return counted.groupBy("column").agg(first.alias("_first")).select(
        "column", F.col("_first.value").alias("mode"), (-F.col("_first.neg")).alias("n")
    )


def mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The most frequent value of every column as text; on ties the smallest value of its own type."""
    names = list(cols) if cols else groupable_columns(df)
    parts = [
        _modes(value_counts(df, some, family)).withColumn("mode", F.col("mode").cast("string"))
        for family, some in type_families(df, names).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _modes(value_counts(df, numeric_columns(df, cols), "double"))


def all_modes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every value that reaches the highest frequency of its column."""
    names = list(cols) if cols else groupable_columns(df)
    counted = value_counts(df, names, "string")
    highest = counted.groupBy("column").agg(F.max("n").alias("n"))
    return counted.join(F.broadcast(highest), ["column", "n"]).select("column", "value", "n")


def group_means(df: DataFrame, by: str | None = None) -> DataFrame:
    """Mean of every numeric column per level of ``by`` (the first column by default)."""
    key = by or df.columns[0]
    numbers = [c for c in numeric_columns(df) if c != key]
    k = missing_to_null(key, field_type(df, key))
    return (
        df.filter(k.isNotNull())
        .groupBy(quoted(key))
        .agg(*[F.avg(missing_to_null(c, field_type(df, c)).cast("double")).alias(c) for c in numbers])
    )


def group_stats(df: DataFrame, cat: str, num: str, digits: int = 3) -> DataFrame:
    """Mean, standard deviation and count of ``num`` per level of ``cat``."""
    v = missing_to_null(num, field_type(df, num)).cast("double")
    return (
        df.filter(quoted(cat).isNotNull())
        .groupBy(quoted(cat).alias("level"))
        .agg(F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_samp(v), digits).alias("std"), F.count(v).alias("n"))
    )

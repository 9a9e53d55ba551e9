"""Column kinds and the one missing-value rule every operator shares."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def column_kind(dtype: T.DataType) -> str:
    """numeric | categorical | datetime | boolean | other, the kinds the selectors use."""
    if isinstance(dtype, INTEGRAL + FRACTIONAL):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, DATETIME):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def columns_of_kind(df: DataFrame, kind: str, among: Iterable[str] | None = None) -> list[str]:
    wanted = set(among) if among is not None else None
    return [
        f.name
        for f in df.schema.fields
        if column_kind(f.dataType) == kind and (wanted is None or f.name in wanted)
    ]


def numeric_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    """Numbers without Booleans."""
    return columns_of_kind(df, "numeric", among)


def string_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    return columns_of_kind(df, "categorical", among)


def datetime_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    return columns_of_kind(df, "datetime", among)


def plain_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    """Columns that can be compared and grouped as one value (no arrays, maps, structs)."""
    wanted = set(among) if among is not None else None
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, NESTED) and (wanted is None or f.name in wanted)
    ]


def groupable_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    """Columns whose values can be told apart: all but variants. Arrays, structs and maps count by their content."""
    wanted = set(among) if among is not None else None
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.VariantType) and (wanted is None or f.name in wanted)]


def _with_sorted_maps(value: Column, dtype: T.DataType) -> Column:
    """The value with every map in it as entries in key order, so that equal maps look equal."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _with_sorted_maps(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_with_sorted_maps(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(_with_sorted_maps(e["key"], dtype.keyType).alias("key"), _with_sorted_maps(e["value"], dtype.valueType).alias("value")),
        )
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return value


def nested_text(value: Column, dtype: T.DataType) -> Column:
    """A nested value as text, the same for equal values only."""
    return F.to_json(F.struct(_with_sorted_maps(value, dtype).alias("v")), {"ignoreNullFields": "false"})


def field_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def quoted(name: str) -> Column:
    """The column with exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


# Long lists of aggregates are written as SQL text: every Column operation in Python is a call into the JVM,
# while a whole expression in text is one.


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_sql(value: float) -> str:
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"({float(value)!r}D)"


def missing_to_null(name: str, dtype: T.DataType) -> Column:
    """NaN and NULL are one concept here: missing."""
    c = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def normalize_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Project ``columns`` (all by default) with NaN turned into NULL."""
    names = list(columns) if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[missing_to_null(n, types[n]).alias(n) for n in names])


def doubles_of(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN turned into NULL."""
    return missing_to_null(name, field_type(df, name)).cast("double")


def doubles(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Project numeric ``columns`` as doubles with NaN turned into NULL."""
    return df.select(*[doubles_of(df, n).alias(n) for n in columns])

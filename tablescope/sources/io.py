"""Reading and writing tables, narrowing their types, sizing their columns."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from pathlib import PurePath
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.stats import ratio
from tablescope.kinds import NESTED, column_kind, field_type, groupable_columns, nested_text, quoted
from tablescope.operators.freq import distinct_counts, per_column
from tablescope.operators.order import materialize, with_row_index

FORMATS = ("csv", "json", "parquet")
PREVIEW_ROWS = 50_000
CORRUPT = "_corrupt_record"
CSV = {"header": True, "quote": '"', "escape": '"'}


def _format_of(path: str, fmt: str | None) -> str:
    name = (fmt or PurePath(path).suffix.lstrip(".")).lower()
    if name not in FORMATS:
        raise ValueError(f"unsupported format: {name or path}")
    return name


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: str | T.StructType | None = None,
    dtype_map: Mapping[str, str] | None = None,
    nrows: int | None = None,
    max_rows: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV (with header), JSON lines or Parquet.

    Without ``schema`` CSV and JSON types are inferred from every row, as a value further down may need a wider type.
    ``dtype_map`` sets the types of single columns while they are read (``"string"`` keeps leading zeros); what does
    not parse is NULL. Quotes within quoted CSV text are doubled. ``multi_line`` allows line breaks
    within quotes (see ``csv_records``); a ``schema`` saves the inference, which takes such a file in one task. ``nrows`` or ``max_rows`` cut the result.
    """
    kind = _format_of(path, fmt)
    reader = spark.read
    if kind == "csv":
        reader = reader.options(**CSV, multiLine=multi_line)
    if kind == "csv" and multi_line:
        return _cut(_read_records(spark, path, reader, schema, dtype_map), nrows, max_rows)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    df = reader.format(kind).load(path)
    mapped = {n: t for n, t in (dtype_map or {}).items() if n in df.columns}
    if mapped and kind != "parquet":
        # read the mapped columns as written, not as inferred
        fields = [T.StructField(f.name, T.StringType()) if f.name in mapped else f for f in df.schema.fields]
        df = reader.schema(T.StructType(fields)).format(kind).load(path)
    for name, dtype in mapped.items():
        df = df.withColumn(name, quoted(name).try_cast(dtype))
    return _cut(df, nrows, max_rows)


def _cut(df: DataFrame, *limits: int | None) -> DataFrame:
    known = [n for n in limits if n is not None]
    return df.limit(min(known)) if known else df


def _read_records(spark: SparkSession, path: str, reader, schema: str | T.StructType | None, dtype_map: Mapping[str, str] | None) -> DataFrame:
    """CSV whose quoted text holds line breaks, each file read in as many splits as its size asks for."""
    full = _as_struct(spark, schema) if schema is not None else reader.option("inferSchema", True).csv(path).schema
    mapped = {n: t for n, t in (dtype_map or {}).items() if n in full.names}
    full = T.StructType([T.StructField(f.name, T.StringType()) if f.name in mapped else f for f in full.fields])
    options = {"quote": CSV["quote"], "escape": CSV["escape"], "multiLine": "true"}
    parsed = csv_records(spark, path).select(F.from_csv("record", F.lit(full.toDDL()), options).alias("r")).select("r.*")
    return parsed.select(*[quoted(f.name).try_cast(mapped[f.name]).alias(f.name) if f.name in mapped else quoted(f.name) for f in full.fields])


_WHOLE, _HEAD, _TAIL, _MIDDLE = range(4)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files without their headers, one text each, line breaks within quotes included.

    A line break ends a record if the number of quotes before it is even (quotes in quoted text are doubled; unquoted text has none).
    One scan counts the quotes of each split of a file, a sum over splits tells which of them begin within quotes, and the
    splits are then cut into records each by itself. Records that go on in another split are put together from their pieces.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row a split
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("q")).withColumn("odd", F.sum("q").over(before) % 2 == 1)
    within = splits.filter("odd").select(F.xxhash64("file", "start").alias("key"), F.lit(True).alias("open"))  # 16 bytes a split
    told = lines.withColumn("key", F.xxhash64("file", "start")).join(F.broadcast(within), "key", "left").select("file", "start", "value", "open")
    pieces = told.mapInArrow(_cut_records, "file string, start long, kind int, text string")
    order = Window.partitionBy("file").orderBy("start", "kind")
    broken = pieces.filter(F.col("kind") != _WHOLE).withColumn("number", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
    joined = broken.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("p"))
    mended = joined.select(F.array_join(F.col("p.text"), "\n").alias("record"))
    whole = pieces.filter(F.col("kind") == _WHOLE).select(F.col("text").alias("record"))
    return whole.unionByName(mended).select(F.regexp_replace("record", r"\r\z", "").alias("record")).filter("record != ''")


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of each split into records; those at its ends that lie in other splits as well are marked as pieces."""
    split, held, inside, begun, header = None, [], False, False, False
    out: list[tuple] = []
    size = 0

    def give(kind: int) -> None:
        nonlocal held, size, header
        text = "\n".join(held)
        held = []
        if header:
            header = False  # the first record of a file
            return
        out.append((*split, kind, text))
        size += len(text)

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["file", "start", "kind", "text"])
        out, size = [], 0
        return batch

    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            for file, start, line, within in zip(*[c.to_pylist() for c in batch.slice(first, 4096).columns]):
                if (file, start) != split:
                    if held:
                        give(_TAIL if begun else _MIDDLE)
                    split, inside, begun, header = (file, start), bool(within), not within, start == 0
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    give(_WHOLE if begun else _HEAD)
                    begun = True
            if size > 4 << 20:
                yield flush()
    if held:
        give(_TAIL if begun else _MIDDLE)
    if out:
        yield flush()


def union_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several tables, matched by column name."""
    for other in others:
        first = first.unionByName(other)
    return first


def read_preview(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, n: int = PREVIEW_ROWS
) -> DataFrame:
    """The first ``n`` rows of a CSV; rows that do not fit the schema keep their text in ``_corrupt_record``.

    Without ``schema`` types are inferred from these rows alone.
    """
    if schema is None:
        schema = _narrowest(spark.read.options(**CSV).csv(path).limit(n))
    full = T.StructType([*_as_struct(spark, schema).fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full)
        .options(**CSV)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
        .limit(n)
    )


def _narrowest(texts: DataFrame) -> T.StructType:
    """The first type that every value of a text column parses as, for each column."""
    types = ("int", "bigint", "double", "boolean", "timestamp")
    fits = [F.count_if(quoted(c).isNotNull() & quoted(c).try_cast(t).isNull()).alias(f"{i}_{t}") for i, c in enumerate(texts.columns) for t in types]
    found = texts.agg(*fits, *[F.count(quoted(c)).alias(f"{i}") for i, c in enumerate(texts.columns)]).first()
    chosen = [next((t for t in types if found[f"{i}"] and not found[f"{i}_{t}"]), "string") for i in range(len(texts.columns))]
    return T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in zip(texts.columns, chosen)])


def _as_struct(spark: SparkSession, schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def preview_quality(preview: DataFrame) -> DataFrame:
    """Rows shown and rows that did not fit the schema.

    Whether a row fits depends on all its columns, so the preview (a bounded number of rows) is parsed
    whole and kept before the corrupt ones are counted.
    """
    return materialize(preview.select(*preview.columns)).agg(F.count(F.lit(1)).alias("n_rows"), F.count(CORRUPT).alias("corrupt_rows"))


def write_table(
    df: DataFrame, path: str, fmt: str | None = None, with_index: bool = False, order_by=None, mode: str = "overwrite"
) -> str:
    """Write CSV (with header), JSON lines or Parquet; with a row-number column if asked for."""
    kind = _format_of(path, fmt)
    if with_index:
        if order_by is None:
            raise ValueError("with_index needs order_by")
        names = df.columns
        df = with_row_index(df, order_by, "index").select("index", *[quoted(c) for c in names])
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.options(**CSV, escapeQuotes=True)
    writer.format(kind).save(path)
    return path


def write_report(results: Mapping[str, DataFrame | Any], path: str, mode: str = "overwrite") -> dict[str, str]:
    """Write every result table of a bundle as JSON lines below ``path``; returns where each went."""
    written = {}
    for name, value in results.items():
        if isinstance(value, DataFrame):
            target = f"{path.rstrip('/')}/{name}"
            value.write.mode(mode).json(target)
            written[name] = target
    return written


def report_text(summary: Mapping[str, Any]) -> str:
    """A small summary as pretty JSON, other scripts kept as they are."""
    return json.dumps(summary, ensure_ascii=False, indent=2, default=str)


# --- narrowing ------------------------------------------------------------------------------------

# Ranges of the narrower integer types. Spark has no unsigned ones, so each unsigned range
# takes the next wider signed type.
UNSIGNED_TARGETS = [(256, "smallint"), (65_536, "int"), (4_294_967_296, "bigint")]
SIGNED_TARGETS = [(-128, 127, "tinyint"), (-32_768, 32_767, "smallint"), (-2_147_483_648, 2_147_483_647, "int")]
DICTIONARY_RATIO = 0.5
INTEGER_WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def narrow_plan(df: DataFrame, narrow_floats: bool = False) -> DataFrame:
    """``(column, dtype, target, dictionary_candidate)`` from each column's range and distinct share."""
    names = groupable_columns(df)
    facts = per_column(
        df,
        names,
        {
            "n_rows": lambda c, _: F.count(F.lit(1)),
            "lo": lambda c, t: F.min(c).cast("bigint") if t.typeName() in _INTEGRAL else F.lit(None).cast("bigint"),
            "hi": lambda c, t: F.max(c).cast("bigint") if t.typeName() in _INTEGRAL else F.lit(None).cast("bigint"),
        },
    )
    texts = [c for c in names if column_kind(field_type(df, c)) == "categorical"]
    types = df.sparkSession.createDataFrame([(c, field_type(df, c).simpleString()) for c in names], "column string, dtype string")
    out = types.join(F.broadcast(facts), "column")
    if texts:
        out = out.join(F.broadcast(distinct_counts(df, texts)), "column", "left")
    else:
        out = out.withColumn("n_unique", F.lit(None).cast("bigint"))
    target = F.when(F.col("dtype").isin(*_INTEGRAL_NAMES) & F.col("lo").isNotNull(), _integer_target()).otherwise(F.col("dtype"))
    if narrow_floats:
        target = F.when(F.col("dtype") == "double", "float").otherwise(target)
    candidate = F.coalesce(ratio(F.col("n_unique"), F.col("n_rows")) < DICTIONARY_RATIO, F.lit(False))
    return out.select("column", "dtype", target.alias("target"), candidate.alias("dictionary_candidate"))


_INTEGRAL = ("byte", "short", "integer", "long")
_INTEGRAL_NAMES = tuple(INTEGER_WIDTHS)


def _integer_target() -> Column:
    unsigned = signed = F.lit("bigint")
    for limit, name in reversed(UNSIGNED_TARGETS):
        unsigned = F.when(F.col("hi") < limit, name).otherwise(unsigned)
    for low, high, name in reversed(SIGNED_TARGETS):
        signed = F.when((F.col("lo") >= low) & (F.col("hi") <= high), name).otherwise(signed)
    wanted = F.when(F.col("lo") >= 0, unsigned).otherwise(signed)
    width = F.create_map(*[F.lit(x) for item in INTEGER_WIDTHS.items() for x in item])
    return F.when(width[wanted] < width[F.col("dtype")], wanted).otherwise(F.col("dtype"))


def narrow_schema(df: DataFrame, narrow_floats: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table cast to its narrowest types, and the plan it follows (one row per column)."""
    plan = narrow_plan(df, narrow_floats)
    targets = {r["column"]: r["target"] for r in plan.collect()}
    narrowed = df.select(*[quoted(c).cast(targets[c]).alias(c) if c in targets else quoted(c) for c in df.columns])
    return narrowed, plan


# --- footprint ------------------------------------------------------------------------------------

def _fixed_width(dtype: T.DataType) -> int | None:
    # Bytes per value.
    widths = {
        "boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8,
        "date": 4, "timestamp": 8, "timestamp_ntz": 8,
    }
    return widths.get(dtype.typeName())


def storage_footprint(df: DataFrame) -> DataFrame:
    """``(column, dtype, bytes, narrowed_bytes)``: data size now and after narrowing.

    Fixed-width values count their width, arrays of them the width of their elements, text its bytes, other nested
    values the bytes of their JSON text; a dictionary-encoded text column is not counted
    as narrower, because the files encode dictionaries by themselves.
    """
    names = groupable_columns(df)

    def size(c: Column, dtype: T.DataType) -> Column:
        width = _fixed_width(dtype)
        if width is not None:
            return F.count(c) * F.lit(width).cast("bigint")
        if isinstance(dtype, T.ArrayType) and _fixed_width(dtype.elementType) is not None:
            filled = F.size(F.filter(c, lambda x: x.isNotNull())).cast("bigint") * _fixed_width(dtype.elementType)
            return F.coalesce(F.sum(F.when(c.isNotNull(), filled)), F.lit(0).cast("bigint"))
        text = nested_text(c, dtype) if isinstance(dtype, NESTED) else c.cast("string")
        return F.coalesce(F.sum(F.when(c.isNotNull(), F.octet_length(text).cast("bigint"))), F.lit(0).cast("bigint"))

    sizes = per_column(df, names, {"bytes": size, "_values": lambda c, _: F.count(c)})
    width = F.create_map(*[F.lit(x) for item in INTEGER_WIDTHS.items() for x in item])
    narrowed = F.when(F.col("dtype").isin(*_INTEGRAL_NAMES), F.col("_values") * width[F.col("target")].cast("bigint")).otherwise(F.col("bytes"))
    return sizes.join(F.broadcast(narrow_plan(df)), "column").select("column", "dtype", "bytes", narrowed.alias("narrowed_bytes"))


def footprint_summary(df: DataFrame) -> DataFrame:
    """Total, largest column, and how much narrowing would save (above 30 % high, above 15 % medium)."""
    per = storage_footprint(df)
    largest = F.min(F.struct((-F.col("bytes")).alias("neg"), "column"))
    total, small = F.sum("bytes"), F.sum("narrowed_bytes")
    saved = ratio(total - small, total) * 100
    return per.agg(total.alias("total_bytes"), small.alias("narrowed_bytes"), largest.alias("_largest"), saved.alias("saved_pct")).select(
        "total_bytes",
        (F.col("total_bytes") / (1024 * 1024)).alias("total_mb"),
        "narrowed_bytes",
        F.col("_largest.column").alias("largest_column"),
        "saved_pct",
        F.when(F.col("saved_pct") > 30, "high").when(F.col("saved_pct") > 15, "medium").otherwise("low").alias("saving"),
    )

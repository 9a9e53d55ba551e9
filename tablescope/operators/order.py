"""Global order without a single-partition window.

Rows are range-partitioned on the order key, the partitions are sorted and written out once by
``checkpoint`` (so that both passes below see the same partition bounds even if executors are lost),
and each row then gets its position from its partition's offset. Offsets are one row per partition.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.kinds import INTEGRAL, quoted

BROADCAST_ROWS = 1 << 18
_POSITION_BITS = 33  # monotonically_increasing_id: partition id above, row position below


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a scratch folder in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tablescope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def sized(side: DataFrame) -> DataFrame:
    """A narrow table, written once: marked for broadcast if it has few rows, else joined by a shuffle."""
    side = materialize(side)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def order_columns(order_by: str | Column | Sequence[str | Column]) -> list[Column]:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [quoted(i) if isinstance(i, str) else i for i in items]


def file_order(df: DataFrame) -> DataFrame:
    """Add ``_file_path`` and ``_file_row``, the stored order of a Parquet scan, as order keys."""
    return df.select("*", F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.row_index").alias("_file_row"))


def with_row_index(df: DataFrame, order_by, name: str = "row_index") -> DataFrame:
    """Number the rows from 0 in the order of ``order_by``.

    Ties are broken by a hash of the whole row, so the numbering does not depend on how the input is
    partitioned; exact copies are further spread by their input position, so that a large group of
    copies does not end up in one range.
    """
    names = df.columns
    hashable = [quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = df.withColumn("_hash", F.xxhash64(*hashable)).withColumn("_copy", F.monotonically_increasing_id())
    keys = [*order_columns(order_by), F.col("_hash"), F.col("_copy")]
    placed = materialize(
        keyed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_hash", "_copy")
    )
    part = F.shiftright("_place", _POSITION_BITS)
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    placed = placed.withColumn("_part", part).withColumn("_position", position)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(_before(F.lit(0), "_part")), F.lit(0)))
        .select("_part", "_offset")
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *[quoted(n) for n in names], (F.col("_offset") + F.col("_position")).alias(name)
    )


def _before(partition: Column, order: str):
    """Everything ahead of a row; used on per-partition totals only."""
    return Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(df: DataFrame, order_by, amounts: Sequence[str], group: str | None = None) -> DataFrame:
    """Add ``<amount>_before``: the sum of ``amount`` over all earlier rows (of the same ``group``).

    The order key should be unique within a group. Groups may be of any size; there must be few of
    them (columns or column pairs), because their starting totals are broadcast. Amounts must not be
    missing; whole numbers add up as bigint, others as double.
    """
    amounts = list(amounts)
    whole = {a: isinstance(df.schema[a].dataType, INTEGRAL) for a in amounts}
    keys = ([quoted(group)] if group else []) + order_columns(order_by)
    local = [f"_{a}_local" for a in amounts]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(n, T.LongType() if whole[a] else T.DoubleType()) for n, a in zip(local, amounts)]])

    def add_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = {a: 0 for a in amounts}
        for batch in batches:
            columns = list(batch.columns)
            for a in amounts:
                values = batch.column(a).to_numpy(zero_copy_only=False).astype(np.int64 if whole[a] else np.float64)
                through = np.cumsum(values) + carry[a]
                columns.append(pa.array(through - values))
                carry[a] = through[-1] if len(through) else carry[a]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *local])

    placed = materialize(ranged.mapInArrow(add_local, schema))

    totals = placed.groupBy("_part").agg(*[F.sum(a).alias(f"_{a}_total") for a in amounts])
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_{a}_total").over(_before(F.lit(0), "_part")), F.lit(0)).alias(f"_{a}_offset") for a in amounts]
    )
    out = placed.join(F.broadcast(offsets), "_part")
    starts: list[Column] = [F.lit(0)] * len(amounts)
    if group:
        by_group = placed.groupBy(quoted(group).alias("_group")).agg(*[F.sum(a).alias(f"_{a}_total") for a in amounts])
        group_starts = by_group.select(
            "_group", *[F.coalesce(F.sum(f"_{a}_total").over(_before(F.lit(0), "_group")), F.lit(0)).alias(f"_{a}_start") for a in amounts]
        )
        out = out.join(F.broadcast(group_starts), quoted(group) == F.col("_group"))
        starts = [F.col(f"_{a}_start") for a in amounts]
    return out.select(
        *[quoted(n) for n in df.columns],
        *[(F.col(f"_{a}_offset") + F.col(n) - s).alias(f"{a}_before") for a, n, s in zip(amounts, local, starts)],
    )


def average_ranks(frequencies: DataFrame, group: str, value: str = "value", count: str = "n") -> DataFrame:
    """Add ``rank``, the mean of the 1-based positions a value takes within its ``group``.

    ``frequencies`` has one row per (group, value) with its number of occurrences.
    """
    placed = running_totals(frequencies, value, [count], group)
    return placed.withColumn("rank", F.col(f"{count}_before") + (quoted(count) + 1) / 2).drop(f"{count}_before")

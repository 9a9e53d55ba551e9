"""Joins against a table whose size is only known once it is there, and the key by which rows are told apart."""

from __future__ import annotations

import gc
import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators.order import materialize

BROADCAST_ROWS = 1 << 20


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of a value of this package's classes, which workers need not have installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast):
    return pickle.loads(broadcast.value)


def row_key(id_column: str, text_column: str) -> Column:
    """A 64-bit hash of id and text: rows with a missing or a shared id are told apart by their texts, repeated rows are not."""
    return F.xxhash64(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string"))


def spare(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so once the driver has collected the steps as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def counted(side: DataFrame) -> DataFrame:
    """``side``, written once; marked for broadcast if it has few rows, else joined by a shuffle. For narrow rows only."""
    side = materialize(side)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side

"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.order import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Column types of the tables the profile queries walk over.
LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
RATED = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}
GAPS = {
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string",
}

# Documents with the labels some of them have, and line items with missing cells, as SQL and as frames.
RATED_SQL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
GAPS_SQL = """(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus FROM lineitem)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rated(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order does not show."""
    return df.select(
        *[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def per_column_sql(columns, template: str, source: str) -> str:
    """UNION ALL of ``template`` (with {c} the column and {t} its type) over columns."""
    items = columns.items() if isinstance(columns, dict) else [(c, "") for c in columns]
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {template.format(c=c, t=t)} FROM {source}" for c, t in items)


def numbers(columns: dict[str, str]) -> dict[str, str]:
    return {c: t for c, t in columns.items() if t in ("bigint", "int", "double")}


def texts(columns: dict[str, str]) -> list[str]:
    return [c for c, t in columns.items() if t == "string"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a write-and-read-back query."""
    return f"{shared_folder(spark).rstrip('/')}/tablescope-{name}-{uuid.uuid4().hex}"

"""Sources and sinks, filters, slices, sorts, top-k and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import CUSTOMER, LINEITEM, ORDERS, PART, RATED_SQL, r, rated, register, rounded, scratch, table, texts
from tablescope.operators import order, select
from tablescope.plans import relations
from tablescope.sources import io

ORDERS_DDL = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


# --- sources and sinks ----------------------------------------------------------------------------

def _csv_round_trip(spark, d):
    path = io.write_table(table(spark, d, "orders"), scratch(spark, "orders.csv"), "csv")
    back = io.read_table(spark, path, "csv", schema=ORDERS_DDL)
    return rounded(back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("latest")), 2)


register(
    "read_table",
    _csv_round_trip,
    f"SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total, max(o_orderdate) AS latest FROM orders GROUP BY 1",
)


def _dtype_map(spark, d):
    path = io.write_table(table(spark, d, "customer"), scratch(spark, "customer.csv"), "csv")
    back = io.read_table(spark, path, "csv", dtype_map={"c_nationkey": "double", "c_mktsegment": "int"})
    return rounded(back.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("c_mktsegment").alias("segments"), F.sum("c_acctbal").alias("balance")), 2)


register(
    "read_table_dtype_map",
    _dtype_map,
    f"SELECT c_nationkey::DOUBLE AS c_nationkey, count(*) AS n, 0::BIGINT AS segments, {r('sum(c_acctbal)', 2)} AS balance FROM customer GROUP BY 1",
)


def _leading_zeros(spark, d):
    """Codes with leading zeros keep them when mapped to text, and stay numbers when not."""
    codes = table(spark, d, "part").select("p_partkey", F.lpad(F.col("p_size").cast("string"), 5, "0").alias("code"), F.lpad(F.col("p_size").cast("string"), 5, "0").alias("number"))
    path = io.write_table(codes, scratch(spark, "codes.csv"), "csv")
    return io.read_table(spark, path, "csv", dtype_map={"code": "string"}).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "code", F.col("number").cast("bigint").alias("number"))


register("read_table_leading_zeros", _leading_zeros, "SELECT p_partkey, lpad(p_size::VARCHAR, 5, '0') AS code, p_size::BIGINT AS number FROM part")


def _quoted_csv(name, columns):
    def run(spark, d):
        """Texts with quotes, commas and line breaks, as CSV and back."""
        rows = table(spark, d, name).withColumn("text", F.concat(F.lit('say "hi", '), F.col("text"), F.lit('\nend, "'), F.col(columns.split()[0]).cast("string"), F.lit('"')))
        path = io.write_table(rows, scratch(spark, f"{name}.csv"), "csv")
        return io.read_table(spark, path, "csv", schema=columns, multi_line=True)

    return run


register(
    "csv_documents",
    _quoted_csv("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
    """SELECT doc_id, 'say "hi", ' || text || chr(10) || 'end, "' || doc_id || '"' AS text, lang, source, n_chars FROM documents""",
)
register(
    "csv_conversations",
    _quoted_csv("conversations", "conv_id bigint, turn bigint, role string, text string"),
    """SELECT conv_id, turn, role, 'say "hi", ' || text || chr(10) || 'end, "' || conv_id || '"' AS text FROM conversations""",
)


def _capped(spark, d):
    path = io.write_table(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), scratch(spark, "lineitem.csv"), "csv")
    both = io.union_tables(io.read_table(spark, path, "csv", schema="l_orderkey bigint, l_quantity double", max_rows=10_000), io.read_table(spark, path, "csv", schema="l_orderkey bigint, l_quantity double", nrows=500))
    return both.agg(F.count(F.lit(1)).alias("n_rows"))


register("read_table_capped", _capped, "SELECT least(count(*), 10000) + least(count(*), 500) AS n_rows FROM lineitem")


def _preview_csv(spark, d):
    path = io.write_table(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), scratch(spark, "preview.csv"), "csv")
    return io.preview_quality(io.read_preview(spark, path, "o_orderkey tinyint, o_totalprice double"))


register("read_preview", _preview_csv, "SELECT least(count(*), 50000) AS n_rows, count(*) FILTER (o_orderkey > 127) AS corrupt_rows FROM orders")


def _json_round_trip(spark, d):
    path = io.write_table(table(spark, d, "documents"), scratch(spark, "documents.json"), "json")
    back = io.read_table(spark, path, "json", schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.sum("n_chars").alias("n_chars"), F.min("text").alias("first_text"))


register(
    "write_table",
    _json_round_trip,
    "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(n_chars)::BIGINT AS n_chars, min(text) AS first_text FROM documents GROUP BY 1",
)


def _indexed_round_trip(spark, d):
    path = io.write_table(table(spark, d, "customer"), scratch(spark, "indexed.csv"), "csv", with_index=True, order_by=["c_acctbal", "c_custkey"])
    return io.read_table(spark, path, "csv", schema="index bigint, c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").select("index", "c_custkey", "c_acctbal")


register("write_table_index", _indexed_round_trip, 'SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS "index", c_custkey, c_acctbal FROM customer')


def _report(spark, d):
    """The bundle of one table written as JSON, its first section read back."""
    results = relations.analyze_relations(table(spark, d, "orders").drop("o_orderkey", "o_orderdate"))
    written = io.write_report(results, scratch(spark, "report"))
    return spark.read.schema("n_rows bigint, n_columns bigint, numeric_columns bigint, text_columns bigint, usable_categories bigint").json(written["metadata"])


register(
    "write_report",
    _report,
    "SELECT count(*) AS n_rows, 4::BIGINT AS n_columns, 2::BIGINT AS numeric_columns, 2::BIGINT AS text_columns, 2::BIGINT AS usable_categories FROM orders",
)

_TARGET = """CASE WHEN '{t}' NOT IN ('bigint', 'int') THEN '{t}'
  WHEN min(TRY_CAST({c} AS BIGINT)) >= 0 THEN CASE WHEN max(TRY_CAST({c} AS BIGINT)) < 256 THEN 'smallint' WHEN max(TRY_CAST({c} AS BIGINT)) < 65536 THEN 'int' ELSE '{t}' END
  WHEN min(TRY_CAST({c} AS BIGINT)) >= -128 AND max(TRY_CAST({c} AS BIGINT)) <= 127 THEN 'tinyint'
  WHEN min(TRY_CAST({c} AS BIGINT)) >= -32768 AND max(TRY_CAST({c} AS BIGINT)) <= 32767 THEN 'smallint' ELSE 'int' END"""
_PLAN = "'{t}' AS dtype, " + _TARGET + " AS target, ('{t}' = 'string' AND count(DISTINCT {c}) < 0.5 * count(*)) AS dictionary_candidate"


def _int_sql(columns, source):
    parts = []
    for c, t in columns.items():
        cell = c if t in ("bigint", "int") else "NULL"
        parts.append(f"SELECT '{c}' AS \"column\", " + _PLAN.replace("TRY_CAST({c} AS BIGINT)", f"({cell})::BIGINT").format(c=c, t=t) + f" FROM {source}")
    return "\nUNION ALL\n".join(parts)


register("narrow_schema", lambda s, d: io.narrow_schema(table(s, d, "lineitem"))[1], _int_sql(LINEITEM, "lineitem"))
register(
    "narrow_schema_apply",
    lambda s, d: io.narrow_schema(table(s, d, "customer"))[0].agg(
        F.sum(F.col("c_nationkey").cast("bigint")).alias("nations"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys"), F.count(F.lit(1)).alias("n")
    ),
    "SELECT sum(c_nationkey)::BIGINT AS nations, sum(c_custkey)::BIGINT AS keys, count(*) AS n FROM customer",
)

_WIDTH = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}
_NARROW = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def _footprint_sql(columns, source):
    plan = _int_sql(columns, source)
    sizes = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS filled, "
        + (f"count({c}) * {_WIDTH[t]}" if t in _WIDTH else f"sum(octet_length({c}::BLOB))::BIGINT")
        + f" AS bytes FROM {source}"
        for c, t in columns.items()
    )
    width = "CASE target WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4 ELSE 8 END"
    return (
        f"SELECT p.\"column\", p.dtype, s.bytes::BIGINT AS bytes, (CASE WHEN p.dtype IN ('bigint', 'int') THEN s.filled * {width} ELSE s.bytes END)::BIGINT AS narrowed_bytes "
        f"FROM ({plan}) p JOIN ({sizes}) s ON p.\"column\" = s.\"column\""
    )


register("storage_footprint", lambda s, d: io.storage_footprint(table(s, d, "orders")), _footprint_sql(ORDERS, "orders").replace("octet_length(o_orderstatus::BLOB)", "strlen(o_orderstatus)").replace("octet_length(o_orderpriority::BLOB)", "strlen(o_orderpriority)"))
register(
    "footprint_summary",
    lambda s, d: rounded(io.footprint_summary(table(s, d, "lineitem"))),
    f"""WITH f AS ({_footprint_sql(LINEITEM, 'lineitem').replace("octet_length(l_returnflag::BLOB)", "strlen(l_returnflag)").replace("octet_length(l_linestatus::BLOB)", "strlen(l_linestatus)")}),
  t AS (SELECT sum(bytes)::BIGINT AS b, sum(narrowed_bytes)::BIGINT AS s, first("column" ORDER BY bytes DESC, "column") AS largest FROM f)
SELECT b AS total_bytes, {r('b / 1048576.0')} AS total_mb, s AS narrowed_bytes, largest AS largest_column, {r('100.0 * (b - s) / b')} AS saved_pct,
  CASE WHEN 100.0 * (b - s) / b > 30 THEN 'high' WHEN 100.0 * (b - s) / b > 15 THEN 'medium' ELSE 'low' END AS saving FROM t""",
)


# --- filters, projections -------------------------------------------------------------------------

register("filter_equals", lambda s, d: select.filter_equals(table(s, d, "orders"), "o_orderpriority", "1-URGENT"), "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
register("filter_equals_number", lambda s, d: select.filter_equals(table(s, d, "lineitem"), "l_quantity", "7"), "SELECT * FROM lineitem WHERE l_quantity = 7")
register("filter_greater", lambda s, d: select.filter_greater(table(s, d, "lineitem"), "l_extendedprice", "90000"), "SELECT * FROM lineitem WHERE l_extendedprice > 90000")
register("filter_less", lambda s, d: select.filter_less(table(s, d, "customer"), "c_acctbal", 0), "SELECT * FROM customer WHERE c_acctbal < 0")
register(
    "filter_less_text",
    lambda s, d: select.filter_less(table(s, d, "part").withColumn("code", F.substring("p_brand", 7, 2)), "code", "30"),
    "SELECT *, substring(p_brand, 7, 2) AS code FROM part WHERE TRY_CAST(substring(p_brand, 7, 2) AS DOUBLE) < 30",
)
register(
    "filter_contains",
    lambda s, d: select.filter_contains(table(s, d, "documents"), "text", r"\b(the|der)\b.*data").select("doc_id", "lang"),
    r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '\b(the|der)\b.*data', 'i')",
)
register(
    "filter_contains_accents",
    lambda s, d: select.filter_contains(table(s, d, "documents"), "text", "É[A-Z]*LE").select("doc_id"),
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Éé][a-zA-Z]*[lL][eE]')",
)
register(
    "filter_contains_literal",
    lambda s, d: select.filter_contains(table(s, d, "pages"), "url", ".COM/", literal=True).select("page_id", "url"),
    "SELECT page_id, url FROM pages WHERE contains(lower(url), '.com/')",
)
register("apply_filter", lambda s, d: select.apply_filter(table(s, d, "events"), "value", "Greater Than", "60"), "SELECT * FROM events WHERE value > 60")
register(
    "apply_filter_kept",
    lambda s, d: select.apply_filter(table(s, d, "nation"), "n_nationkey", "Less Than", "not a number", on_error="keep"),
    "SELECT * FROM nation",
)
register("clear_filter", lambda s, d: select.clear_filter(table(s, d, "region")), "SELECT * FROM region")
register("select_columns", lambda s, d: select.select_columns(table(s, d, "supplier"), ["s_suppkey", "s_acctbal"]), "SELECT s_suppkey, s_acctbal FROM supplier")
register("select_columns_tokens", lambda s, d: select.select_columns(table(s, d, "orders"), tokens=["key", "price"]), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
register("select_columns_kind", lambda s, d: select.select_columns(table(s, d, "part"), kind="categorical"), "SELECT p_name, p_brand, p_type FROM part")
register(
    "preview",
    lambda s, d: select.preview(table(s, d, "documents"), 100, order_by="doc_id"),
    """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS text, lang, source, n_chars::VARCHAR AS n_chars
FROM documents ORDER BY documents.doc_id LIMIT 100""",
)
register(
    "preview_numbers",
    lambda s, d: select.preview(rated(s, d).withColumn("ratio", F.col("n_chars") / 8), 1000, order_by="doc_id"),
    f"""SELECT doc_id::VARCHAR AS doc_id, lang, source, n_chars::VARCHAR AS n_chars, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic,
printf('%.2f', n_chars / 8.0 + 1e-9) AS ratio FROM {RATED_SQL} t ORDER BY t.doc_id LIMIT 1000""",
)
register(
    "to_numeric",
    lambda s, d: select.coerce_numeric(table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type"), "k", "k_number").select("event_id", "k_number"),
    "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number FROM events",
)
register(
    "to_datetime",
    lambda s, d: select.coerce_datetime(
        table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.col("o_orderdate").cast("string")).alias("day")), "day"
    ),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders",
)


# --- order, slices, pages -------------------------------------------------------------------------

register(
    "with_row_index",
    lambda s, d: order.with_row_index(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice", "l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS row_index FROM lineitem",
)
register("slice_rows", lambda s, d: select.slice_rows(table(s, d, "orders"), 101, 150, ["o_orderkey", "o_totalprice"], "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
register(
    "slice_rows_stored_order",
    lambda s, d: select.slice_rows(table(s, d, "customer"), 11, 40),
    "SELECT * FROM customer LIMIT 30 OFFSET 10",
)


def _deep_page(s, d):
    """A page far into the table, reached through row numbers instead of a top-k."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return select.page(rows, 9, 200, ["l_orderkey", "l_linenumber"], deep=True)


register("page", lambda s, d: select.page(table(s, d, "orders"), 3, 100, "o_orderkey"), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")
register("page_deep", _deep_page, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 200 OFFSET 1800")
register("page_clamped", lambda s, d: select.page(table(s, d, "nation"), 99, 1, "n_nationkey"), "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 20")
register("head", lambda s, d: select.head(table(s, d, "orders"), 5, "o_orderkey"), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
register("tail", lambda s, d: select.tail(table(s, d, "orders"), 5, "o_orderkey"), "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
register("sort_asc", lambda s, d: select.sort_asc(rated(s, d), "quality"), f"SELECT * FROM {RATED_SQL} t ORDER BY quality ASC NULLS LAST")
register("sort_desc", lambda s, d: select.sort_desc(rated(s, d), "quality"), f"SELECT * FROM {RATED_SQL} t ORDER BY quality DESC NULLS LAST")
register(
    "sort_asc_missing_last",
    lambda s, d: select.sort_asc(rated(s, d).select("quality", "doc_id"), "quality").limit(1).select(F.col("quality").isNull().alias("missing_first")),
    "SELECT false AS missing_first",
)


def _sample_facts(s, d):
    """Size and foreign rows of a sample."""
    rows = table(s, d, "lineitem")
    sample = select.sample_rows(rows, 1000).select("l_orderkey", "l_linenumber")
    foreign = sample.join(rows, ["l_orderkey", "l_linenumber"], "left_anti").agg(F.count(F.lit(1)).alias("foreign_rows"))
    return sample.agg(F.count(F.lit(1)).alias("n")).join(foreign)


def _copies(s, d):
    """Shares of four equally frequent values in a sample of a table that is nothing but copies."""
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") % 4).alias("value"))
    return select.sample_rows(rows, 1000).groupBy("value").agg((F.count(F.lit(1)) / 1000).between(0.15, 0.35).alias("near_its_share"))


register(
    "sample_rows",
    _sample_facts,
    "SELECT least(count(*), 1000) AS n, 0::BIGINT AS foreign_rows FROM lineitem",
)
register("sample_rows_of_copies", _copies, "SELECT l_orderkey % 4 AS value, count(*) / sum(count(*)) OVER () BETWEEN 0.15 AND 0.35 AS near_its_share FROM lineitem GROUP BY 1")
register(
    "sample_rows_any_layout",
    lambda s, d: select.sample_rows(table(s, d, "lineitem"), 1000)
    .exceptAll(select.sample_rows(table(s, d, "lineitem").repartition("l_suppkey"), 1000))  # as many parts as the table asks for
    .agg(F.count(F.lit(1)).alias("differing")),
    "SELECT 0::BIGINT AS differing",
)
register(
    "sample_fraction",
    lambda s, d: select.sample_fraction(table(s, d, "lineitem"), 0.05).agg((F.count(F.lit(1)) / table(s, d, "lineitem").agg(F.count(F.lit(1))).scalar()).between(0.03, 0.07).alias("near_its_share")),
    "SELECT count(*) > 0 AS near_its_share FROM lineitem",
)
register(
    "sample_rows_size",
    lambda s, d: select.sample_rows(table(s, d, "lineitem"), 1000).agg(F.count(F.lit(1)).alias("n")).withColumn("short", select.sample_rows(table(s, d, "region"), 10).agg(F.count(F.lit(1))).scalar()),
    "SELECT (SELECT least(count(*), 1000) FROM lineitem) AS n, (SELECT least(count(*), 10) FROM region) AS short",
)
register("top_k", lambda s, d: select.top_k(table(s, d, "orders"), "o_totalprice", 25), "SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 25")


# --- values and counts ----------------------------------------------------------------------------

register("top_values", lambda s, d: select.top_values(table(s, d, "part"), "p_name", 10), "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
register(
    "top_values_missing",
    lambda s, d: select.top_values(rated(s, d), "quality", 20, dropna=False),
    f"SELECT quality AS value, count(*) AS n FROM {RATED_SQL} t GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 20",
)


def _top_all_sql(columns, source, k):
    one = "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {s} WHERE {c} IS NOT NULL GROUP BY {c}"
    rows = " UNION ALL ".join(one.format(c=c, s=source) for c in columns)
    return f'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS rank FROM ({rows})) WHERE rank <= {k}'


register("top_values_all", lambda s, d: select.top_values_all(table(s, d, "part"), k=5), _top_all_sql(texts(PART), "part", 5))


def others_sql(column: str, source: str, n: int, at_most: int) -> str:
    return f"""WITH c AS (SELECT {column} AS value, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1),
  k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS p, count(*) OVER () AS m FROM c)
SELECT CASE WHEN m > {at_most} AND p > {n} THEN 'Others' ELSE value END AS value, sum(n)::BIGINT AS n FROM k GROUP BY 1"""


register("top_n_plus_others", lambda s, d: select.top_n_plus_others(table(s, d, "documents"), "source", 9), others_sql("source", "documents", 9, 10))
register("top_n_plus_others_few", lambda s, d: select.top_n_plus_others(table(s, d, "events"), "event_type", 9), others_sql("event_type", "events", 9, 10))


def _value_set_sql(columns, source, limit):
    rows = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM {source}" for c in columns)
    return f'SELECT "column", value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS p FROM ({rows})) WHERE p <= {limit}'


register("value_set", lambda s, d: select.value_set(table(s, d, "customer"), 10, texts(CUSTOMER)), _value_set_sql(texts(CUSTOMER), "customer", 10))
register("sample_values", lambda s, d: select.sample_values(rated(s, d), "quality", 50, "doc_id"), f"SELECT quality FROM {RATED_SQL} t WHERE quality IS NOT NULL ORDER BY doc_id LIMIT 50")


"""Column profiles and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    CUSTOMER,
    GAPS,
    GAPS_SQL,
    LINEITEM,
    ORDERS,
    PART,
    RATED,
    RATED_SQL,
    numbers,
    per_column_sql,
    r,
    rated,
    register,
    rounded,
    table,
    texts,
    with_gaps,
)
from tablescope.operators import profile, quality
from tablescope.plans import recipes
from tablescope.sources import io

EVENTS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


def lineitem(s, d):
    return table(s, d, "lineitem")


# --- profiles -------------------------------------------------------------------------------------

def _profile_sql(columns, source):
    def r7(e):
        return r(e, 7)

    def one(c, t):
        if t in ("bigint", "int", "double"):
            x = f"{c}::DOUBLE"
            stats = f"""{r7(f'avg({x})')} AS mean, {r7(f'stddev_samp({x})')} AS std, min({x}) AS min, {r7(f'quantile_cont({x}, 0.25)')} AS q25,
 {r7(f'quantile_cont({x}, 0.5)')} AS q50, {r7(f'quantile_cont({x}, 0.75)')} AS q75, max({x}) AS max,
 {r7(f'quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)')} AS iqr, {r7(f'skewness({x})')} AS skew, {r7(f'kurtosis({x})')} AS kurtosis"""
        else:
            stats = ", ".join(f"NULL::DOUBLE AS {k}" for k in ("mean", "std", "min", "q25", "q50", "q75", "max", "iqr", "skew", "kurtosis"))
        return f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS n_rows, count({c}) AS count, count(*) - count({c}) AS nulls,
 count(DISTINCT {c}) AS "unique", {r7(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct, {stats} FROM {source}"""

    return "\nUNION ALL\n".join(one(c, t) for c, t in columns.items())


register("column_profile", lambda s, d: rounded(profile.column_profile(lineitem(s, d)), 7), _profile_sql(LINEITEM, "lineitem"))
register("column_profile_missing", lambda s, d: rounded(profile.column_profile(rated(s, d)), 7), _profile_sql(RATED, RATED_SQL + " t"))
register("column_profile_gaps", lambda s, d: rounded(profile.column_profile(with_gaps(s, d)), 7), _profile_sql(GAPS, GAPS_SQL + " t"))

_BASIC = """'{t}' AS dtype, count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS unique_incl_missing,
 count(*) - count({c}) AS nulls, count({c}) AS count, """


def _basic_sql(columns, source):
    parts = []
    for c, t in columns.items():
        x = f"{c}::DOUBLE" if t in ("bigint", "int", "double") else "NULL::DOUBLE"
        parts.append(per_column_sql({c: t}, _BASIC + f"min({x}) AS min, max({x}) AS max, " + r(f"avg({x})") + " AS mean", source))
    return "\nUNION ALL\n".join(parts)


register("column_profile_basic", lambda s, d: rounded(profile.column_profile_basic(rated(s, d))), _basic_sql(RATED, RATED_SQL + " t"))
register(
    "quick_eda",
    lambda s, d: profile.quick_eda(with_gaps(s, d)),
    per_column_sql(GAPS, "'{t}' AS dtype, count(*) AS n_rows, 6::BIGINT AS n_columns, count(*) - count({c}) AS nulls", GAPS_SQL + " t"),
)

_DESCRIBE = (
    "count({c}) AS count, " + r("avg({c}::DOUBLE)") + " AS mean, " + r("stddev_samp({c}::DOUBLE)") + " AS std, min({c}::DOUBLE) AS min, "
    + ", ".join(r("quantile_cont({c}::DOUBLE, " + p + ")") + f" AS {n}" for n, p in (("q25", "0.25"), ("q50", "0.5"), ("q75", "0.75")))
    + ", max({c}::DOUBLE) AS max"
)
register("describe", lambda s, d: rounded(profile.describe(table(s, d, "orders"))), per_column_sql(numbers(ORDERS), _DESCRIBE, "orders"))
_CATEGORICAL = """count({{c}}) AS count, count(DISTINCT {{c}}) AS "unique", (SELECT {{c}} FROM {s} GROUP BY 1 HAVING {{c}} IS NOT NULL ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
 (SELECT count(*) FROM {s} WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC LIMIT 1) AS freq"""
register("describe_categorical", lambda s, d: profile.describe_categorical(table(s, d, "part")), per_column_sql(texts(PART), _CATEGORICAL.format(s="part"), "part"))
_ALL_NUMERIC = _DESCRIBE + ', NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq'
_ALL_TEXT = "{cat}, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max"
register(
    "describe_all",
    lambda s, d: rounded(profile.describe_all(table(s, d, "customer"))).select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "unique", "top", "freq"
    ),
    'SELECT "column", count, mean, std, min, q25, q50, q75, max, "unique", top, freq FROM ('
    + per_column_sql(numbers(CUSTOMER), _ALL_NUMERIC, "customer")
    + ') a UNION ALL SELECT "column", count, mean, std, min, q25, q50, q75, max, "unique", top, freq FROM ('
    + per_column_sql(texts(CUSTOMER), _ALL_TEXT.format(cat=_CATEGORICAL.format(s="customer")), "customer")
    + ") b",
)


def _positions(columns, rest, source):
    return "\nUNION ALL\n".join(f"SELECT {i} AS position, '{c}' AS \"column\"{rest.format(c=c, t=t)} FROM {source}" for i, (c, t) in enumerate(columns.items()))


register("table_info", lambda s, d: profile.table_info(rated(s, d)), _positions(RATED, ", count({c}) AS non_null, '{t}' AS dtype", RATED_SQL + " t"))
register("dtypes", lambda s, d: profile.dtypes(lineitem(s, d)), "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype" for c, t in LINEITEM.items()))
register("column_names", lambda s, d: profile.column_names(lineitem(s, d)), "\nUNION ALL\n".join(f"SELECT {i} AS position, '{c}' AS \"column\"" for i, c in enumerate(LINEITEM)))
register("shape", lambda s, d: profile.shape(lineitem(s, d)), "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
register("quality_summary", lambda s, d: profile.quality_summary(rated(s, d)), per_column_sql(RATED, "'{t}' AS dtype, count(*) - count({c}) AS nulls", RATED_SQL + " t"))
register("row_index_info", lambda s, d: profile.row_index_info(lineitem(s, d)), "SELECT 0::BIGINT AS start, count(*) AS stop, 1::BIGINT AS step FROM lineitem")
register(
    "key_uniqueness",
    lambda s, d: profile.key_uniqueness(lineitem(s, d), ["l_orderkey", "l_linenumber"]),
    "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS is_unique FROM lineitem",
)
register("nunique", lambda s, d: profile.nunique(rated(s, d)), per_column_sql(RATED, "count(DISTINCT {c}) AS n_unique", RATED_SQL + " t"))
register(
    "nunique_approx",
    lambda s, d: profile.nunique(lineitem(s, d), approx=True)
    .join(profile.nunique(lineitem(s, d)).withColumnRenamed("n_unique", "exact"), "column")
    .select("column", (F.abs(F.col("n_unique") - F.col("exact")) <= F.greatest(0.15 * F.col("exact"), F.lit(1))).alias("close")),
    per_column_sql(LINEITEM, "count(DISTINCT {c}) > 0 AS close", "lineitem"),
)
register("unique_ratio", lambda s, d: profile.unique_ratio(lineitem(s, d)), per_column_sql(LINEITEM, r("100.0 * count(DISTINCT {c}) / count(*)", 2) + " AS unique_pct", "lineitem"))

_GAP_NUMBERS = numbers(GAPS)
_gaps = GAPS_SQL + " t"
register("std", lambda s, d: rounded(profile.std(with_gaps(s, d))), per_column_sql(_GAP_NUMBERS, r("stddev_samp({c})") + " AS std", _gaps))
register("variance", lambda s, d: rounded(profile.variance(with_gaps(s, d)), 4), per_column_sql(_GAP_NUMBERS, r("var_samp({c})", 4) + " AS variance", _gaps))
register("sem", lambda s, d: rounded(profile.sem(with_gaps(s, d))), per_column_sql(_GAP_NUMBERS, r("stddev_samp({c}) / sqrt(count({c}))") + " AS sem", _gaps))
register("skewness", lambda s, d: rounded(profile.skewness(with_gaps(s, d))), per_column_sql(_GAP_NUMBERS, r("skewness({c})") + " AS skew", _gaps))
register("kurtosis", lambda s, d: rounded(profile.kurtosis(with_gaps(s, d))), per_column_sql(_GAP_NUMBERS, r("kurtosis({c})") + " AS kurtosis", _gaps))
register("min_max", lambda s, d: profile.min_max(table(s, d, "customer")), per_column_sql(CUSTOMER, "min({c})::VARCHAR AS min, max({c})::VARCHAR AS max", "customer"))
register(
    "quantiles",
    lambda s, d: rounded(profile.quantiles(with_gaps(s, d), (0.05, 0.25, 0.5, 0.75, 0.99))),
    "\nUNION ALL\n".join(per_column_sql(_GAP_NUMBERS, f"{p}::DOUBLE AS p, " + r("quantile_cont({c}, " + str(p) + ")") + " AS value", _gaps) for p in (0.05, 0.25, 0.5, 0.75, 0.99)),
)
_MODE = "(SELECT {{c}}{cast} FROM {s} WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC, {{c}} LIMIT 1) AS mode, (SELECT count(*) FROM {s} WHERE {{c}} IS NOT NULL GROUP BY {{c}} ORDER BY count(*) DESC LIMIT 1) AS n"
register(
    "mode",
    lambda s, d: profile.mode(rated(s, d)),
    "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", " + _MODE.format(s=RATED_SQL + " t", cast="::VARCHAR").format(c=c) for c in RATED),
)
register(
    "numeric_mode",
    lambda s, d: profile.numeric_mode(lineitem(s, d)),
    "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", " + _MODE.format(s="lineitem", cast="::DOUBLE").format(c=c) for c in numbers(LINEITEM)),
)


def _all_modes_sql(columns, source):
    one = "SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {s} WHERE {c} IS NOT NULL GROUP BY {c}"
    rows = " UNION ALL ".join(one.format(c=c, s=source) for c in columns)
    return f'SELECT "column", value, n FROM (SELECT *, max(n) OVER (PARTITION BY "column") AS top FROM ({rows})) WHERE n = top'


register("all_modes", lambda s, d: profile.all_modes(table(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), _all_modes_sql(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "orders"))
register(
    "group_means",
    lambda s, d: rounded(profile.group_means(with_gaps(s, d), "l_returnflag"), 4),
    f"SELECT l_returnflag, {', '.join(r(f'avg({c})', 4) + f' AS {c}' for c in _GAP_NUMBERS)} FROM {_gaps} WHERE l_returnflag IS NOT NULL GROUP BY 1",
)
register(
    "group_stats",
    lambda s, d: profile.group_stats(table(s, d, "events"), "event_type", "value"),
    f"SELECT event_type AS level, {r('avg(value)', 3)} AS mean, {r('stddev_samp(value)', 3)} AS std, count(value) AS n FROM events GROUP BY 1",
)
SUPPLIER = {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}


def _profile_section(name, digits=7):
    return lambda s, d: rounded(recipes.full_profile(lineitem(s, d), [name])[name], digits)


register("full_profile", lambda s, d: rounded(recipes.full_profile(table(s, d, "supplier"))["columns"], 7), _profile_sql(SUPPLIER, "supplier"))
register("full_profile_overview", _profile_section("overview"), "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
register("full_profile_missing", _profile_section("missing"), per_column_sql(LINEITEM, r("100.0 * (count(*) - count({c})) / count(*)", 7) + " AS missing_pct", "lineitem"))
register("full_profile_duplicates", _profile_section("duplicates"), "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates FROM lineitem")


# --- nested columns: arrays count by their content ------------------------------------------------

EMBEDDINGS = {"vec_id": "bigint", "embedding": "array<float>", "label": "int"}
# Rows come twice, and again with the array turned around: only the first kind are duplicates.
_MIRRORED_SQL = "(SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, list_reverse(embedding), label FROM embeddings WHERE label >= 5) t"


def mirrored(s, d):
    rows = table(s, d, "embeddings")
    turned = rows.where("label >= 5").withColumn("embedding", F.reverse("embedding"))
    return rows.union(rows.where("label < 3")).union(turned)


register("column_profile_nested", lambda s, d: rounded(profile.column_profile(mirrored(s, d)), 7), _profile_sql(EMBEDDINGS, _MIRRORED_SQL))
register("nunique_nested", lambda s, d: profile.nunique(mirrored(s, d)), per_column_sql(EMBEDDINGS, "count(DISTINCT {c}) AS n_unique", _MIRRORED_SQL))
register("duplicate_rows_count_nested", lambda s, d: quality.duplicate_rows_count(mirrored(s, d)), "SELECT count(*) AS duplicates FROM embeddings WHERE label < 3")
register("duplicate_rows_nested", lambda s, d: quality.duplicate_rows(mirrored(s, d)).select("vec_id", "label", F.size("embedding").alias("width")), "SELECT vec_id, label, len(embedding)::INTEGER AS width FROM embeddings WHERE label < 3")
register(
    "storage_footprint_nested",
    lambda s, d: io.storage_footprint(table(s, d, "embeddings")).select("column", "bytes"),
    """SELECT 'vec_id' AS "column", 8 * count(*) AS bytes FROM embeddings UNION ALL SELECT 'embedding', 4 * sum(len(embedding))::BIGINT FROM embeddings UNION ALL SELECT 'label', 4 * count(*) FROM embeddings""",
)


# --- quality --------------------------------------------------------------------------------------

_rated = RATED_SQL + " t"
register("missing_count", lambda s, d: quality.missing_count(rated(s, d)), per_column_sql(RATED, "count(*) - count({c}) AS missing", _rated))
register("valid_count", lambda s, d: quality.valid_count(rated(s, d)), per_column_sql(RATED, "count({c}) AS valid", _rated))
register("missing_pct", lambda s, d: quality.missing_pct(rated(s, d)), per_column_sql(RATED, r("100.0 * (count(*) - count({c})) / count(*)", 2) + " AS missing_pct", _rated))
register("rows_with_missing", lambda s, d: quality.rows_with_missing(rated(s, d)), f"SELECT * FROM {_rated} WHERE quality IS NULL OR toxic IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL")
register("columns_with_missing", lambda s, d: quality.columns_with_missing(with_gaps(s, d)), f"SELECT * FROM ({per_column_sql(GAPS, 'count(*) - count({c}) AS missing', _gaps)}) m WHERE missing > 0")

_TEXT_ROWS = "(SELECT text, lang, source FROM documents)"


def _text_rows(s, d):
    return table(s, d, "documents").select("text", "lang", "source")


def _few(s, d):
    return with_gaps(s, d).select("l_quantity", "l_discount", "l_tax", "l_returnflag")


_FEW = f"(SELECT l_quantity, l_discount, l_tax, l_returnflag FROM {_gaps})"
register("duplicate_rows_count", lambda s, d: quality.duplicate_rows_count(_few(s, d)), f"SELECT (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM {_FEW} u GROUP BY l_quantity, l_discount, l_tax, l_returnflag)")
register("duplicate_rows_count_text", lambda s, d: quality.duplicate_rows_count(_text_rows(s, d)), "SELECT (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)")
register("duplicate_rows_all_count", lambda s, d: quality.duplicate_rows_all_count(_text_rows(s, d)), "SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)")
register(
    "duplicate_rows",
    lambda s, d: quality.duplicate_rows(_few(s, d)),
    f"SELECT l_quantity, l_discount, l_tax, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax, l_returnflag) AS p FROM {_FEW} u) WHERE p > 1",
)
register("column_duplicates", lambda s, d: quality.column_duplicates(rated(s, d)), per_column_sql(RATED, "count(*) - count(DISTINCT {c}) - CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS duplicates", _rated))
register(
    "zero_counts",
    lambda s, d: quality.zero_counts(lineitem(s, d)),
    "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c + ' = 0' if c in numbers(LINEITEM) else 'false'}) AS zeros FROM lineitem" for c in LINEITEM),
)
register("all_zero_rows", lambda s, d: quality.all_zero_rows(lineitem(s, d), ["l_discount", "l_tax"]), "SELECT count(*) FILTER (l_discount = 0 AND l_tax = 0) AS rows FROM lineitem")
register("negative_counts", lambda s, d: quality.negative_counts(table(s, d, "customer")), per_column_sql(numbers(CUSTOMER), "count(*) FILTER ({c} < 0) AS negatives", "customer"))
register(
    "all_negative_rows",
    lambda s, d: quality.all_negative_rows(table(s, d, "customer").select(F.negative("c_nationkey").alias("m"), "c_acctbal")),
    "SELECT count(*) FILTER (-c_nationkey < 0 AND c_acctbal < 0) AS rows FROM customer",
)

_FENCE = "SELECT '{c}' AS \"column\", quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {s}"
_OUTLIERS = """SELECT '{{c}}' AS "column", {lo} AS lower, {hi} AS upper, (SELECT count(*) FROM {s} WHERE {{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) AS outliers FROM ({f})"""


def _outliers_sql(columns, source):
    parts = [
        _OUTLIERS.format(lo=r("q1 - 1.5 * (q3 - q1)"), hi=r("q3 + 1.5 * (q3 - q1)"), s=source, f=_FENCE.format(c=c, s=source)).format(c=c) for c in columns
    ]
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") o WHERE outliers > 0"


register("iqr_outliers", lambda s, d: rounded(quality.iqr_outliers(table(s, d, "events"))), _outliers_sql(numbers(EVENTS), "events"))
register(
    "iqr_outlier_rows",
    lambda s, d: quality.iqr_outlier_rows(table(s, d, "events"), "value").select("event_id", "value"),
    "SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
)
register(
    "category_overview",
    lambda s, d: rounded(quality.category_overview(rated(s, d), "quality")),
    f"""SELECT count(*) AS total, count(*) - count(quality) AS missing, count(DISTINCT quality) AS "unique",
 (SELECT quality::VARCHAR FROM {_rated} WHERE quality IS NOT NULL GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1) AS most_common,
 (SELECT count(*) FROM {_rated} WHERE quality IS NOT NULL GROUP BY quality ORDER BY count(*) DESC LIMIT 1) AS frequency,
 {r(f'100.0 * (SELECT count(*) FROM {_rated} WHERE quality IS NOT NULL GROUP BY quality ORDER BY count(*) DESC LIMIT 1) / count(*)')} AS frequency_pct FROM {_rated}""",
)
register(
    "category_shares",
    lambda s, d: rounded(quality.category_shares(table(s, d, "part"), "p_name", 15)),
    f"SELECT p_name AS value, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM part)')} AS pct FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 15",
)
register(
    "frequency_of_frequencies",
    lambda s, d: quality.frequency_of_frequencies(lineitem(s, d), "l_partkey"),
    'SELECT times, count(*) AS "values" FROM (SELECT count(*) AS times FROM lineitem GROUP BY l_partkey) GROUP BY 1',
)

"""Reshaping, series, chart data, multivariate analyses and text."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.base import CUSTOMER, GAPS, GAPS_SQL, numbers, per_column_sql, r, rated, RATED_SQL, register, rounded, table, with_gaps
from catalog.pairs import pearson_sql
from catalog.tables import others_sql
from tablescope.functions import special
from tablescope.operators import chartdata, multivariate, reshape, series, text

_gaps = GAPS_SQL + " t"
_rated = RATED_SQL + " t"
GAP_NUMBERS = list(numbers(GAPS))
EVENT_NUMBERS = ["user_id", "value"]


def events(s, d):
    return table(s, d, "events")


def lineitem(s, d):
    return table(s, d, "lineitem")


# --- reshape --------------------------------------------------------------------------------------

register("crosstab", lambda s, d: reshape.crosstab(with_gaps(s, d), "l_returnflag", "l_linestatus"), f"SELECT l_returnflag AS v1, l_linestatus AS v2, count(*) AS n FROM {_gaps} WHERE l_returnflag IS NOT NULL GROUP BY 1, 2")
register(
    "crosstab_wide",
    lambda s, d: reshape.crosstab_wide(with_gaps(s, d), "l_returnflag", "l_linestatus"),
    f"SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM {_gaps} WHERE l_returnflag IS NOT NULL GROUP BY 1",
)


def _heatmap_sql(a, b, source, levels, metric):
    top = "SELECT {c} FROM {s} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k}"
    value = "n / greatest(r * c / t, 1e-9)" if metric == "lift" else "n"
    return f"""WITH f AS (SELECT {a} AS v1, {b} AS v2, count(*) AS n FROM {source} WHERE {a} IN ({top.format(c=a, s=source, k=levels)}) AND {b} IN ({top.format(c=b, s=source, k=levels)}) GROUP BY 1, 2),
 m AS (SELECT v1, v2, n, sum(n) OVER (PARTITION BY v1)::DOUBLE AS r, sum(n) OVER (PARTITION BY v2)::DOUBLE AS c, sum(n) OVER ()::DOUBLE AS t FROM f)
SELECT v1, v2, n, {r(value + '::DOUBLE')} AS value FROM m"""


register("crosstab_heatmap", lambda s, d: rounded(reshape.crosstab_heatmap(table(s, d, "part"), "p_name", "p_brand", max_levels=30)), _heatmap_sql("p_name", "p_brand", "part", 30, "lift"))
register("crosstab_heatmap_count", lambda s, d: rounded(reshape.crosstab_heatmap(table(s, d, "documents"), "lang", "source", "count", 5)), _heatmap_sql("lang", "source", "documents", 5, "count"))
register("crosstab_heatmap_all", lambda s, d: rounded(reshape.crosstab_heatmap(lineitem(s, d), "l_suppkey", "l_shipdate")), _heatmap_sql("l_suppkey", "l_shipdate", "(SELECT l_suppkey::VARCHAR AS l_suppkey, l_shipdate::VARCHAR AS l_shipdate FROM lineitem)", 1 << 40, "lift"))
register(
    "transpose",
    lambda s, d: reshape.transpose(table(s, d, "nation"), 3, "n_nationkey"),
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"max({c}::VARCHAR) FILTER (n_nationkey = {i}) AS row{i + 1}" for i in range(3)) + " FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")
    ),
)
register(
    "unpivot",
    lambda s, d: reshape.unpivot(table(s, d, "supplier"), ["s_suppkey"], ["s_acctbal"], "field", "amount"),
    "SELECT s_suppkey, 'field' AS field, s_acctbal AS amount FROM supplier".replace("'field' AS", "'s_acctbal' AS"),
)
register(
    "stacked_correlations",
    lambda s, d: rounded(reshape.stacked_correlations(with_gaps(s, d))),
    f"""WITH p AS ({pearson_sql(GAP_NUMBERS, _gaps)}) SELECT col1, col2, r FROM p UNION ALL SELECT col2, col1, r FROM p
UNION ALL SELECT c, c, 1.0::DOUBLE FROM (SELECT unnest({GAP_NUMBERS}) AS c)""",
)


# --- series ---------------------------------------------------------------------------------------

def rolling_sql(window: str, source="events", ts="ts", value="value"):
    return f"""WITH o AS (SELECT row_number() OVER (ORDER BY {ts}, {value}) - 1 AS idx, {ts} AS ts, {value}::DOUBLE AS value, {window} AS w FROM {source} WHERE {value} IS NOT NULL)"""


def _rolled(w: int):
    over = f"OVER (ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN idx >= {w - 1} THEN {r(f'avg(value) {over}')} END AS rolling_mean, CASE WHEN idx >= {w - 1} THEN {r(f'stddev_samp(value) {over}')} END AS rolling_std"


register("rolling_stats", lambda s, d: rounded(series.rolling_stats(events(s, d), "ts", "value", 30)), f"{rolling_sql('30')} SELECT idx, ts, value, {_rolled(30)} FROM o")
register(
    "rolling_stats_default_window",
    lambda s, d: rounded(series.rolling_stats(events(s, d), "ts", "value")),
    f"""WITH o AS (SELECT row_number() OVER (ORDER BY ts, value) - 1 AS idx, ts, value, greatest(3, count(*) OVER () // 10) AS w FROM events),
 c AS (SELECT *, value - (SELECT avg(value) FROM events) AS g FROM o),
 p AS (SELECT *, sum(g) OVER (ORDER BY idx) AS s1, sum(g * g) OVER (ORDER BY idx) AS s2 FROM c),
 j AS (SELECT a.idx, a.ts, a.value, a.w, a.s1 - coalesce(b.s1, 0) AS s1, a.s2 - coalesce(b.s2, 0) AS s2 FROM p a LEFT JOIN p b ON b.idx = a.idx - a.w)
SELECT idx, ts, value, CASE WHEN idx >= w - 1 THEN {r('s1 / w + (SELECT avg(value) FROM events)')} END AS rolling_mean,
 CASE WHEN idx >= w - 1 THEN {r('sqrt(greatest((s2 - s1 * s1 / w) / (w - 1), 0))')} END AS rolling_std FROM j""",
)
# Four or more events an hour: ties of the time go by value, on both sides of a few hundred rows alike.
_HOURS = "(SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, value FROM events)"
for _w in (200, 201):
    register(
        f"rolling_stats_ties_{_w}",
        lambda s, d, w=_w: rounded(series.rolling_stats(events(s, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "ts", "value", w)),
        f"{rolling_sql(str(_w), _HOURS)} SELECT idx, ts, value, {_rolled(_w)} FROM o",
    )
_R5 = r("avg(value) OVER (ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
register(
    "rolling_mean",
    lambda s, d: rounded(series.rolling_mean(events(s, d), "ts", "value", 5, "bfill")),
    f"{rolling_sql('5')}, m AS (SELECT idx, ts, value, CASE WHEN idx >= 4 THEN {_R5} END AS m FROM o) SELECT idx, ts, value, coalesce(m, (SELECT m FROM m WHERE idx = 4)) AS rolling_mean FROM m",
)
register(
    "rolling_mean_zero_fill",
    lambda s, d: rounded(series.rolling_mean(events(s, d), "ts", "value", 5, 0)),
    f"{rolling_sql('5')} SELECT idx, ts, value, CASE WHEN idx >= 4 THEN {_R5} ELSE 0 END AS rolling_mean FROM o",
)
register(
    "group_trend_3d",
    lambda s, d: rounded(series.group_trend_3d(events(s, d), "ts", "value")),
    f"{rolling_sql('5')}, m AS (SELECT idx, value, CASE WHEN idx >= 4 THEN {_R5} END AS m FROM o) SELECT idx, value, coalesce(m, (SELECT m FROM m WHERE idx = 4)) AS rolling_mean FROM m",
)
register(
    "autocorrelation",
    lambda s, d: rounded(series.autocorrelation(events(s, d), "ts", "value")),
    f"{rolling_sql('0')} " + "\nUNION ALL\n".join(f"SELECT {k} AS lag, {r('corr(a.value, b.value)')} AS r, count(*) AS n FROM o a JOIN o b ON b.idx = a.idx - {k}" for k in range(1, 21)),
)
register("time_trend", lambda s, d: series.time_trend(events(s, d).select("ts", "value")), "SELECT ts, value FROM events ORDER BY ts")
register(
    "time_trend_bucket",
    lambda s, d: rounded(series.time_trend(events(s, d), "ts", "value", "hour")),
    f"SELECT date_trunc('hour', ts) AS ts, {r('avg(value)')} AS value, count(*) AS n FROM events GROUP BY 1",
)
register(
    "time_trend_detect",
    lambda s, d: rounded(series.time_trend(table(s, d, "orders").select("o_orderstatus", F.col("o_orderdate").cast("string").alias("day"), "o_totalprice"), bucket="month"), 2),
    f"SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts, {r('avg(o_totalprice)', 2)} AS value, count(*) AS n FROM orders GROUP BY 1",
)


# --- histograms and boxes -------------------------------------------------------------------------

def histogram_sql(columns, source, bins, density=False):
    one = """SELECT '{c}' AS "column", b.i AS bin, lo + b.i * w AS left_edge, CASE WHEN b.i = {k} - 1 THEN hi ELSE lo + (b.i + 1) * w END AS right_edge,
 (SELECT count(*) FROM {s} WHERE least(floor(({c} - lo) / w), {k} - 1) = b.i) AS n FROM (SELECT lo, hi, (hi - lo) / {k} AS w FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {s}) m) r, (SELECT unnest(range({k}))::INTEGER AS i) b"""
    rows = "\nUNION ALL\n".join(one.format(c=c, k=bins, s=source) for c in columns)
    extra = f", {r('n / (sum(n) OVER (PARTITION BY \"column\") * (right_edge - left_edge))', 8)} AS density" if density else ""
    return f'SELECT "column", bin, {r("left_edge")} AS left_edge, {r("right_edge")} AS right_edge, n{extra} FROM ({rows}) h'


register("histogram", lambda s, d: rounded(chartdata.histogram(with_gaps(s, d))), histogram_sql(GAP_NUMBERS, _gaps, 30))
register("histogram_all", lambda s, d: rounded(chartdata.histogram(table(s, d, "customer"), bins=10)), histogram_sql(list(numbers(CUSTOMER)), "customer", 10))
register(
    "histogram_density",
    lambda s, d: (lambda h: h.select("column", "bin", F.round("left_edge", 6).alias("left_edge"), F.round("right_edge", 6).alias("right_edge"), "n", F.round("density", 8).alias("density")))(
        chartdata.histogram(events(s, d), ["value"], 20, density=True)
    ),
    histogram_sql(["value"], "events", 20, density=True),
)
register(
    "equal_width_cut",
    lambda s, d: rounded(chartdata.equal_width_cut(events(s, d), "value", 10)),
    f"""SELECT b.i AS bin, {r('CASE WHEN b.i = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + b.i * w END')} AS left_edge, {r('CASE WHEN b.i = 9 THEN hi ELSE lo + (b.i + 1) * w END')} AS right_edge,
 (SELECT count(*) FROM events WHERE least(greatest(ceil((value - lo) / w), 1), 10) - 1 = b.i) AS n FROM (SELECT lo, hi, (hi - lo) / 10 AS w FROM (SELECT min(value) AS lo, max(value) AS hi FROM events) m) r, (SELECT unnest(range(10))::INTEGER AS i) b""",
)
_BOX = """count(x) AS n, {q1} AS q1, {q2} AS median, {q3} AS q3, min(x) FILTER (x >= a - 1.5 * (c - a)) AS whisker_low, max(x) FILTER (x <= c + 1.5 * (c - a)) AS whisker_high,
 count(*) FILTER (x < a - 1.5 * (c - a) OR x > c + 1.5 * (c - a)) AS fliers""".format(q1=r("any_value(a)"), q2=r("any_value(b)"), q3=r("any_value(c)"))


def box_sql(columns, source):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", {_BOX} FROM (SELECT {c}::DOUBLE AS x, quantile_cont({c}::DOUBLE, 0.25) OVER () AS a, quantile_cont({c}::DOUBLE, 0.5) OVER () AS b, quantile_cont({c}::DOUBLE, 0.75) OVER () AS c FROM {source} WHERE {c} IS NOT NULL) v"""
        for c in columns
    )


def box_by_sql(cat, num, source, levels=None):
    chosen = f"AND {cat} IN ({levels})" if levels else ""
    return f"""SELECT g AS level, {_BOX} FROM (SELECT {cat} AS g, {num}::DOUBLE AS x, quantile_cont({num}::DOUBLE, 0.25) OVER (PARTITION BY {cat}) AS a, quantile_cont({num}::DOUBLE, 0.5) OVER (PARTITION BY {cat}) AS b,
 quantile_cont({num}::DOUBLE, 0.75) OVER (PARTITION BY {cat}) AS c FROM {source} WHERE {num} IS NOT NULL AND {cat} IS NOT NULL {chosen}) v GROUP BY g"""


register("box_stats", lambda s, d: rounded(chartdata.box_stats(with_gaps(s, d))), box_sql(GAP_NUMBERS, _gaps))
register("box_stats_events", lambda s, d: rounded(chartdata.box_stats(events(s, d), EVENT_NUMBERS)), box_sql(EVENT_NUMBERS, "events"))
register("box_stats_by", lambda s, d: rounded(chartdata.box_stats_by(events(s, d), "event_type", "value")), box_by_sql("event_type", "value", "events"))
register("box_stats_by_all", lambda s, d: rounded(chartdata.box_stats_by(lineitem(s, d), "l_partkey", "l_extendedprice")), box_by_sql("l_partkey::VARCHAR", "l_extendedprice", "lineitem"))
register(
    "box_stats_by_many",
    lambda s, d: rounded(chartdata.box_stats_by(table(s, d, "part"), "p_name", "p_retailprice", top=15)),
    box_by_sql("p_name", "p_retailprice", "part", "SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15"),
)


# --- distribution curves --------------------------------------------------------------------------

_ECDF = "WITH c AS (SELECT {c}::DOUBLE AS value, count(*) AS n FROM {s} WHERE {c} IS NOT NULL GROUP BY 1), u AS (SELECT value, n, (sum(n) OVER (ORDER BY value))::BIGINT AS cumulative, sum(n) OVER () AS t FROM c) SELECT value, n, cumulative, {y} AS y FROM u"
register("ecdf", lambda s, d: rounded(chartdata.ecdf(lineitem(s, d), "l_extendedprice")), _ECDF.format(c="l_extendedprice", s="lineitem", y=r("(cumulative - 1) / (t - 1)")))
register("ecdf_standard", lambda s, d: rounded(chartdata.ecdf(with_gaps(s, d), "l_discount", "standard")), _ECDF.format(c="l_discount", s=_gaps, y=r("cumulative / t")))
register("hist_ecdf", lambda s, d: rounded(chartdata.hist_ecdf(events(s, d), "value")["ecdf"]), _ECDF.format(c="value", s="events", y=r("(cumulative - 1) / (t - 1)")))
register("hist_ecdf_bins", lambda s, d: rounded(chartdata.hist_ecdf(events(s, d), "value")["histogram"]), histogram_sql(["value"], "events", 30))


def kde_sql(column, source, grid, whole=False):
    lo, hi = ("lo", "hi") if whole else ("lo - (hi - lo) / 2", "hi + (hi - lo) / 2")
    return f"""WITH v AS (SELECT {column}::DOUBLE AS x, count(*)::DOUBLE AS w FROM {source} WHERE {column} IS NOT NULL GROUP BY 1),
 f AS (SELECT count({column})::DOUBLE AS n, stddev_samp({column}) * pow(count({column}), -0.2) AS h, min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}),
 g AS (SELECT i AS point, {lo} + i * (({hi}) - ({lo})) / ({grid} - 1) AS p, n, h FROM f, (SELECT unnest(range({grid}))::INTEGER AS i) q)
SELECT point, {r('any_value(p)', 4)} AS x, {r(f'sum(w * exp(-0.5 * pow((p - v.x) / h, 2))) / any_value(n * h * {math.sqrt(2 * math.pi)!r})', 9)} AS density FROM g, v GROUP BY point"""


def _density(frame):
    return frame.select("point", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


register("kde", lambda s, d: _density(chartdata.kde(lineitem(s, d), "l_quantity", 200)), kde_sql("l_quantity", "lineitem", 200))
register("kde_many_values", lambda s, d: _density(chartdata.kde(table(s, d, "customer"), "c_acctbal", 100)), kde_sql("c_acctbal", "customer", 100))
register("ridge", lambda s, d: _density(chartdata.ridge(table(s, d, "part"), "p_size", 100)), kde_sql("p_size", "part", 100))
register("violin", lambda s, d: _density(chartdata.violin(lineitem(s, d), "l_discount")), kde_sql("l_discount", "lineitem", 100, whole=True))
register(
    "center_lines",
    lambda s, d: rounded(chartdata.center_lines(events(s, d), "value")),
    f"SELECT {r('avg(value)')} AS mean, {r('median(value)')} AS median, {r('quantile_cont(value, 0.25)')} AS q1, {r('quantile_cont(value, 0.75)')} AS q3 FROM events",
)
register(
    "kde_by_all",
    lambda s, d: chartdata.kde_by(table(s, d, "orders"), "o_totalprice", "o_orderpriority", grid=60).select("level", "point", F.round("x", 2).alias("x"), F.round("density", 12).alias("density")),
    f"""WITH f AS (SELECT o_orderpriority AS level, count(*)::DOUBLE AS n, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
 g AS (SELECT level, i AS point, lo - (hi - lo) / 2 + i * 2 * (hi - lo) / 59 AS p, n, h FROM f, (SELECT unnest(range(60))::INTEGER AS i) q)
SELECT g.level, point, {r('any_value(p)', 2)} AS x, {r(f'sum(exp(-0.5 * pow((p - o_totalprice) / h, 2))) / any_value(n * h * {math.sqrt(2 * math.pi)!r})', 12)} AS density FROM g JOIN orders ON o_orderpriority = g.level GROUP BY g.level, point""",
)
register(
    "kde_by",
    lambda s, d: (lambda k: k.select("level", "point", F.round("x", 4).alias("x"), F.round("density", 9).alias("density")))(chartdata.kde_by(lineitem(s, d), "l_quantity", "l_returnflag", 2, 50)),
    "\nUNION ALL\n".join(f"SELECT '{v}' AS level, * FROM ({kde_sql('l_quantity', f'(SELECT * FROM lineitem WHERE l_returnflag = {chr(39)}{v}{chr(39)}) z', 50)}) k{i}" for i, v in enumerate(("A", "N"))),
)


def _poly(coefficients, x):
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def norm_ppf_sql(p):
    """The normal quantile by the same published approximation."""
    t = f"sqrt(-ln(least({p}, 1 - {p})))"
    central = f"({p} - 0.5) * {_poly(special._AS241_A, f'(0.180625 - pow({p} - 0.5, 2))')} / {_poly(special._AS241_B, f'(0.180625 - pow({p} - 0.5, 2))')}"
    near = f"{_poly(special._AS241_C, f'({t} - 1.6)')} / {_poly(special._AS241_D, f'({t} - 1.6)')}"
    far = f"{_poly(special._AS241_E, f'({t} - 5)')} / {_poly(special._AS241_F, f'({t} - 5)')}"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {central} ELSE sign({p} - 0.5) * (CASE WHEN {t} <= 5 THEN {near} ELSE {far} END) END"


_QQ = f"""WITH o AS (SELECT value AS ordered, row_number() OVER (ORDER BY value) AS position, count(*) OVER () AS n FROM events),
 m AS (SELECT *, CASE WHEN position = 1 THEN 1 - pow(0.5, 1.0 / n) WHEN position = n THEN pow(0.5, 1.0 / n) ELSE (position - 0.3175) / (n + 0.365) END::DOUBLE AS p FROM o),
 q AS (SELECT position, ordered, {norm_ppf_sql('p')} AS theoretical FROM m)"""
register("qq_points", lambda s, d: rounded(chartdata.qq_points(events(s, d), "value")), f"{_QQ} SELECT position, {r('theoretical')} AS theoretical, {r('ordered')} AS ordered FROM q")
register(
    "qq_fit",
    lambda s, d: rounded(chartdata.qq_fit(chartdata.qq_points(events(s, d), "value"))),
    f"{_QQ} SELECT {r('regr_slope(ordered, theoretical)')} AS slope, {r('regr_intercept(ordered, theoretical)')} AS intercept, {r('corr(ordered, theoretical)')} AS r FROM q",
)


# --- point clouds ---------------------------------------------------------------------------------

register("scatter_points", lambda s, d: chartdata.scatter_points(with_gaps(s, d), "l_discount", "l_extendedprice"), f"SELECT l_discount AS x, l_extendedprice AS y FROM {_gaps} WHERE l_discount IS NOT NULL")
register("scatter_points_log", lambda s, d: chartdata.scatter_points(table(s, d, "customer"), "c_custkey", "c_acctbal", log=True), "SELECT c_custkey::DOUBLE AS x, c_acctbal AS y FROM customer WHERE c_acctbal > 0 AND c_custkey > 0")
register(
    "index_scatter",
    lambda s, d: chartdata.index_scatter(table(s, d, "orders"), "o_totalprice", "o_orderkey", cap=None),
    "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS value FROM orders",
)


def _sampled_points(s, d):
    """A sampled scatter: its size, and how many of its points are not points of the whole."""
    whole = chartdata.index_scatter(lineitem(s, d), "l_extendedprice", ["l_extendedprice", "l_orderkey", "l_linenumber"])
    some = chartdata.index_scatter(lineitem(s, d), "l_extendedprice", ["l_extendedprice", "l_orderkey", "l_linenumber"], cap=2_000)
    return some.agg(F.count(F.lit(1)).alias("n")).join(some.join(whole, ["idx", "value"], "left_anti").agg(F.count(F.lit(1)).alias("foreign_points")))


register("index_scatter_sampled", _sampled_points, "SELECT least(count(*), 2000) AS n, 0::BIGINT AS foreign_points FROM lineitem")
register("line_points", lambda s, d: chartdata.line_points(table(s, d, "orders"), "o_totalprice", "o_orderkey"), "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 100")


def hexbin_sql(x, y, source, nx, square=False):
    ny = nx if square else int(nx / math.sqrt(3))
    pick = ("2", "fx", "fy") if square else ("CASE WHEN d1 < d2 THEN 1 ELSE 2 END", "CASE WHEN d1 < d2 THEN ux ELSE fx END", "CASE WHEN d1 < d2 THEN vy ELSE fy END")
    return f"""WITH e AS (SELECT min({x})::DOUBLE AS ax, max({x})::DOUBLE AS bx, min({y})::DOUBLE AS ay, max({y})::DOUBLE AS ey FROM {source}),
 q AS (SELECT ax - 1e-9 * (bx - ax) AS x0, ((bx + 1e-9 * (bx - ax)) - (ax - 1e-9 * (bx - ax))) / {nx} AS sx, ay - 1e-9 * (ey - ay) AS y0, ((ey + 1e-9 * (ey - ay)) - (ay - 1e-9 * (ey - ay))) / {ny} AS sy FROM e),
 p AS (SELECT ({x} - x0) / sx AS u, ({y} - y0) / sy AS v FROM {source}, q),
 f AS (SELECT u, v, round_even(u, 0) AS ux, round_even(v, 0) AS vy, floor(u) AS fx, floor(v) AS fy FROM p),
 g AS (SELECT *, (u - ux) * (u - ux) + 3 * (v - vy) * (v - vy) AS d1, (u - fx - 0.5) * (u - fx - 0.5) + 3 * (v - fy - 0.5) * (v - fy - 0.5) AS d2 FROM f),
 c AS (SELECT {pick[0]} AS lattice, ({pick[1]})::BIGINT AS ix, ({pick[2]})::BIGINT AS iy, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT lattice, ix, iy, {r('(ix + CASE WHEN lattice = 2 THEN 0.5 ELSE 0 END) * sx + x0', 4)} AS cx, {r('(iy + CASE WHEN lattice = 2 THEN 0.5 ELSE 0 END) * sy + y0', 4)} AS cy, n FROM c, q"""


register("hexbin", lambda s, d: rounded(chartdata.hexbin(lineitem(s, d), "l_quantity", "l_extendedprice"), 4), hexbin_sql("l_quantity", "l_extendedprice", "lineitem", 40))
register("hexbin_square", lambda s, d: rounded(chartdata.hexbin(table(s, d, "part"), "p_size", "p_retailprice", 20, square=True), 4), hexbin_sql("p_size", "p_retailprice", "part", 20, square=True))
register(
    "scatter_or_hexbin",
    lambda s, d: rounded(chartdata.scatter_or_hexbin(lineitem(s, d), "l_quantity", "l_extendedprice", kind="hexbin"), 4),
    hexbin_sql("l_quantity", "l_extendedprice", "lineitem", 40),
)
register(
    "regression",
    lambda s, d: rounded(chartdata.regression(lineitem(s, d), "l_quantity", "l_extendedprice")),
    f"SELECT count(*) AS n, {r('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {r('corr(l_extendedprice, l_quantity)')} AS r FROM lineitem",
)
# The t quantile by its expansion around the normal one, exact to 1e-9 at these degrees of freedom.
_Z = 1.959963984540054
register(
    "regression_band",
    lambda s, d: rounded(chartdata.regression_band(lineitem(s, d), "l_quantity", "l_extendedprice"), 4),
    f"""WITH f AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx, var_pop(l_extendedprice) AS vy, covar_pop(l_extendedprice, l_quantity) AS c,
  min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
 g AS (SELECT *, lo + i * (hi - lo) / 99 AS x, {_Z} + ({_Z} ** 3 + {_Z}) / (4 * (n - 2)) + (5 * {_Z} ** 5 + 16 * {_Z} ** 3 + 3 * {_Z}) / (96 * (n - 2) ** 2) AS t FROM f, (SELECT unnest(generate_series(0, 99)) AS i)),
 e AS (SELECT x, my + c / vx * (x - mx) AS fit, t * sqrt((vy - c * c / vx) * n / (n - 2) * (1 / n + (x - mx) ** 2 / (n * vx))) AS w FROM g)
SELECT {r('x', 4)} AS x, {r('fit', 4)} AS fit, {r('fit - w', 4)} AS lower, {r('fit + w', 4)} AS upper FROM e""",
)
register(
    "pair_grid_points",
    lambda s, d: rounded(chartdata.pair_grid(with_gaps(s, d))["points"]),
    f"SELECT {', '.join(c + '::DOUBLE AS ' + c for c in GAP_NUMBERS)} FROM {_gaps} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in GAP_NUMBERS),
)
register("pair_grid", lambda s, d: rounded(chartdata.pair_grid(with_gaps(s, d))["histograms"]), histogram_sql(GAP_NUMBERS, _gaps, 20))
register("pair_grid_correlations", lambda s, d: rounded(chartdata.pair_grid(with_gaps(s, d))["correlations"]), pearson_sql(GAP_NUMBERS, _gaps))


# --- fields ---------------------------------------------------------------------------------------

register(
    "grid_field",
    lambda s, d: rounded(chartdata.grid_field(lineitem(s, d), "l_quantity", "l_discount", "l_extendedprice", 20, 10), 4),
    f"""WITH e AS (SELECT min(l_quantity) AS ax, max(l_quantity) AS bx, min(l_discount) AS ay, max(l_discount) AS ey FROM lineitem)
SELECT least(floor((l_quantity - ax) / ((bx - ax) / 20)), 19)::BIGINT AS ix, least(floor((l_discount - ay) / ((ey - ay) / 10)), 9)::BIGINT AS iy, {r('avg(l_extendedprice)', 4)} AS z, count(*) AS n FROM lineitem, e GROUP BY 1, 2""",
)
_VEC = "(SELECT p_size AS x, p_retailprice AS y, p_size - 25 AS u, p_retailprice - 1000 AS v, sqrt(pow(p_size - 25, 2) + pow(p_retailprice - 1000, 2)) AS m FROM part) t"


def _vectors(s, d):
    return table(s, d, "part").select("p_size", "p_retailprice", (F.col("p_size") - 25).alias("u"), (F.col("p_retailprice") - 1000).alias("v"))


register(
    "vector_field",
    lambda s, d: rounded(chartdata.vector_field(_vectors(s, d), "p_size", "p_retailprice", "u", "v")),
    f"SELECT x::DOUBLE AS x, y, {r('u / (SELECT max(m) FROM ' + _VEC + ')')} AS u, {r('v / (SELECT max(m) FROM ' + _VEC + ')')} AS v, {r('m')} AS magnitude FROM {_VEC}",
)
register(
    "vector_field_stats",
    lambda s, d: rounded(chartdata.vector_field_stats(_vectors(s, d), "p_size", "p_retailprice", "u", "v")),
    f"SELECT count(*) AS n, {r('avg(m)')} AS mean_magnitude, {r('max(m)')} AS max_magnitude FROM {_VEC}",
)
register(
    "encoded_scatter",
    lambda s, d: rounded(chartdata.encoded_scatter(with_gaps(s, d), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")),
    f"""WITH v AS (SELECT * FROM {_gaps} WHERE l_discount IS NOT NULL), e AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi FROM v)
SELECT l_quantity AS x, l_extendedprice AS y, {r('20 + 80 * (l_discount - lo) / (hi - lo)')} AS marker_size, coalesce(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END, -1)::DOUBLE AS color_code FROM v, e""",
)
register(
    "marginal_densities",
    lambda s, d: (lambda h: h.select("column", "bin", F.round("left_edge", 6).alias("left_edge"), F.round("right_edge", 6).alias("right_edge"), "n", F.round("density", 8).alias("density")))(
        chartdata.marginal_densities(table(s, d, "part"), "p_size", "p_retailprice")
    ),
    histogram_sql(["x", "y"], "(SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part) q", 30, density=True),
)


# --- bars, pies, dashboards -----------------------------------------------------------------------

register("bar_topk", lambda s, d: chartdata.bar_topk(rated(s, d), "quality"), f"SELECT quality AS value, count(*) AS n FROM {_rated} GROUP BY 1 ORDER BY n DESC LIMIT 20")
register("bar_counts", lambda s, d: chartdata.bar_counts(table(s, d, "documents"), "source"), others_sql("source", "documents", 14, 15))
register("bar_counts_number", lambda s, d: chartdata.bar_counts(rated(s, d), "quality"), others_sql("quality", _rated, 14, 15).replace("SELECT quality AS value", "SELECT quality::VARCHAR AS value"))
register(
    "bar_counts_classes",
    lambda s, d: chartdata.bar_counts(events(s, d), "value").select("n"),
    "SELECT (SELECT count(*) FROM events WHERE least(greatest(ceil((value - lo) / w), 1), 10) - 1 = b.i) AS n FROM (SELECT lo, (hi - lo) / 10 AS w FROM (SELECT min(value) AS lo, max(value) AS hi FROM events) m) r, (SELECT unnest(range(10)) AS i) b",
)
register("pie_counts", lambda s, d: rounded(chartdata.pie_counts(table(s, d, "documents"), "source")), f"SELECT *, {r('100.0 * n / sum(n) OVER ()')} AS pct FROM ({others_sql('source', 'documents', 9, 10)}) q")
register("donut", lambda s, d: rounded(chartdata.donut(table(s, d, "part"), "p_brand")), f"SELECT *, {r('100.0 * n / sum(n) OVER ()')} AS pct FROM ({others_sql('p_brand', 'part', 8, 8)}) q")
register("smart_numeric", lambda s, d: rounded(chartdata.smart_numeric(events(s, d), "value", "event_id")["histogram"]), histogram_sql(["value"], "events", 30))
register("smart_categorical", lambda s, d: chartdata.smart_categorical(table(s, d, "part"), "p_name")["bars"], others_sql("p_name", "part", 10, 10))
register(
    "column_dashboard",
    lambda s, d: rounded(chartdata.column_dashboard(events(s, d), "value", "event_id")["summary"]),
    f"SELECT {r('avg(value)')} AS mean, {r('median(value)')} AS median, {r('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max FROM events",
)


# --- multivariate, text ---------------------------------------------------------------------------

register(
    "standardize",
    lambda s, d: rounded(multivariate.standardize(with_gaps(s, d), ["l_quantity", "l_discount"])),
    f"""WITH v AS (SELECT l_quantity, l_discount FROM {_gaps} WHERE l_discount IS NOT NULL), m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_discount) AS c, stddev_pop(l_discount) AS e FROM v)
SELECT {r('(l_quantity - a) / b')} AS l_quantity, {r('(l_discount - c) / e')} AS l_discount FROM v, m""",
)
_R2 = "(SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem)"
register(
    "pca_components",
    lambda s, d: rounded(multivariate.pca_components(lineitem(s, d), ["l_quantity", "l_extendedprice"])).select("component", "column", "explained", "explained_ratio", F.round(F.abs("loading"), 6).alias("loading")),
    f"""SELECT k.k AS component, n.n AS "column", {r('1 + abs(c) * CASE WHEN k.k = 1 THEN 1 ELSE -1 END')} AS explained, {r('(1 + abs(c) * CASE WHEN k.k = 1 THEN 1 ELSE -1 END) / 2')} AS explained_ratio, {r('sqrt(0.5)')} AS loading
FROM {_R2} c, (SELECT unnest([1, 2]) AS k) k, (SELECT unnest(['l_quantity', 'l_extendedprice']) AS n) n""",
)
# Two standardised columns have the diagonals as their components.
register(
    "pca",
    lambda s, d: multivariate.pca(lineitem(s, d), ["l_extendedprice", "l_quantity"], keep=["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", F.round(F.abs("pc1"), 5).alias("pc1_size"), F.round(F.abs("pc2"), 5).alias("pc2_size")
    ),
    """WITH z AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS a, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS b,
  corr(l_extendedprice, l_quantity) OVER () AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(abs(CASE WHEN r >= 0 THEN a + b ELSE a - b END) / sqrt(2), 5) AS pc1_size, round(abs(CASE WHEN r >= 0 THEN a - b ELSE a + b END) / sqrt(2), 5) AS pc2_size FROM z""",
)


def _far_groups(s, d):
    """Customers moved into three groups that are far apart."""
    group = F.col("c_custkey") % 3
    return table(s, d, "customer").select("c_custkey", (group * 1_000_000 + F.col("c_acctbal")).alias("x"), ((2 - group) * 500_000 + F.col("c_nationkey")).cast("double").alias("y"))


_FAR = "(SELECT c_custkey, c_custkey % 3 AS g, (c_custkey % 3) * 1000000 + c_acctbal AS x, (2 - c_custkey % 3) * 500000 + c_nationkey AS y FROM customer) t"
register(
    "kmeans",
    lambda s, d: rounded(multivariate.kmeans_centers(_far_groups(s, d), ["x", "y"]), 3),
    f"""SELECT g::INTEGER AS cluster, count(*) AS size, 'x' AS "column", {r('avg(x)', 3)} AS center FROM {_FAR} GROUP BY g
UNION ALL SELECT g::INTEGER, count(*), 'y', {r('avg(y)', 3)} FROM {_FAR} GROUP BY g""",
)
register("kmeans_labels", lambda s, d: multivariate.kmeans(_far_groups(s, d), ["x", "y"], keep=["c_custkey"]).select("c_custkey", F.col("cluster").cast("int").alias("cluster")), f"SELECT c_custkey, g::INTEGER AS cluster FROM {_FAR}")
_WORDS = r"""SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_'']+')) AS word FROM documents"""
register("word_frequencies", lambda s, d: text.word_frequencies(table(s, d, "documents"), "text"), f"SELECT word, count(*) AS n FROM ({_WORDS}) w GROUP BY 1 ORDER BY n DESC, word LIMIT 200")
register(
    "word_frequencies_all",
    lambda s, d: text.word_frequencies(table(s, d, "documents"), "text", top_n=None, stopwords=["the", "and", "of"]),
    f"SELECT word, count(*) AS n FROM ({_WORDS}) w WHERE word NOT IN ('the', 'and', 'of') GROUP BY 1",
)
_COUNT = r"len(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']+'))"
register(
    "text_stats",
    lambda s, d: rounded(text.text_stats(table(s, d, "documents"))),
    per_column_sql(
        ["text", "lang", "source"],
        "count({c}) AS count, min(length({c})) AS min_length, " + r("avg(length({c}))") + " AS mean_length, max(length({c})) AS max_length, "
        + f"min({_COUNT}) AS min_words, {r('avg(' + _COUNT + ')')} AS mean_words, max({_COUNT}) AS max_words, " + r("count(DISTINCT {c}) / count({c})") + " AS distinct_ratio",
        "documents",
    ),
)


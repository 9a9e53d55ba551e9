"""The data behind each chart type, reduced by Spark to what the chart needs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.special import norm_ppf, t_ppf
from tablescope.functions.stats import guarded_corr, ratio
from tablescope.kinds import column_kind, doubles_of, field_type, missing_to_null, numeric_columns, quoted
from tablescope.operators.corr import corr_matrix
from tablescope.operators.freq import gated_categories
from tablescope.operators.order import materialize, running_totals, sized, with_row_index
from tablescope.operators.quality import category_overview
from tablescope.operators.quantiles import exact_quantiles
from tablescope.operators.select import sample_rows, to_numeric, top_n_plus_others, top_values
from tablescope.operators.series import rolling_mean

SQRT_2PI = math.sqrt(2 * math.pi)
KERNEL_REACH = 9.0  # exp(-9^2 / 2) < 3e-18: farther grid points do not change a double


def _ranges(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per name, one aggregate; absent when there are no values."""
    cells = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{i}") for i, c in enumerate(columns.values())]
    row = df.agg(*cells).first()
    got = {name: row[f"_{i}"] for i, name in enumerate(columns)}
    return {name: (r["lo"], r["hi"]) for name, r in got.items() if r["lo"] is not None}


# --- histograms -----------------------------------------------------------------------------------

def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30, density: bool = False) -> DataFrame:
    """``(column, bin, left_edge, right_edge, n)`` with equal bins over [min, max], the last one closed.

    A constant column is given the range value ± 0.5. With ``density`` also the count over N times width.
    """
    names = list(cols) if cols else numeric_columns(df)
    ranges = _ranges(df, {c: doubles_of(df, c) for c in names})
    ranges = {c: (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5) for c, (lo, hi) in ranges.items()}
    cells, edges = [], []
    for c, (lo, hi) in ranges.items():
        width = (hi - lo) / bins
        at = F.least(F.floor((doubles_of(df, c) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin")))
        edges += [(c, i, lo + i * width, hi if i == bins - 1 else lo + (i + 1) * width) for i in range(bins)]
    frame = df.sparkSession.createDataFrame(edges, "column string, bin int, left_edge double, right_edge double")
    if not cells:
        return frame.withColumn("n", F.lit(0).cast("bigint"))
    counted = (
        df.select(F.inline(F.array(*cells))).filter(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    out = frame.join(counted, ["column", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    if density:
        total = F.sum("n").over(Window.partitionBy("column"))
        out = out.withColumn("density", ratio(F.col("n"), total * (F.col("right_edge") - F.col("left_edge"))))
    return out


def equal_width_cut(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``(bin, left_edge, right_edge, n)`` of right-closed intervals; the first left edge is 0.1 % lower."""
    value = doubles_of(df, column)
    ranges = _ranges(df, {column: value})
    schema = "bin int, left_edge double, right_edge double"
    if column not in ranges:
        return df.sparkSession.createDataFrame([], schema + ", n bigint")
    lo, hi = ranges[column]
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi, lowest = lo - pad, hi + pad, lo - pad
    else:
        lowest = lo - 0.001 * (hi - lo)
    width = (hi - lo) / bins
    frame = df.sparkSession.createDataFrame(
        [(i, lowest if i == 0 else lo + i * width, hi if i == bins - 1 else lo + (i + 1) * width) for i in range(bins)], schema
    )
    at = F.least(F.greatest(F.ceil((value - F.lit(lo)) / F.lit(width)), F.lit(1)), F.lit(bins)) - 1
    counted = df.select(at.cast("int").alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


# --- box statistics -------------------------------------------------------------------------------

def box_stats(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (the last value within k·IQR of the box) and flier count per column."""
    names = list(cols) if cols else numeric_columns(df)
    got = exact_quantiles(df, names, (0.25, 0.5, 0.75))
    cells = []
    for c in (c for c in names if (None, c, 0.5) in got):
        q1, q2, q3 = (got[None, c, p] for p in (0.25, 0.5, 0.75))
        cells.append(F.struct(F.lit(c).alias("column"), *_box(doubles_of(df, c), F.lit(q1), F.lit(q2), F.lit(q3), k)).alias(f"_{len(cells)}"))
    if not cells:
        return df.sparkSession.createDataFrame([], f"column string, {_BOX_SCHEMA}")
    return df.agg(*cells).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cells))])))


_BOX_SCHEMA = "n bigint, q1 double, median double, q3 double, whisker_low double, whisker_high double, fliers bigint"


def _box(value: Column, q1: Column, q2: Column, q3: Column, k: float) -> list[Column]:
    low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    return [
        F.count(value).alias("n"),
        F.first(q1).alias("q1"),
        F.first(q2).alias("median"),
        F.first(q3).alias("q3"),
        F.min(F.when(value >= low, value)).alias("whisker_low"),
        F.max(F.when(value <= high, value)).alias("whisker_high"),
        F.count_if((value < low) | (value > high)).alias("fliers"),
    ]


def box_stats_by(df: DataFrame, cat: str, num: str, top: int | None = None, k: float = 1.5) -> DataFrame:
    """Box statistics of ``num`` per level of ``cat``; with ``top``, of the largest levels only."""
    rows = df.select(quoted(cat).cast("string").alias("level"), doubles_of(df, num).alias("value")).dropna()
    if top is not None:
        sizes = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level")
        rows = rows.filter(F.col("level").isin([r["level"] for r in sizes.limit(top).collect()]))
    # One range shuffle orders all levels; a level's order statistics are rows at known places.
    placed = materialize(running_totals(rows.withColumn("one", F.lit(1).cast("bigint")), ["level", "value"], ["one"]).drop("one"))
    levels = sized(placed.groupBy("level").agg(F.min("one_before").alias("first"), F.count(F.lit(1)).alias("rows")))
    at = F.col("one_before") - F.col("first")
    marks = {f"q{i}": (F.col("rows") - 1) * p for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))}
    numbered = placed.join(levels, "level")
    near = [(F.floor(m), F.least(F.floor(m) + 1, F.col("rows") - 1)) for m in marks.values()]
    held = numbered.filter(reduce(lambda a, b: a | b, [(at == low) | (at == high) for low, high in near]))
    ends = held.groupBy("level", "rows").agg(
        *[F.max(F.when(at == place, F.col("value"))).alias(f"{q}_{k}") for q, pair in zip(marks, near) for k, place in enumerate(pair)]
    )
    boxes = sized(ends.select("level", *[(F.col(f"{q}_0") + (F.col(f"{q}_1") - F.col(f"{q}_0")) * (m - F.floor(m))).alias(q) for q, m in marks.items()]))
    return placed.join(boxes, "level").groupBy("level").agg(*_box(F.col("value"), F.col("q1"), F.col("q2"), F.col("q3"), k))


# --- distribution curves --------------------------------------------------------------------------

def ecdf(df: DataFrame, column: str, convention: str = "span") -> DataFrame:
    """``(value, n, cumulative, y)`` per distinct value.

    ``span`` runs from 0 at the first row to 1 at the last: y = (i - 1)/(N - 1) for a value's last row i.
    ``standard`` is i/N.
    """
    counted = (
        df.select(doubles_of(df, column).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(counted, "value", ["n"])
    cumulative = F.col("n_before") + F.col("n")
    total = placed.agg(F.sum("n")).scalar()
    y = ratio(cumulative - 1, total - 1) if convention == "span" else ratio(cumulative, total)
    return placed.select("value", "n", cumulative.alias("cumulative"), y.alias("y"))


def hist_ecdf(df: DataFrame, column: str, bins: int = 30) -> dict[str, DataFrame]:
    rows = df.select(to_numeric(df, column).alias(column))
    return {"histogram": histogram(rows, [column], bins), "ecdf": ecdf(rows, column)}


def kde(
    df: DataFrame, column: str, grid: int = 1000, lo: float | None = None, hi: float | None = None, bandwidth: float | None = None
) -> DataFrame:
    """``(point, x, density)``: Gaussian density with Scott's bandwidth on an even grid.

    The grid extends half the data range beyond both ends unless ``lo`` and ``hi`` are given. See ``_densities``.
    """
    rows = df.select(F.lit("").alias("level"), doubles_of(df, column).alias("v"))
    return _densities(rows, grid, lo, hi, bandwidth).drop("level")


TERMS = 15  # of the expansion
CELL = 0.5  # of a bandwidth, the width of a cell


def _densities(rows: DataFrame, grid: int, lo: float | None = None, hi: float | None = None, bandwidth: float | None = None) -> DataFrame:
    """``(level, point, x, density)`` of (level, v) by a fast Gauss transform, all levels in one aggregate.

    Values are summed into cells half a bandwidth wide, as the moments sum(t^k) / k! of their distances t from the middle, in
    bandwidths. A cell then adds sum of He_k(y) times moment k, times exp(-y^2/2), to the points it reaches. As |t| <= 1/4 and
    |He_k(y)| exp(-y^2/4) <= 1.09 sqrt(k!), the terms left out are below 1.1 * 4^-15 / sqrt(15!) < 10^-14 of the kernel's peak per value.
    Levels of fewer than two values, or of equal ones, have no density.
    """
    rows = rows.filter(F.col("v").isNotNull() & F.col("level").isNotNull())
    facts = rows.groupBy("level").agg(F.count("v").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).filter("n > 1 AND s > 0")
    half = (F.col("high") - F.col("low")) / 2
    begin = F.col("low") - half if lo is None else F.lit(float(lo))
    end = F.col("high") + half if hi is None else F.lit(float(hi))
    h = F.lit(float(bandwidth)) if bandwidth else F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-1 / 5))
    facts = sized(facts.select("level", "n", "low", begin.alias("start"), ((end - begin) / (grid - 1)).alias("step"), h.alias("h")))
    celled = rows.join(facts, "level").withColumn("cell", F.floor((F.col("v") - F.col("low")) / (F.col("h") * CELL)).cast("bigint"))
    t = "((v - low) / h - (cell + 0.5D) * %rD)" % CELL
    moments = [F.expr(f"sum({'1D' if not k else ' * '.join([t] * k)}) / {float(math.factorial(k))!r}D").alias(f"m{k}") for k in range(TERMS)]
    middle = F.col("low") + (F.col("cell") + 0.5) * CELL * F.col("h")
    cells = celled.groupBy("level", "cell").agg(*moments).join(facts, "level").withColumn("middle", middle)
    reach = (KERNEL_REACH + CELL) * F.col("h")
    first = F.greatest(F.ceil((F.col("middle") - reach - F.col("start")) / F.col("step")), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("middle") + reach - F.col("start")) / F.col("step")), F.lit(grid - 1)).cast("int")
    terms = ", ".join(f"named_struct('a', m{k}, 'k', {k + 1}D)" for k in range(TERMS - 1, -1, -1))
    reached = (
        cells.withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn("terms", F.expr(f"array({terms})"))
        .select("level", "middle", "h", "start", "step", "terms", F.explode(F.sequence("first", "last")).alias("point"))
        .withColumn("y", (F.col("start") + F.col("point") * F.col("step") - F.col("middle")) / F.col("h"))
    )
    series = "aggregate(terms, named_struct('p', 0D, 'q', 0D), (s, e) -> named_struct('p', e.a + y * s.p - e.k * s.q, 'q', s.p), s -> s.p)"
    sums = reached.groupBy("level", "point").agg(F.sum(F.expr(f"exp(-0.5D * y * y) * {series}")).alias("sum"))
    points = facts.select("level", "n", "start", "step", "h", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    density = F.greatest(F.coalesce(F.col("sum"), F.lit(0.0)), F.lit(0.0)) / (F.col("n") * F.col("h") * SQRT_2PI)
    return points.join(sums, ["level", "point"], "left").select("level", "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"), density.alias("density"))


def ridge(df: DataFrame, column: str, grid: int = 1000) -> DataFrame:
    """The filled curve of a ridge plot: the density itself."""
    return kde(df, column, grid)


def violin(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """The outline of a violin: the density between the smallest and the largest value."""
    ranges = _ranges(df, {column: doubles_of(df, column)})
    lo, hi = ranges.get(column, (None, None))
    return kde(df, column, points, lo, hi)


def center_lines(df: DataFrame, column: str) -> DataFrame:
    """Mean, median and quartiles, the lines drawn into density and violin plots."""
    got = exact_quantiles(df, [column], (0.25, 0.5, 0.75))
    q1, q2, q3 = (F.lit(got.get((None, column, p))).cast("double") for p in (0.25, 0.5, 0.75))
    return df.agg(F.avg(doubles_of(df, column)).alias("mean")).select("mean", q2.alias("median"), q1.alias("q1"), q3.alias("q3"))


def kde_by(df: DataFrame, column: str, group: str, max_groups: int | None = None, grid: int = 1000) -> DataFrame:
    """``(level, point, x, density)`` for every level, or the first ``max_groups`` in sorted order."""
    rows = df.select(quoted(group).alias("level"), doubles_of(df, column).alias("v"))
    if max_groups is not None:
        first = rows.filter(F.col("level").isNotNull()).select("level").distinct().orderBy("level").limit(max_groups)
        rows = rows.join(F.broadcast(first), "level", "left_semi")
    return _densities(rows.select(F.col("level").cast("string").alias("level"), "v"), grid)


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """``(position, theoretical, ordered)``: ordered values against normal order-statistic medians."""
    rows = df.select(doubles_of(df, column).alias("ordered")).filter(F.col("ordered").isNotNull())
    n = rows.count()
    indexed = with_row_index(rows, "ordered", "_i")
    i = F.col("_i") + 1
    end = 0.5 ** (1 / n) if n else 0.5
    median = F.when(i == 1, F.lit(1 - end)).when(i == n, F.lit(end)).otherwise((i - 0.3175) / (n + 0.365))
    return indexed.select(i.alias("position"), norm_ppf(median).alias("theoretical"), "ordered")


def qq_fit(points: DataFrame) -> DataFrame:
    """Least-squares line through the points of ``qq_points``."""
    x, y = F.col("theoretical"), F.col("ordered")
    slope = F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0))
    return points.agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), guarded_corr(x, y).alias("r"))


# --- point clouds ---------------------------------------------------------------------------------

def scatter_points(df: DataFrame, x: str, y: str, log: bool = False) -> DataFrame:
    """``(x, y)`` with both sides numeric and present; for log axes only positive pairs."""
    rows = df.select(to_numeric(df, x).alias("x"), to_numeric(df, y).alias("y")).dropna()
    return rows.filter((F.col("x") > 0) & (F.col("y") > 0)) if log else rows


def scatter_or_hexbin(df: DataFrame, x: str, y: str, log: bool = False, kind: str = "scatter") -> DataFrame:
    """The points, or their hexbin with ``kind="hexbin"``, which suits large tables."""
    points = scatter_points(df, x, y, log)
    if kind not in ("scatter", "hexbin"):
        raise ValueError(f"unknown kind: {kind}")
    return hexbin(points, "x", "y") if kind == "hexbin" else points


def index_scatter(df: DataFrame, column: str, order_by, cap: int | None = None, seed: int = 42) -> DataFrame:
    """``(idx, value)`` in row order; with ``cap``, a sample of so many points."""
    indexed = with_row_index(df.select(doubles_of(df, column).alias("value"), *[quoted(o).alias(f"_o{i}") for i, o in enumerate(_list(order_by))]), [f"_o{i}" for i in range(len(_list(order_by)))], "idx")
    points = indexed.select("idx", "value").filter(F.col("value").isNotNull())
    return (sample_rows(points, cap, seed, ["idx"]) if cap else points).orderBy("idx")


def _list(order_by) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def line_points(df: DataFrame, column: str, order_by, n: int = 100) -> DataFrame:
    """The first ``n`` values in row order."""
    keys = [quoted(o) for o in _list(order_by)]
    value = doubles_of(df, column)
    first = df.filter(value.isNotNull()).orderBy(*keys).limit(n).select(value.alias("value"), *[k.alias(f"_o{i}") for i, k in enumerate(keys)])
    order = Window.partitionBy(F.lit(0)).orderBy(*[f"_o{i}" for i in range(len(keys))])
    return first.select((F.row_number().over(order) - 1).cast("bigint").alias("idx"), "value")


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 40, square: bool = False) -> DataFrame:
    """``(lattice, ix, iy, cx, cy, n)``: counts per hexagon (two offset lattices, the nearer centre wins)."""
    points = scatter_points(df, x, y)
    ranges = _ranges(points, {"x": F.col("x"), "y": F.col("y")})
    if not ranges:
        return df.sparkSession.createDataFrame([], "lattice int, ix bigint, iy bigint, cx double, cy double, n bigint")
    nx, ny = gridsize, (gridsize if square else int(gridsize / math.sqrt(3)))
    x0, sx = _padded(*ranges["x"], nx)
    y0, sy = _padded(*ranges["y"], ny)
    u, v = (F.col("x") - F.lit(x0)) / F.lit(sx), (F.col("y") - F.lit(y0)) / F.lit(sy)
    ux, vy = F.rint(u), F.rint(v)
    fx, fy = F.floor(u).cast("double"), F.floor(v).cast("double")
    if square:
        lattice, ix, iy = F.lit(2), fx, fy
    else:
        d1 = (u - ux) * (u - ux) + 3 * (v - vy) * (v - vy)
        d2 = (u - fx - 0.5) * (u - fx - 0.5) + 3 * (v - fy - 0.5) * (v - fy - 0.5)
        lattice = F.when(d1 < d2, 1).otherwise(2)
        ix, iy = F.when(d1 < d2, ux).otherwise(fx), F.when(d1 < d2, vy).otherwise(fy)
    counted = (
        points.select(lattice.alias("lattice"), ix.cast("bigint").alias("ix"), iy.cast("bigint").alias("iy"))
        .groupBy("lattice", "ix", "iy")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shift = F.when(F.col("lattice") == 2, 0.5).otherwise(0.0)
    return counted.select(
        "lattice", "ix", "iy", ((F.col("ix") + shift) * sx + x0).alias("cx"), ((F.col("iy") + shift) * sy + y0).alias("cy"), "n"
    )


def _padded(lo: float, hi: float, cells: int) -> tuple[float, float]:
    """Origin and cell size of a range widened a little, so that its ends fall inside."""
    if lo == hi:
        lo, hi = lo - 0.1, hi + 0.1
    pad = 1e-9 * (hi - lo)
    lo, hi = lo - pad, hi + pad
    return lo, (hi - lo) / cells


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(n, slope, intercept, r)`` of the least-squares line over complete rows; empty under 3 rows."""
    points = scatter_points(df, x, y)
    slope = F.covar_pop("x", "y") / F.nullif(F.var_pop("x"), F.lit(0.0))
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        slope.alias("slope"),
        (F.avg("y") - slope * F.avg("x")).alias("intercept"),
        guarded_corr(F.col("x"), F.col("y")).alias("r"),
    ).filter(F.col("n") >= 3)


def regression_band(df: DataFrame, x: str, y: str, points: int = 100, level: float = 0.95) -> DataFrame:
    """``(x, fit, lower, upper)``: the line and the analytic confidence band of its mean on an even grid."""
    cloud = scatter_points(df, x, y)
    facts = cloud.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.var_pop("x").alias("vx"),
        F.var_pop("y").alias("vy"),
        F.covar_pop("x", "y").alias("cxy"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
    ).filter((F.col("n") >= 3) & (F.col("vx") > 0))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    grid = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", at)
    slope = F.col("cxy") / F.col("vx")
    fit = F.col("my") + slope * (F.col("x") - F.col("mx"))
    residual = F.greatest(F.col("vy") - slope * F.col("cxy"), F.lit(0.0)) * F.col("n") / (F.col("n") - 2)
    gap = F.col("x") - F.col("mx")
    error = F.sqrt(residual * (1 / F.col("n") + gap * gap / (F.col("n") * F.col("vx"))))
    t = t_ppf(F.lit((1 + level) / 2), (F.col("n") - 2).cast("double"))
    wide = grid.select("x", fit.alias("fit"), error.alias("_e"), t.alias("_t"))
    return wide.select("x", "fit", (F.col("fit") - F.col("_t") * F.col("_e")).alias("lower"), (F.col("fit") + F.col("_t") * F.col("_e")).alias("upper"))


def pair_grid(df: DataFrame, cols: Sequence[str] | None = None, max_cols: int | None = None, sample: int | None = None) -> dict[str, DataFrame]:
    """A 20-bin histogram per column, r per pair, and the complete rows (with ``sample``, so many) for the scatter panels."""
    names = (list(cols) if cols else numeric_columns(df))[:max_cols]
    rows = df.select(*[doubles_of(df, c).alias(c) for c in names])
    return {
        "histograms": histogram(rows, names, bins=20),
        "correlations": corr_matrix(rows, "pearson", names),
        "points": rows.dropna() if sample is None else sample_rows(rows.dropna(), sample),
    }


# --- fields ---------------------------------------------------------------------------------------

def grid_field(df: DataFrame, x: str, y: str, z: str, nx: int = 100, ny: int = 100) -> DataFrame:
    """``(ix, iy, z, n)``: mean of ``z`` per cell of an nx by ny grid; empty under 10 complete rows."""
    rows = df.select(to_numeric(df, x).alias("x"), to_numeric(df, y).alias("y"), to_numeric(df, z).alias("z")).dropna()
    facts = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if facts[0] < 10:
        return df.sparkSession.createDataFrame([], "ix bigint, iy bigint, z double, n bigint")

    def cell(name: str, lo: float, hi: float, cells: int) -> Column:
        width = (hi - lo) / cells or 1.0
        return F.least(F.floor((F.col(name) - F.lit(lo)) / F.lit(width)), F.lit(cells - 1)).cast("bigint")

    return (
        rows.groupBy(cell("x", facts[1], facts[2], nx).alias("ix"), cell("y", facts[3], facts[4], ny).alias("iy"))
        .agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))
    )


def vector_field(df: DataFrame, x: str, y: str, u: str, v: str, min_rows: int = 5) -> DataFrame:
    """``(x, y, u, v, magnitude)`` with u and v divided by the largest magnitude."""
    rows = _vectors(df, x, y, u, v)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("magnitude").alias("top")).first()
    if facts["n"] < min_rows:
        return rows.limit(0)
    scale = F.lit(facts["top"] or 1.0)
    return rows.select("x", "y", (F.col("u") / scale).alias("u"), (F.col("v") / scale).alias("v"), "magnitude")


def _vectors(df: DataFrame, x: str, y: str, u: str, v: str) -> DataFrame:
    rows = df.select(*[to_numeric(df, c).alias(k) for k, c in {"x": x, "y": y, "u": u, "v": v}.items()]).dropna()
    return rows.withColumn("magnitude", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))


def vector_field_stats(df: DataFrame, x: str, y: str, u: str, v: str) -> DataFrame:
    return _vectors(df, x, y, u, v).agg(
        F.count(F.lit(1)).alias("n"), F.avg("magnitude").alias("mean_magnitude"), F.max("magnitude").alias("max_magnitude")
    )


def encoded_scatter(df: DataFrame, x: str, y: str, size: str | None = None, color: str | None = None) -> DataFrame:
    """``(x, y, marker_size, color_code)``: sizes 20 … 100, text colours as sorted category codes, -1 if missing."""
    cells = {"x": to_numeric(df, x), "y": to_numeric(df, y)}
    if size:
        cells["_s"] = to_numeric(df, size)
    rows = df.select(
        *[c.alias(k) for k, c in cells.items()], *([missing_to_null(color, field_type(df, color)).alias("_c")] if color else [])
    ).dropna(subset=list(cells))
    marker: Column = F.lit(20.0)
    if size:
        ranges = _ranges(rows, {"_s": F.col("_s")})
        lo, hi = ranges.get("_s", (0.0, 0.0))
        marker = F.lit(20.0) + 80.0 * (F.col("_s") - lo) / (hi - lo) if hi > lo else F.lit(20.0)
    if not color:
        return rows.select("x", "y", marker.alias("marker_size"), F.lit(None).cast("double").alias("color_code"))
    if column_kind(field_type(df, color)) == "numeric":
        return rows.select("x", "y", marker.alias("marker_size"), F.col("_c").cast("double").alias("color_code"))
    levels = rows.select("_c").filter(F.col("_c").isNotNull()).distinct()
    codes = with_row_index(levels, "_c", "_code")
    coded = rows.join(codes, "_c", "left")
    return coded.select("x", "y", marker.alias("marker_size"), F.coalesce("_code", F.lit(-1)).cast("double").alias("color_code"))


def marginal_densities(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Density histograms of both axes of a scatter plot, over its complete rows."""
    return histogram(scatter_points(df, x, y), ["x", "y"], bins, density=True)


# --- bars and pies --------------------------------------------------------------------------------

def bar_topk(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values, missing counted as a value."""
    return top_values(df, column, k, dropna=False)


def _shares(counts: DataFrame) -> DataFrame:
    """Add each row's percentage; ``counts`` has at most a few dozen rows."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", ratio(F.col("n"), total) * 100)


def bar_counts(df: DataFrame, column: str, n: int = 14, at_most: int = 15, numeric_levels: int = 20) -> DataFrame:
    """``(value, n)``: ten equal-width classes of a number with many values, else top ``n`` and Others."""
    if column_kind(field_type(df, column)) == "numeric" and not gated_categories(df, [column], numeric_levels, 0):
        cut = equal_width_cut(df, column, 10)
        label = F.concat(F.lit("("), F.round("left_edge", 3).cast("string"), F.lit(", "), F.round("right_edge", 3).cast("string"), F.lit("]"))
        return cut.select(label.alias("value"), "n")
    return top_n_plus_others(df, column, n, at_most)


def pie_counts(df: DataFrame, column: str, n: int = 9, at_most: int = 10) -> DataFrame:
    """``(value, n, pct)``: the top ``n`` values and Others when there are more than ``at_most``."""
    return _shares(top_n_plus_others(df, column, n, at_most))


def donut(df: DataFrame, column: str, n: int = 8, at_most: int = 8) -> DataFrame:
    """The same counts as a pie, with fewer slices."""
    return _shares(top_n_plus_others(df, column, n, at_most))


# --- dashboards -----------------------------------------------------------------------------------

def smart_numeric(df: DataFrame, column: str, order_by, points: int | None = None) -> dict[str, DataFrame]:
    """Histogram, points (with ``points``, a sample of so many), rolling trend and violin of one numeric column."""
    return {
        "histogram": histogram(df, [column], 30),
        "scatter": index_scatter(df, column, order_by, cap=points),
        "trend": rolling_mean(df, _list(order_by)[0], column, 5, 0),
        "violin": violin(df, column),
    }


def smart_categorical(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """Top ten values with Others, as bars and as shares, and the column's overview."""
    return {
        "bars": top_n_plus_others(df, column, 10, 10),
        "donut": donut(df, column, 10, 10),
        "overview": category_overview(df, column),
    }


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """``(mean, median, std, min, max)`` of one column."""
    v = doubles_of(df, column)
    got = exact_quantiles(df, [column], (0.5,))
    return df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")).select(
        "mean", F.lit(got.get((None, column, 0.5))).cast("double").alias("median"), "std", "min", "max"
    )


def column_dashboard(df: DataFrame, column: str, order_by) -> dict[str, DataFrame]:
    """The panels for one column: distribution, box, first values and summary, or category panels."""
    if column_kind(field_type(df, column)) != "numeric":
        return smart_categorical(df, column)
    return {
        "histogram": histogram(df, [column], 20),
        "box": box_stats(df, [column]),
        "line": line_points(df, column, order_by, 100),
        "summary": numeric_summary(df, column),
    }

"""Association of all categorical column pairs, from one set of contingency tables.

All pairs are counted in one scan, as tables of counts by level numbers that each task adds up. The cardinality gate bounds the
cells of a pair, so everything after that works on small tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.special import chi2_sf
from tablescope.functions.stats import ratio
from tablescope.kinds import quoted, string_columns
from tablescope.operators.freq import gated_categories
from tablescope.plans.config import RelationConfig

PAIR = ["col1", "col2"]
CELL_SCHEMA = "col1 string, col2 string, v1 string, v2 string, n bigint"
MOST_CELLS = 1 << 25  # counts a task holds
MOST_LEVELS = 1 << 18  # levels a task numbers; the gate of the analyses is far below


def usable_categories(df: DataFrame, config: RelationConfig, cols: Sequence[str] | None = None, min_levels: int = 1) -> list[str]:
    names = list(cols) if cols else string_columns(df)
    return list(gated_categories(df, names, config.max_cardinality, min_levels))


def cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(col1, col2, v1, v2, n)`` for every pair, from one scan; rows with a missing side are dropped.

    A task numbers the levels of each column as they come and adds up a table of counts for every pair; what it has
    counted goes out once, or whenever the tables reach a fixed number of cells.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], CELL_SCHEMA)
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    sides = [(names.index(a), names.index(b)) for a, b in pairs]
    texts = df.select(*[quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(names)])
    counted = texts.mapInArrow(lambda batches: _pair_counts(batches, sides), "pair int, v1 string, v2 string, n long")
    summed = counted.groupBy("pair", "v1", "v2").agg(F.sum("n").alias("n"))
    firsts, seconds = (F.get(F.lit([p[k] for p in pairs]), F.col("pair")) for k in (0, 1))
    return summed.select(firsts.alias("col1"), seconds.alias("col2"), "v1", "v2", "n")


def _pair_counts(batches: Iterator[pa.RecordBatch], sides: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    levels: list[dict[str, int]] = []
    tables: dict[int, np.ndarray] = {}
    held = 0

    def give() -> Iterator[pa.RecordBatch]:
        names = [pa.array(list(own), pa.string()) for own in levels]
        for p, table in tables.items():
            i, j = np.nonzero(table)
            a, b = sides[p]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), p, np.int32)), names[a].take(pa.array(i)), names[b].take(pa.array(j)), pa.array(table[i, j])], names=["pair", "v1", "v2", "n"]
            )

    for batch in batches:
        levels = levels or [{} for _ in batch.columns]
        codes = []
        for own, column in zip(levels, batch.columns):
            coded = column.dictionary_encode()
            known = np.array([own.setdefault(v, len(own)) for v in coded.dictionary.to_pylist()] + [-1], np.int64)  # the last for missing ones
            codes.append(known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)])
        for p, (a, b) in enumerate(sides):
            wide = max(len(levels[b]), 1)
            both = codes[a] * wide + codes[b]
            both = both[(codes[a] >= 0) & (codes[b] >= 0)]
            old = tables.get(p)
            shape = (len(levels[a]), len(levels[b]))
            if shape[0] * shape[1] > max(1 << 16, 4 * batch.num_rows):  # more cells than rows: only those that occur
                found, n = np.unique(both, return_counts=True)
                names = [pa.array(list(levels[k]), pa.string()) for k in (a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), p, np.int32)), names[0].take(pa.array(found // wide)), names[1].take(pa.array(found % wide)), pa.array(n.astype(np.int64))],
                    names=["pair", "v1", "v2", "n"],
                )
                continue
            if old is None or old.shape != shape:
                table = np.zeros(shape, np.int64)
                if old is not None:
                    table[: old.shape[0], : old.shape[1]] = old
                    held -= old.size
                held += table.size
                tables[p] = old = table
            old += np.bincount(both, minlength=old.size).reshape(shape)
        if held > MOST_CELLS:
            yield from give()
            tables, held = {}, 0
        if any(len(own) > MOST_LEVELS for own in levels):
            yield from give()
            levels, tables, held = [], {}, 0
    yield from give()


def with_margins(table: DataFrame) -> DataFrame:
    """Add row, column and table totals of each pair; for gated pairs only."""
    return (
        table.withColumn("row_n", F.sum("n").over(Window.partitionBy(*PAIR, "v1")))
        .withColumn("col_n", F.sum("n").over(Window.partitionBy(*PAIR, "v2")))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*PAIR)))
    )


def contingency(
    df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None, gated: bool = False
) -> DataFrame:
    """Contingency tables of all pairs of usable categorical columns, long form, with margins.

    ``gated`` says that ``cols`` are known to have at most ``max_cardinality`` levels.
    """
    names = list(cols or []) if gated else usable_categories(df, config, cols)
    return with_margins(cells(df, list(combinations(names, 2))))


def chi_square(
    df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None, table: DataFrame | None = None
) -> DataFrame:
    """Chi-square test, Cramer's V and strength of every pair; Yates' correction when dof is 1."""
    table = table if table is not None else contingency(df, config, cols)
    n, r, c, t = (F.col(x).cast("double") for x in ("n", "row_n", "col_n", "total"))
    expected = r * c / t
    # 1/margin summed once per level: each cell carries its share of its row and of its column
    in_row, in_col = (F.count(F.lit(1)).over(Window.partitionBy(*PAIR, v)) for v in ("v1", "v2"))
    shared = table.withColumn("_row_share", 1 / in_row).withColumn("_col_share", 1 / in_col)
    pairs = shared.groupBy(*PAIR).agg(
        F.max("total").alias("n"),
        F.count_distinct("v1").alias("levels1"),
        F.count_distinct("v2").alias("levels2"),
        F.sum(n * n / expected).alias("_ratio"),
        F.max(F.abs(n - expected)).alias("_gap"),
        F.sum(F.col("_row_share") / r).alias("_inv_rows"),
        F.sum(F.col("_col_share") / c).alias("_inv_cols"),
    )
    total = F.col("n").cast("double")
    dof = (F.col("levels1") - 1) * (F.col("levels2") - 1)
    plain = F.greatest(F.col("_ratio") - total, F.lit(0.0))
    left = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    yates = left * left * total * F.col("_inv_rows") * F.col("_inv_cols")
    smaller = (F.least("levels1", "levels2") - 1).cast("double")
    tested = pairs.select(
        *PAIR,
        "n",
        "levels1",
        "levels2",
        dof.alias("dof"),
        F.when(dof == 0, F.lit(0.0)).when(dof == 1, yates).otherwise(plain).alias("chi2"),
        smaller.alias("_smaller"),
    )
    v = F.coalesce(F.sqrt(F.col("chi2") / F.nullif(F.col("n") * F.col("_smaller"), F.lit(0.0))), F.lit(0.0))
    scored = tested.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof").cast("double"))).withColumn("cramers_v", v)
    return scored.select(
        *PAIR,
        "n",
        "levels1",
        "levels2",
        "dof",
        "chi2",
        "p_value",
        (F.col("p_value") < 0.05).alias("significant"),
        "cramers_v",
        association_label(F.col("cramers_v")).alias("strength"),
    )


def association_label(v: Column) -> Column:
    return F.when(v >= 0.5, "very_strong").when(v >= 0.3, "strong").when(v >= 0.1, "moderate").otherwise("weak")


def cramers_v(df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None) -> DataFrame:
    return chi_square(df, config, cols).select(*PAIR, "n", "cramers_v", "strength")


def theils_u(
    df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None, table: DataFrame | None = None
) -> DataFrame:
    """Uncertainty coefficients U(col1|col2) and U(col2|col1); 0 when the explained column is constant."""
    table = table if table is not None else contingency(df, config, cols)
    n, r, c, t = (F.col(x).cast("double") for x in ("n", "row_n", "col_n", "total"))
    parts = table.groupBy(*PAIR).agg(
        F.max("total").alias("n"),
        F.sum(-(n / t) * F.ln(r / t)).alias("_h1"),
        F.sum(-(n / t) * F.ln(c / t)).alias("_h2"),
        F.sum(-(n / t) * F.ln(n / c)).alias("_h1_given_2"),
        F.sum(-(n / t) * F.ln(n / r)).alias("_h2_given_1"),
    )

    def u(h: str, given: str) -> Column:
        return F.coalesce((F.col(h) - F.col(given)) / F.nullif(F.col(h), F.lit(0.0)), F.lit(0.0))

    return parts.select(*PAIR, "n", u("_h1", "_h1_given_2").alias("u_col1_given_col2"), u("_h2", "_h2_given_1").alias("u_col2_given_col1"))


def association_rules(
    df: DataFrame,
    config: RelationConfig = RelationConfig(),
    cols: Sequence[str] | None = None,
    table: DataFrame | None = None,
    per_pair: int = 5,
) -> DataFrame:
    """Value pairs with their support, confidence and lift, the ``per_pair`` highest lifts of each pair."""
    table = table if table is not None else contingency(df, config, cols)
    scored = table.select(
        *PAIR,
        "v1",
        "v2",
        "n",
        ratio(F.col("n"), F.col("total")).alias("support"),
        ratio(F.col("n"), F.col("row_n")).alias("confidence"),
        ratio(F.col("n").cast("double") * F.col("total"), F.col("row_n").cast("double") * F.col("col_n")).alias("lift"),
    )
    order = Window.partitionBy(*PAIR).orderBy(F.desc("lift"), "v1", "v2")
    return (
        scored.filter(F.col("lift") >= config.lift_threshold)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= per_pair)
        .drop("_rank")
    )


def strong_associations(
    df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None, tested: DataFrame | None = None
) -> DataFrame:
    """Pairs by Cramer's V, strongest first, cut at top_k."""
    tested = tested if tested is not None else chi_square(df, config, cols)
    return tested.orderBy(F.desc("cramers_v"), *PAIR).limit(config.top_k)


def association_summary(
    df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None, tested: DataFrame | None = None
) -> DataFrame:
    tested = tested if tested is not None else chi_square(df, config, cols)
    return tested.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if("significant").alias("significant_pairs"),
        F.max("cramers_v").alias("max_v"),
        F.avg("cramers_v").alias("mean_v"),
        F.count_if(F.col("cramers_v") >= 0.3).alias("strong_pairs"),
    )

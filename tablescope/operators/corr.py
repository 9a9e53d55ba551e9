"""Correlation of all numeric column pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.kinds import doubles, name_sql, numeric_columns, quoted
from tablescope.operators.kendall import kendall
from tablescope.operators.moments import PARTS, ROWS_AT_ONCE, correlations, folded, folded_pairs, matrix, merged_rows, named
from tablescope.operators.order import materialize
from tablescope.operators.ranks import RankTable, by_row, few_valued, group_cells, partitions_for, rank_tables, ranked
from tablescope.plans.config import RelationConfig

PAIR_SCHEMA = "col1 string, col2 string, r double, n bigint"


def corr_matrix(df: DataFrame, method: str = "pearson", cols: Sequence[str] | None = None) -> DataFrame:
    """``(col1, col2, r, n)`` for every pair of numeric columns, col1 before col2 in table order.

    Each pair uses the rows where both sides are present; r is NULL when a side is constant.
    """
    names = list(cols) if cols else numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    if method == "pearson":
        return _pearson(df, names)
    if method == "spearman":
        return _spearman(df, names)
    if method == "kendall":
        return kendall(df, names)
    raise ValueError(f"unknown correlation method: {method}")


def _pearson(df: DataFrame, names: list[str]) -> DataFrame:
    """Masked Gram matrices of all columns, merged around shared means: one scan for any number of columns."""
    return _every_pair(df, names, correlations(doubles(df, names), names))


def _every_pair(df: DataFrame, names: list[str], found: DataFrame) -> DataFrame:
    """``found`` with a row for the pairs of a table without rows."""
    positions = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(len(names) - 2))).alias("i"))
    positions = positions.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(len(names) - 1))).alias("j"))
    label = F.lit(names)
    pairs = positions.select(F.get(label, F.col("i")).alias("col1"), F.get(label, F.col("j")).alias("col2"))
    return pairs.join(F.broadcast(found), ["col1", "col2"], "left").select("col1", "col2", "r", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _spearman(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson on average ranks: columns of few values are ranked by their counts, the cells of the others by one range shuffle; one more brings ranks and rows together.

    A column with missing values changes the rows its partners are ranked over, so cells are ranked per
    (column, partner with missing values); columns without missing values share one ranking.
    """
    values = doubles(df, names)
    facts = values.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(quoted(c)).alias(f"d{i}") for i, c in enumerate(names)],
    ).first()
    partial = {c for i, c in enumerate(names) if facts[f"n{i}"] < facts["n"]}
    different = {c: facts[f"d{i}"] for i, c in enumerate(names)}
    pairs = list(combinations(names, 2))
    contexts: dict[tuple[str, str | None], int] = {}
    for a, b in pairs:
        for key in (_context(a, b, partial), _context(b, a, partial)):
            contexts.setdefault(key, len(contexts))
    left, right = (np.array([contexts[_context(*sides, partial)] for sides in ordered]) for ordered in (pairs, [(b, a) for a, b in pairs]))
    cells = [
        (g, f"CASE WHEN {name_sql(mask)} IS NOT NULL THEN {name_sql(column)} END" if mask else name_sql(column)) for (column, mask), g in contexts.items()
    ]
    size = 64
    if not partial and list(contexts) == [(c, None) for c in names]:
        use, label = folded, lambda i, n: ([names[i]] * n, names[i + 1 :])
    else:
        use, label = lambda matrices: folded_pairs(matrices, left, right, size), lambda i, n: tuple(zip(*pairs[i * size : i * size + n]))
    few = few_valued({g: different[column] for (column, _), g in contexts.items()})
    known, others = [c for c in cells if c[0] in few], [c for c in cells if c[0] not in few]
    if not others:
        tables = rank_tables(values, known)
        ranks = values.select(*[F.expr(value).alias(f"g{g}") for g, value in known])
        parts = ranks.mapInArrow(lambda batches: use(_looked_up(batches, tables)), PARTS)
        return _every_pair(df, names, named(merged_rows(parts), label))
    numbered = values.select("*", F.monotonically_increasing_id().alias("row"))
    rows, tables = None, None
    if known:
        numbered = materialize(numbered)  # cells and rows must have the same numbers
        tables = rank_tables(numbered, known)
        rows = numbered.select("row", F.array(*[F.expr(value) for _, value in known]).alias("values"))
    n = facts["n"] * len(others)
    ranks = ranked(group_cells(numbered, others, ["row"]), "row", partitions_for(df, n))
    parts = by_row(ranks, len(contexts), partitions_for(df, n + (facts["n"] if known else 0)), use, rows, tables)
    return _every_pair(df, names, named(merged_rows(parts), label))


def _looked_up(batches: Iterator[pa.RecordBatch], tables: dict[int, RankTable]) -> Iterator[np.ndarray]:
    """Matrices of ranks of rows whose values all have rank tables."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            x = matrix(batch.slice(k, ROWS_AT_ONCE), batch.schema.names)
            yield np.stack([t.ranked(x[:, i]) for i, t in enumerate(tables.values())], axis=1)


def _context(column: str, partner: str, partial: set[str]) -> tuple[str, str | None]:
    return column, (partner if partner in partial else None)


def strength_label(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.7, "strong").otherwise("moderate")


def correlation_pairs(df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson and, with ``advanced_stats``, Spearman of every pair, and the larger magnitude of the two."""
    linear = corr_matrix(df, "pearson", cols).withColumnRenamed("r", "pearson")
    if config.advanced_stats:
        ranked = corr_matrix(df, "spearman", cols).select("col1", "col2", F.col("r").alias("spearman"))
        both = linear.join(F.broadcast(ranked), ["col1", "col2"])
    else:
        both = linear.withColumn("spearman", F.lit(None).cast("double"))
    return both.withColumn("max_abs", F.greatest(F.abs("pearson"), F.abs("spearman")))


def strong_correlations(
    df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Pairs whose larger |r| reaches the threshold, strongest first, with labels."""
    pairs = pairs if pairs is not None else correlation_pairs(df, config, cols)
    linear = F.coalesce(F.abs("pearson"), F.lit(0.0)) >= F.coalesce(F.abs("spearman"), F.lit(0.0))
    leading = F.when(linear, F.col("pearson")).otherwise(F.col("spearman"))
    return (
        pairs.filter(F.col("max_abs") >= config.correlation_threshold)
        .select(
            "col1",
            "col2",
            "pearson",
            "spearman",
            "max_abs",
            "n",
            strength_label(F.col("max_abs")).alias("strength"),
            F.when(leading > 0, "positive").otherwise("negative").alias("direction"),
            F.when(linear, "linear").otherwise("monotone").alias("relation"),
        )
        .orderBy(F.desc("max_abs"), "col1", "col2")
        .limit(config.top_k)
    )


def correlation_summary(
    df: DataFrame, config: RelationConfig = RelationConfig(), cols: Sequence[str] | None = None, matrix: DataFrame | None = None
) -> DataFrame:
    """Pair counts and sizes of the Pearson matrix, with and without its diagonal of ones.

    A ``matrix`` with ``max_abs``, the larger of two coefficients, counts strong pairs by that.
    """
    names = list(cols) if cols else numeric_columns(df)
    k = len(names)
    matrix = matrix if matrix is not None else corr_matrix(df, "pearson", names)
    size = F.abs("r")
    strength = F.col("max_abs") if "max_abs" in matrix.columns else size
    known = F.count("r").cast("double")
    return matrix.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(strength >= config.correlation_threshold).alias("strong_pairs"),
        F.count_if(strength >= 0.7).alias("very_strong_pairs"),
        F.max(size).alias("max_abs_offdiag"),
        F.avg(size).alias("mean_abs_offdiag"),
        F.greatest(F.lit(1.0), F.max(size)).alias("max_abs_incl_diag"),
        ((2 * F.coalesce(F.sum(size), F.lit(0.0)) + k) / F.nullif(2 * known + k, F.lit(0.0))).alias("mean_abs_incl_diag"),
    )


def top_correlated_pairs(df: DataFrame, k: int = 10, method: str = "pearson", cols: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` distinct pairs with the largest signed correlation."""
    return corr_matrix(df, method, cols).filter(F.col("r").isNotNull()).orderBy(F.desc("r"), "col1", "col2").limit(k)


def corr_subset(df: DataFrame, top_k: int = 20, method: str = "pearson", cols: Sequence[str] | None = None) -> DataFrame:
    """The correlations among all columns that occur in the ``top_k`` pairs by |r|."""
    matrix = corr_matrix(df, method, cols)
    leading = matrix.filter(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "col1", "col2").limit(top_k)
    chosen = leading.select(F.explode(F.array("col1", "col2")).alias("name")).distinct()
    return (
        matrix.join(F.broadcast(chosen), F.col("col1") == F.col("name"), "left_semi")
        .join(F.broadcast(chosen.withColumnRenamed("name", "other")), F.col("col2") == F.col("other"), "left_semi")
    )

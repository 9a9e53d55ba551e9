"""Dependence of numeric columns on categorical ones: ANOVA, Kruskal-Wallis, effect size.

Every (category, number) pair comes from one grouping-sets aggregate over the categories; the cardinality
gate keeps its result small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.special import chi2_sf, f_sf
from tablescope.functions.stats import ratio
from tablescope.kinds import doubles_of, numeric_columns, quoted
from tablescope.operators.assoc import usable_categories
from tablescope.operators.order import materialize
from tablescope.operators.ranks import RankTable, few_valued, group_cells, partitions_for, rank_tables, ranked
from tablescope.plans.config import RelationConfig

PAIR = ["num", "cat"]
LEVEL_SCHEMA = "num string, cat string, level string, n bigint, mean double, var_pop double"


def level_stats(
    df: DataFrame,
    config: RelationConfig,
    cats: Sequence[str] | None = None,
    nums: Sequence[str] | None = None,
    gated: bool = False,
) -> DataFrame:
    """``(num, cat, level, n, mean, var_pop)`` over rows where both sides are present, small levels removed.

    ``gated`` says that ``cats`` are known to have between 2 and ``max_cardinality`` levels.
    """
    cats = list(cats or []) if gated else usable_categories(df, config, cats, min_levels=2)
    nums = list(nums) if nums else numeric_columns(df)
    if not cats or not nums:
        return df.sparkSession.createDataFrame([], LEVEL_SCHEMA)
    keys = [quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(cats)]
    values = df.select(*keys, *[doubles_of(df, c).alias(f"v{j}") for j, c in enumerate(nums)])
    stats = [
        F.struct(F.count(f"v{j}").alias("n"), F.avg(f"v{j}").alias("mean"), F.var_pop(f"v{j}").alias("var_pop")).alias(f"s{j}")
        for j in range(len(nums))
    ]
    key_columns = [F.col(f"k{i}") for i in range(len(cats))]
    wide = values.groupingSets([[k] for k in key_columns], *key_columns).agg(F.grouping_id().alias("_set"), *stats)
    everything = (1 << len(cats)) - 1
    cat, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cats):
        here = F.col("_set") == everything - (1 << (len(cats) - 1 - i))
        cat, level = F.when(here, F.lit(c)).otherwise(cat), F.when(here, F.col(f"k{i}")).otherwise(level)
    rows = F.array(*[F.struct(F.lit(c).alias("num"), F.col(f"s{j}").alias("s")) for j, c in enumerate(nums)])
    long = (
        wide.select(cat.alias("cat"), level.alias("level"), F.inline(rows))
        .select("num", "cat", "level", "s.*")
        .filter(F.col("level").isNotNull() & (F.col("n") > 0))
    )
    return _drop_small(long, config)


def _drop_small(levels: DataFrame, config: RelationConfig) -> DataFrame:
    """Apply the minimum level size: drop the level, or the whole pair, that falls short."""
    pair = Window.partitionBy(*PAIR)
    if config.small_groups == "skip_pair":
        kept = levels.withColumn("_least", F.min("n").over(pair)).filter(F.col("_least") >= config.min_sample_size).drop("_least")
    else:
        kept = levels.filter(F.col("n") >= config.min_sample_size)
    return kept.withColumn("_levels", F.count(F.lit(1)).over(pair)).filter(F.col("_levels") >= 2).drop("_levels")


def effect_label(eta2: Column) -> Column:
    return F.when(eta2 >= 0.14, "large").when(eta2 >= 0.06, "medium").when(eta2 >= 0.01, "small").otherwise("none")


def anova(
    df: DataFrame,
    config: RelationConfig = RelationConfig(),
    cats: Sequence[str] | None = None,
    nums: Sequence[str] | None = None,
    levels: DataFrame | None = None,
) -> DataFrame:
    """One-way ANOVA of every (num, cat) pair: F, p, eta squared and effect size."""
    levels = levels if levels is not None else level_stats(df, config, cats, nums)
    pair = Window.partitionBy(*PAIR)
    weighted = levels.withColumn("_grand", F.sum(F.col("n") * F.col("mean")).over(pair) / F.sum("n").over(pair))
    gap = F.col("mean") - F.col("_grand")
    sums = weighted.groupBy(*PAIR).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("levels"),
        F.sum(F.col("n") * gap * gap).alias("_between"),
        F.sum(F.col("n") * F.col("var_pop")).alias("_within"),
    )
    d1, d2 = (F.col("levels") - 1).cast("double"), (F.col("n") - F.col("levels")).cast("double")
    f = ratio(F.col("_between") / d1, F.col("_within") / F.nullif(d2, F.lit(0.0)))
    eta2 = F.coalesce(ratio(F.col("_between"), F.col("_between") + F.col("_within")), F.lit(0.0))
    scored = sums.withColumn("f_stat", f).withColumn("eta2", eta2).withColumn("p_value", f_sf(F.col("f_stat"), d1, d2))
    return scored.select(
        *PAIR, "n", "levels", "f_stat", "p_value", (F.col("p_value") < 0.05).alias("significant"), "eta2", effect_label(F.col("eta2")).alias("effect")
    )


def kruskal(
    df: DataFrame,
    config: RelationConfig = RelationConfig(),
    cats: Sequence[str] | None = None,
    nums: Sequence[str] | None = None,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Kruskal-Wallis H (tie-corrected) and p of every (num, cat) pair, over the kept levels.

    Numbers of few values are ranked by their counts, where the rows are. The values of the others are ranked by one range shuffle,
    in which they carry the levels of their row, so that ranks are summed by level where they are found. Categories that cover every row of a number share one ranking; others rank the
    rows they cover.
    """
    levels = levels if levels is not None else level_stats(df, config, cats, nums)
    kept = levels.select(*PAIR, "level", "n").collect()
    if not kept:
        return df.sparkSession.createDataFrame([], "num string, cat string, n bigint, h_stat double, kruskal_p double")
    spark = df.sparkSession
    used = sorted({r["cat"] for r in kept})
    numbers = sorted({r["num"] for r in kept})
    code = {(cat, level): i for cat in used for i, level in enumerate(sorted({r["level"] for r in kept if r["cat"] == cat}))}
    allowed: dict[tuple[str, str], set[int]] = {}
    covered: dict[tuple[str, str], int] = {}
    for r in kept:
        pair = (r["num"], r["cat"])
        allowed.setdefault(pair, set()).add(code[r["cat"], r["level"]])
        covered[pair] = covered.get(pair, 0) + r["n"]

    coded = df.select(
        *[quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(used)],
        *[doubles_of(df, c).alias(f"v{j}") for j, c in enumerate(numbers)],
    )
    for i, c in enumerate(used):
        codes = spark.createDataFrame([(level, n) for (cat, level), n in code.items() if cat == c], f"k{i} string, c{i} int")
        coded = coded.join(F.broadcast(codes), f"k{i}", "left")
    present = coded.agg(*[f(f"v{j}").alias(f"{k}{j}") for k, f in (("v", F.count), ("d", F.approx_count_distinct)) for j in range(len(numbers))]).first()

    # A ranking is a number with the categories it serves; categories with gaps have one of their own.
    rankings: list[tuple[int, list[int]]] = []
    for j, num in enumerate(numbers):
        whole = [i for i, cat in enumerate(used) if covered.get((num, cat)) == present[f"v{j}"]]
        rankings += [(j, whole)] if whole else []
        rankings += [(j, [i]) for i, cat in enumerate(used) if (num, cat) in allowed and i not in whole]
    level_names = [f"c{i}" for i in range(len(used))]
    cells, pair_rows = [], []
    for g, (j, served) in enumerate(rankings):
        value = f"v{j}"
        for i in served:
            pair_rows.append((g, i, numbers[j], used[i]))
            among = ", ".join(str(v) for v in sorted(allowed[numbers[j], used[i]]))
            value = f"CASE WHEN c{i} IN ({among}) THEN {value} END"
        cells.append((g, value))
    levels_of = coded.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in level_names], *[f"v{j}" for j in range(len(numbers))], F.monotonically_increasing_id().alias("row"))
    # Ranks are taken from the middle rank, so that large sums do not cancel.
    sizes = [present[f"v{j}"] if len(served) > 1 else covered[numbers[j], used[served[0]]] for j, served in rankings]
    serves = [served for _, served in rankings]
    few = few_valued({g: present[f"d{j}"] for g, (j, _) in enumerate(rankings)})
    known, others = [c for c in cells if c[0] in few], [c for c in cells if c[0] not in few]
    schema = "ranking int, cat_index int, level int, rank_sum double, size long, ties double"
    found = []
    if known:
        tables = rank_tables(levels_of, known)
        looked_up = levels_of.select(*level_names, *[F.expr(value).alias(f"g{g}") for g, value in known])
        found.append(looked_up.mapInArrow(lambda batches: _rank_sums(_by_table(batches, tables), serves, sizes, len(code)), schema))
    if others:
        ranks = ranked(group_cells(levels_of, others, ["row", *level_names]), "row", partitions_for(df, sum(sizes[g] for g, _ in others)))
        found.append(ranks.mapInArrow(lambda batches: _rank_sums(_by_group(batches), serves, sizes, len(code)), schema))
    by_level = reduce(DataFrame.unionByName, found)
    sums = (
        by_level.groupBy("ranking", "cat_index", "level")
        .agg(F.sum("rank_sum").alias("rank_sum"), F.sum("size").alias("size"), F.sum("ties").alias("ties"))
        .groupBy("ranking", "cat_index")
        .agg(
            F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size")).alias("spread"),
            F.count(F.lit(1)).alias("k"),
            F.sum("size").alias("total"),
            F.sum("ties").alias("ties"),
        )
    )
    n = F.col("total").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("spread")
    correction = 1 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0))
    h = raw / F.nullif(correction, F.lit(0.0))
    names = spark.createDataFrame(pair_rows, "ranking int, cat_index int, num string, cat string")
    out = sums.join(F.broadcast(names), ["ranking", "cat_index"]).withColumn("h_stat", h)
    return out.select(*PAIR, F.col("total").alias("n"), "h_stat", chi2_sf(F.col("h_stat"), (F.col("k") - 1).cast("double")).alias("kruskal_p"))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ranking, ranks, ties, batch, cells of the batch) of ranked cells."""
    for batch in batches:
        group, rank, ties = (batch.column(c).to_numpy() for c in ("group", "rank", "ties"))
        for g in np.unique(group).tolist():
            at = group == g
            yield g, rank[at], ties[at], batch, at


def _by_table(batches: Iterator[pa.RecordBatch], tables: dict[int, RankTable]) -> Iterator[tuple]:
    """The same of rows whose ranks are looked up."""
    for batch in batches:
        for g, table in tables.items():
            x = batch.column(f"g{g}").to_numpy(zero_copy_only=False).astype(np.float64)
            here = ~np.isnan(x)
            yield g, *table.at(x[here]), batch, here


def _rank_sums(cells: Iterator[tuple], serves: list[list[int]], sizes: list[int], levels: int) -> Iterator[pa.RecordBatch]:
    """Per ranking, category and level the sum of ranks less the middle one, the number of ranks, and the ties' part of the correction."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for g, rank, ties, batch, at in cells:
        away, tied = rank - (sizes[g] + 1) / 2, ties.astype(np.float64) ** 2 - 1
        for i in serves[g]:
            level = batch.column(f"c{i}").to_numpy()[at]
            own = np.stack([np.bincount(level, w, levels) for w in (away, np.ones(len(away)), tied)])
            sums[g, i] = sums[g, i] + own if (g, i) in sums else own
    rows = [(g, i, v, *own[:, v].tolist()) for (g, i), own in sums.items() for v in np.flatnonzero(own[1]).tolist()]
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        columns[4] = columns[4].cast(pa.int64())
        yield pa.RecordBatch.from_arrays(columns, names=["ranking", "cat_index", "level", "rank_sum", "size", "ties"])


def mixed_relations(
    df: DataFrame,
    config: RelationConfig = RelationConfig(),
    cats: Sequence[str] | None = None,
    nums: Sequence[str] | None = None,
    gated: bool = False,
) -> DataFrame:
    """ANOVA and, with ``advanced_stats``, Kruskal-Wallis, by eta squared, cut at top_k."""
    return leading_pairs(mixed_pairs(df, config, materialize(level_stats(df, config, cats, nums, gated))), config)


def mixed_pairs(df: DataFrame, config: RelationConfig, levels: DataFrame) -> DataFrame:
    """ANOVA and, with ``advanced_stats``, Kruskal-Wallis of every pair in ``levels``."""
    out = anova(df, config, levels=levels)
    if config.advanced_stats:
        ranks = kruskal(df, config, levels=levels).select(*PAIR, "h_stat", "kruskal_p")
        out = out.join(F.broadcast(ranks), PAIR, "left")
    return out


def leading_pairs(pairs: DataFrame, config: RelationConfig) -> DataFrame:
    return pairs.orderBy(F.desc("eta2"), *PAIR).limit(config.top_k)


def mixed_summary(
    df: DataFrame,
    config: RelationConfig = RelationConfig(),
    cats: Sequence[str] | None = None,
    nums: Sequence[str] | None = None,
    tested: DataFrame | None = None,
) -> DataFrame:
    tested = tested if tested is not None else anova(df, config, cats, nums)
    return tested.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if("significant").alias("significant_pairs"),
        F.max("eta2").alias("max_eta2"),
        F.avg("eta2").alias("mean_eta2"),
        F.count_if(F.col("eta2") >= 0.14).alias("large_pairs"),
    )

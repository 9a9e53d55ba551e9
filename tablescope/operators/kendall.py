"""Kendall's tau-b of all column pairs, exact, without comparing all pairs of rows and in a number of jobs that does not grow with the pairs.

tau-b needs the tie counts, which are plain group-bys, and the number of discordant row pairs: those with x ascending and y
descending, which are inversions of y in the order of x. Two different y differ first at some bit of their rank, the higher
one with a 1, the lower one with a 0, all bits above being equal. So inversions are counted bit by bit: within rows of equal
higher bits, in order of x, each 0 counts the 1s before it. y is ranked by blocks of bounded size for this, whose number
has few bits; each bit is one range-ordered pass whose partitions only tell their counts. What is left are inversions within a block,
which one task counts in memory by the same rule. Values too heavy for a block have one of their own, which holds no inversion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.kinds import doubles, name_sql
from tablescope.operators.order import materialize

POINTS_PER_BLOCK = 2_000_000  # 24 bytes each within one task

_LEVEL = "part int, pair int, level int, prefix int, inside double, ones double, zeros double"


def kendall(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(col1, col2, r, n)`` with tau-b for every pair of numeric columns."""
    pairs = list(combinations(names, 2))
    cells = ", ".join(f"named_struct('pair', {p}, 'x', {name_sql(a)} + 0D, 'y', {name_sql(b)} + 0D)" for p, (a, b) in enumerate(pairs))
    complete = doubles(df, names).select(F.expr(f"inline(array({cells}))")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    # Written once: the counts below all read these points.
    points = materialize(complete.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("c")))
    placed, bits = _blocks(points)
    t = F.col("t").cast("double")

    def ties(*by: str) -> DataFrame:
        sizes = points.groupBy("pair", *by).agg(F.sum("c").alias("t")) if len(by) == 1 else points.withColumnRenamed("c", "t")
        return sizes.groupBy("pair").agg(F.sum(t * (t - 1) / 2).alias("t" + "".join(by)), F.sum("t").alias("n" + "".join(by)))

    discordant = _within_blocks(placed)
    if bits:
        discordant = discordant.unionByName(_across_blocks(placed, bits))
    d = discordant.groupBy("pair").agg(F.sum("d").alias("d"))
    found = ties("x").join(ties("y"), "pair").join(ties("x", "y"), "pair").join(d, "pair", "left")
    n = F.col("nx").cast("double")
    every = n * (n - 1) / 2
    untied = every - F.col("tx") - F.col("ty") + F.col("txy")
    spread = F.sqrt(every - F.col("tx")) * F.sqrt(every - F.col("ty"))
    r = (untied - 2 * F.coalesce("d", F.lit(0.0))) / F.nullif(spread, F.lit(0.0))
    named = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("pair"))
    first, second = (F.get(F.lit([p[k] for p in pairs]), F.col("pair")) for k in (0, 1))
    return named.join(found, "pair", "left").select(first.alias("col1"), second.alias("col2"), r.alias("r"), F.coalesce("nx", F.lit(0).cast("bigint")).alias("n"))


def _blocks(points: DataFrame) -> tuple[DataFrame, int]:
    """Points with ``block``, the rank of their y's block within its pair, and the number of bits of a block's rank.

    Ranks are 2i between the edges i - 1 and i, and 2i + 1 exactly at edge i.
    """
    largest = points.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
    blocks = 1
    while blocks * POINTS_PER_BLOCK < largest:
        blocks *= 2
    if blocks == 1:
        return points.withColumn("block", F.lit(0)), 0
    cuts = [i / blocks for i in range(1, blocks)]
    edges = points.groupBy("pair").agg(F.array_distinct(F.percentile_approx("y", cuts, 20 * blocks)).alias("edges"))
    placed = points.join(F.broadcast(edges), "pair")  # one row a pair
    block = _rank(F.col("y"), F.col("edges"), blocks)
    return placed.withColumn("block", block.cast("int")).drop("edges"), (2 * blocks - 1).bit_length()


def _rank(value: Column, edges: Column, most: int) -> Column:
    """Binary search in an ordered array of fewer than ``most`` (a power of two) values."""
    steps, width = [], most // 2
    while width:
        steps.append(width)
        width //= 2
    below = F.reduce(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= F.size(edges)) & (F.get(edges, at + step - 1) < value), at + step).otherwise(at))
    return 2 * below + F.coalesce((F.get(edges, below) == value).cast("int"), F.lit(0))


def _within_blocks(placed: DataFrame) -> DataFrame:
    """(pair, d): discordant pairs among the points of each block; blocks of odd rank hold one y."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        x, y, c = (table.column(k).to_numpy() for k in ("x", "y", "c"))
        return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([_count_discordant(x, y, c)])})

    return placed.filter(F.col("block") % 2 == 0).groupBy("pair", "block").applyInArrow(count, "pair int, d double")


def _count_discordant(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted count of pairs with x ascending and y descending, one bit of the y rank at a time."""
    order = np.lexsort((y, x))
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    w = weight[order].astype(np.float64)
    total = 0.0
    for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
        by_prefix = np.argsort(rank >> (bit + 1), kind="stable")  # equal higher bits, still in x order
        prefix = (rank >> (bit + 1))[by_prefix]
        high = ((rank >> bit) & 1)[by_prefix].astype(bool)
        total += _inversions(prefix, high, w[by_prefix])[0].sum()
    return float(total)


def _inversions(group: np.ndarray, high: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of equal groups: weight of (1 before 0) pairs, of ones, of zeros; and where the runs start."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0), np.zeros(0), np.zeros(0), starts
    one = np.where(high, w, 0.0)
    upto = np.cumsum(one)
    sizes = np.diff(np.append(starts, len(group)))
    before = upto - np.repeat(upto[starts] - one[starts], sizes)
    zero = w - one
    return np.add.reduceat(zero * before, starts), np.add.reduceat(one, starts), np.add.reduceat(zero, starts), starts


def _across_blocks(placed: DataFrame, bits: int) -> DataFrame:
    """(pair, d): discordant pairs of points in different blocks, a level for each bit of the blocks' ranks.

    At equal x a 0 comes before a 1, so that only strictly smaller x count. Every partition tells its counts for each run of equal
    higher bits it holds; runs that go on in later partitions are put together from those.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    cells = placed.select("pair", "x", "block", "c", levels)
    cells = cells.select(
        "pair", "level", F.expr("shiftright(block, level + 1)").alias("prefix"), "x", F.expr("shiftright(block, level) & 1").alias("bit"), F.col("c").cast("double").alias("w")
    )
    keys = ["pair", "level", "prefix", "x", "bit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, state = None, (0.0, 0.0, 0.0)
        out: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            pair, level, prefix, bit, w = (batch.column(k).to_numpy() for k in ("pair", "level", "prefix", "bit", "w"))
            group = (pair.astype(np.int64) * 64 + level) * (1 << 32) + prefix
            inside, ones, zeros, starts = _inversions(group, bit == 1, w)
            for k, at in enumerate(starts.tolist()):
                here = (int(pair[at]), int(level[at]), int(prefix[at]))
                own = (float(inside[k]), float(ones[k]), float(zeros[k]))
                if here == key:
                    state = (state[0] + own[0] + own[2] * state[1], state[1] + own[1], state[2] + own[2])
                else:
                    if key is not None:
                        out.append((part, *key, *state))
                    key, state = here, own
        if key is not None:
            out.append((part, *key, *state))
            kinds = [pa.int32()] * 4 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in _LEVEL.split(", ")])

    told = cells.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, _LEVEL)
    before = Window.partitionBy("pair", "level", "prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    joined = told.withColumn("earlier", F.coalesce(F.sum("ones").over(before), F.lit(0.0)))
    return joined.select("pair", (F.col("inside") + F.col("zeros") * F.col("earlier")).alias("d"))

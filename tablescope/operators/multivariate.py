"""Standardisation, principal components and k-means over complete numeric rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.kinds import doubles_of, numeric_columns, quoted
from tablescope.operators.select import sample_rows

STARTS = 2_000  # rows among which first centres are drawn


def complete_rows(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[quoted(k) for k in keep], *[doubles_of(df, c).alias(c) for c in names if c not in keep]).dropna(subset=list(names))


def _centre_and_scale(rows: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    stats = rows.agg(*[F.struct(F.avg(quoted(c)).alias("m"), F.stddev_pop(quoted(c)).alias("s")).alias(f"_{i}") for i, c in enumerate(names)])
    row = stats.first()
    return {c: (row[f"_{i}"]["m"], row[f"_{i}"]["s"]) for i, c in enumerate(names)}


def standardize(df: DataFrame, cols: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Z-scores (population standard deviation) of complete rows; constant columns become 0."""
    names = list(cols) if cols else numeric_columns(df)
    rows = complete_rows(df, names, keep)
    facts = _centre_and_scale(rows, names)
    return rows.select(*[quoted(k) for k in keep], *[_z(c, *facts[c]).alias(c) for c in names])


def _z(column: str, mean: float | None, scale: float | None) -> Column:
    return (quoted(column) - F.lit(mean)) / F.lit(scale or 1.0)


def _components(df: DataFrame, cols, k):
    """Loadings and variances from one aggregate: the correlation matrix has one entry per column pair."""
    names = list(cols) if cols else numeric_columns(df)
    rows = complete_rows(df, names)
    facts = _centre_and_scale(rows, names)
    names = [c for c in names if facts[c][1]]
    if len(names) < 2:
        raise ValueError("not enough numeric columns")
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    z = [_z(c, *facts[c]) for c in names]
    row = rows.agg(*[F.avg(z[i] * z[j]).alias(f"{i}_{j}") for i, j in upper]).first()
    matrix = np.zeros((len(names), len(names)))
    for i, j in upper:
        matrix[i, j] = matrix[j, i] = row[f"{i}_{j}"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    loadings = vectors[:, order]
    largest = np.argmax(np.abs(loadings), axis=0)
    loadings = loadings * np.sign(loadings[largest, range(loadings.shape[1])])
    return names, facts, loadings, values[order], float(values.sum())


def pca_components(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2) -> DataFrame:
    """``(component, explained, explained_ratio, column, loading)``; the largest loading is positive."""
    names, _, loadings, values, total = _components(df, cols, k)
    rows = [
        (p + 1, float(values[p]), float(values[p] / total), c, float(loadings[i, p])) for p in range(len(values)) for i, c in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, explained_ratio double, column string, loading double")


def pca(df: DataFrame, cols: Sequence[str] | None = None, k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Scores ``pc1`` … ``pck`` of every complete row."""
    names, facts, loadings, values, _ = _components(df, cols, k)
    scores = [
        reduce(Column.__add__, [_z(c, *facts[c]) * F.lit(float(loadings[i, p])) for i, c in enumerate(names)]).alias(f"pc{p + 1}")
        for p in range(len(values))
    ]
    all_names = list(cols) if cols else numeric_columns(df)
    return complete_rows(df, all_names, keep).select(*[quoted(x) for x in keep], *scores)


@dataclass(frozen=True)
class _Clusters:
    names: list[str]
    facts: dict[str, tuple[float, float]]
    centers: np.ndarray  # in standard units, ordered by their coordinates
    sizes: np.ndarray
    cost: float
    steps: int


def _fit_kmeans(df: DataFrame, cols, k: int, seed: int, n_init: int, max_steps: int = 300, tolerance: float = 1e-4) -> _Clusters:
    """The cheapest of ``n_init`` runs of Lloyd's algorithm, all of them advanced by the same scans.

    The first centres of each run are spread over a sample of ``STARTS`` rows by their squared distances. A scan then assigns every row in every run
    that still moves, by one product of the rows with all centres, and gives back counts and sums: one row a run and cluster.
    """
    names = list(cols) if cols else numeric_columns(df)
    rows = complete_rows(df, names)
    facts = _centre_and_scale(rows, names)
    standard = rows.select(*[_z(c, *facts[c]).alias(c) for c in names]).persist()
    try:
        sample = np.array([list(r) for r in sample_rows(standard, STARTS, seed).collect()], float).reshape(-1, len(names))
        if not len(sample):
            raise ValueError("no complete rows")
        centers = [_spread(sample, k, np.random.default_rng(seed + i)) for i in range(n_init)]
        moving, cost = set(range(n_init)), [np.inf] * n_init
        sizes = [np.zeros(len(c), np.int64) for c in centers]
        steps = 0
        while moving and steps <= max_steps:
            active = sorted(moving)
            told = standard.mapInArrow(
                lambda batches, now=[(i, centers[i]) for i in active]: _assigned(batches, names, now), "run int, cluster int, n long, cost double, sums array<double>"
            )
            totals = told.groupBy("run", "cluster").agg(
                F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(len(names))]).alias("sums")
            )
            found = totals.collect()
            steps += 1
            for i in active:
                own = [r for r in found if r["run"] == i]
                cost[i] = sum(r["cost"] for r in own)
                after, sizes[i] = centers[i].copy(), np.zeros(len(centers[i]), np.int64)
                for r in own:
                    after[r["cluster"]], sizes[i][r["cluster"]] = np.array(r["sums"]) / r["n"], r["n"]
                if np.sqrt(((after - centers[i]) ** 2).sum(axis=1)).max() <= tolerance:
                    moving.discard(i)
                else:
                    centers[i] = after
    finally:
        standard.unpersist()
    best = min(range(n_init), key=lambda i: (cost[i], i))
    order = sorted(range(len(centers[best])), key=lambda c: tuple(centers[best][c]))
    return _Clusters(names, facts, centers[best][order], sizes[best][order], cost[best], steps)


def _spread(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``k`` different rows, each drawn by its squared distance to those before it; of a few draws the one that lowers the distances most."""
    chosen = [sample[rng.integers(len(sample))]]
    near = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and near.sum() > 0:
        drawn = rng.choice(len(sample), size=4, p=near / near.sum())
        closer = [np.minimum(near, ((sample - sample[d]) ** 2).sum(axis=1)) for d in drawn]
        best = min(range(len(drawn)), key=lambda i: closer[i].sum())
        chosen.append(sample[drawn[best]])
        near = closer[best]
    return np.array(chosen)


def _assigned(batches: Iterator[pa.RecordBatch], names: Sequence[str], runs: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Per run and cluster of a task's rows: how many, their squared distances and their sums."""
    every = np.concatenate([c for _, c in runs])
    bounds = np.cumsum([0, *[len(c) for _, c in runs]])
    n, cost, sums = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(every.shape)
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            x = np.stack([batch.column(c).slice(first, 4096).to_numpy() for c in names], axis=1)
            distance = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ every.T + (every * every).sum(axis=1)[None, :], 0.0)
            for a, b in zip(bounds[:-1], bounds[1:]):
                at = distance[:, a:b].argmin(axis=1)
                n[a:b] += np.bincount(at, minlength=b - a)
                cost[a:b] += np.bincount(at, distance[np.arange(len(x)), a + at], b - a)
                for j in range(len(names)):
                    sums[a:b, j] += np.bincount(at, x[:, j], b - a)
    rows = [(i, c, int(n[a + c]), float(cost[a + c]), sums[a + c].tolist()) for (i, own), a in zip(runs, bounds) for c in range(len(own)) if n[a + c]]
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["run", "cluster", "n", "cost", "sums"])


def kmeans_centers(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3, seed: int = 42, n_init: int = 10) -> DataFrame:
    """``(cluster, size, column, center)`` in original units, clusters ordered by their first coordinate."""
    fit = _fit_kmeans(df, cols, k, seed, n_init)
    rows = [
        (i, int(size), c, float(center[j] * (fit.facts[c][1] or 1.0) + fit.facts[c][0]))
        for i, (center, size) in enumerate(zip(fit.centers, fit.sizes))
        for j, c in enumerate(fit.names)
    ]
    return df.sparkSession.createDataFrame(rows, "cluster int, size bigint, column string, center double")


def kmeans(
    df: DataFrame, cols: Sequence[str] | None = None, k: int = 3, seed: int = 42, n_init: int = 10, keep: Sequence[str] = ()
) -> DataFrame:
    """Every complete row with its ``cluster``."""
    fit = _fit_kmeans(df, cols, k, seed, n_init)
    rows = complete_rows(df, fit.names, keep)
    distances = F.array(*[reduce(Column.__add__, [(_z(c, *fit.facts[c]) - F.lit(float(center[j]))) ** 2 for j, c in enumerate(fit.names)]) for center in fit.centers])
    return rows.withColumn("cluster", (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))

"""Exact linear-interpolated quantiles without collecting or sorting a column.

One scan brackets every wanted order statistic with the built-in mergeable sketch, a second one counts
the rows below, at and inside each bracket, and only the few rows strictly inside a bracket are grouped
and ranked. Brackets that still hold too many rows are narrowed again, so each pass cuts the candidates by
the sketch accuracy whatever the size of the table; heavy values settle on a bracket edge by counting.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.kinds import double_sql, doubles, doubles_of, name_sql, quoted, text_sql

ACCURACY = 1_000
INSIDE_LIMIT = 1_000_000  # rows inside one bracket that may be ranked in one task


@dataclass(frozen=True)
class _Target:
    """The ``rank``-th smallest value (from 0) of ``column`` within ``group``, known to lie in [lo, hi]."""

    group: object
    column: str
    rank: int
    lo: float
    hi: float


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: str | None = None
) -> dict[tuple[object, str, float], float]:
    """``{(group, column, p): value}``; ``group`` is None without ``by``.

    ``by`` must have few levels (callers bound them); columns without values are absent.
    """
    columns = list(columns)
    if not columns:
        return {}
    values = doubles(df, columns)
    if by is not None:
        values = df.select(quoted(by).alias("_by"), *[doubles_of(df, c).alias(c) for c in columns])
        values = values.filter(F.col("_by").isNotNull())
    marks = sorted({m for p in probs for m in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))})
    summary = [
        F.struct(
            F.count(quoted(c)).alias("n"),
            F.min(quoted(c)).alias("min"),
            F.max(quoted(c)).alias("max"),
            F.percentile_approx(quoted(c), marks, ACCURACY).alias("marks"),
        ).alias(f"_s{i}")
        for i, c in enumerate(columns)
    ]
    rows = (values.groupBy("_by").agg(*summary) if by is not None else values.agg(*summary)).collect()

    sizes: dict[tuple[object, str], int] = {}
    targets: set[_Target] = set()
    for row in rows:
        group = row["_by"] if by is not None else None
        for i, c in enumerate(columns):
            s = row[f"_s{i}"]
            if not s["n"]:
                continue
            sizes[group, c] = s["n"]
            at = dict(zip(marks, s["marks"]))
            for p in probs:
                lo, hi = at[max(0.0, p - 2 / ACCURACY)], at[min(1.0, p + 2 / ACCURACY)]
                for rank in _neighbours(s["n"], p):
                    targets.add(_Target(group, c, rank, s["min"] if rank == 0 else lo, s["max"] if rank == s["n"] - 1 else hi))

    found: dict[tuple[object, str, int], float] = {}
    pending = list(targets)
    for _ in range(60):
        if not pending:
            break
        pending = _advance(values, by is not None, pending, found)
    if pending:
        raise RuntimeError("quantile brackets did not converge")

    out: dict[tuple[object, str, float], float] = {}
    for (group, c), n in sizes.items():
        for p in probs:
            low, high = _neighbours(n, p)
            a, b = found[group, c, low], found[group, c, high]
            out[group, c, p] = a + (b - a) * ((n - 1) * p - low)
    return out


def _neighbours(n: int, p: float) -> tuple[int, int]:
    low = min(n - 1, max(0, math.floor((n - 1) * p)))
    return low, min(n - 1, low + 1)


def _advance(values, grouped, pending, found):
    """Count between and at all bracket edges, settle what can be settled, return the narrowed rest."""
    edges: dict[tuple[object, str], list[float]] = {}
    for t in pending:
        edges.setdefault((t.group, t.column), []).extend((t.lo, t.hi))
    edges = {k: sorted(set(v)) for k, v in edges.items()}
    counts = _count_regions(values, grouped, edges)

    ranked: list[tuple[_Target, int]] = []  # target narrowed to one open interval, rank inside it
    crowded: list[tuple[_Target, int, int]] = []
    for t in pending:
        es = edges[t.group, t.column]
        seen = 0
        for code in range(2 * len(es) + 1):
            here = counts.get((t.group, t.column, code), 0)
            if t.rank < seen + here:
                break
            seen += here
        if code % 2:
            found[t.group, t.column, t.rank] = es[code // 2]
            continue
        i = code // 2
        narrowed = replace(t, lo=es[i - 1] if i else -math.inf, hi=es[i] if i < len(es) else math.inf)
        if here <= INSIDE_LIMIT:
            ranked.append((narrowed, t.rank - seen))
        else:
            crowded.append((narrowed, t.rank - seen, here))
    if ranked:
        _rank_inside(values, grouped, ranked, found)
    if not crowded:
        return []
    marks = [
        F.percentile_approx(
            F.expr(f"CASE WHEN {_inside(t, grouped)} THEN {name_sql(t.column)} END"),
            [max(0.0, (r + 0.5) / m - 2 / ACCURACY), min(1.0, (r + 0.5) / m + 2 / ACCURACY)],
            ACCURACY,
        ).alias(f"m{j}")
        for j, (t, r, m) in enumerate(crowded)
    ]
    row = values.agg(*marks).first()
    return [replace(t, lo=row[f"m{j}"][0], hi=row[f"m{j}"][1]) for j, (t, _, _) in enumerate(crowded)]


def _count_regions(values, grouped, edges):
    """``{(group, column, code): rows}`` with code 2i below edge i (and above i - 1), 2i + 1 at edge i.

    Only those codes are shuffled.
    """
    cells = []
    for c in dict.fromkeys(c for _, c in edges):
        v = name_sql(c)
        codes = {
            group: " + ".join(f"int({v} >= {double_sql(e)}) + int({v} > {double_sql(e)})" for e in es)
            for (group, column), es in edges.items()
            if column == c
        }
        if grouped:
            branches = " ".join(f"WHEN _by = {_group_sql(g)} THEN {code}" for g, code in codes.items())
            cells.append(f"named_struct('column', {text_sql(c)}, 'code', CASE {branches} END)")
        else:
            cells.append(f"named_struct('column', {text_sql(c)}, 'code', {codes[None]})")
    by = [F.col("_by")] if grouped else []
    rows = (
        values.select(*by, F.expr(f"inline(array({', '.join(cells)}))"))
        .filter(F.col("code").isNotNull())
        .groupBy(*by, "column", "code")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return {(r["_by"] if grouped else None, r["column"], r["code"]): r["n"] for r in rows}


def _group_sql(group) -> str:
    return text_sql(group) if isinstance(group, str) else str(group)


def _inside(t: _Target, grouped: bool) -> str:
    c = name_sql(t.column)
    member = f"_by = {_group_sql(t.group)} AND " if grouped else ""
    return f"({member}{c} > {double_sql(t.lo)} AND {c} < {double_sql(t.hi)})"


def _rank_inside(values, grouped, ranked, found):
    """Settle targets whose open interval holds few enough rows to be ranked together.

    The intervals of a column do not overlap, so each cell falls into at most one.
    """
    slots: dict[tuple, int] = {}
    branches: dict[str, list[str]] = {}
    wanted: dict[int, list[int]] = {}
    for t, r in ranked:
        interval = (t.group, t.column, t.lo, t.hi)
        if interval not in slots:
            slots[interval] = len(slots)
            branches.setdefault(t.column, []).append(f"WHEN {_inside(t, grouped)} THEN {slots[interval]}")
        wanted.setdefault(slots[interval], []).append(r)
    slot_of_cell = {c: f"CASE {' '.join(some)} END" for c, some in branches.items()}
    cells = ", ".join(f"named_struct('slot', {slot}, 'value', {name_sql(c)})" for c, slot in slot_of_cell.items())
    counted = (
        values.filter(f"coalesce({', '.join(slot_of_cell.values())}) IS NOT NULL")
        .select(F.expr(f"inline(array({cells}))"))
        .filter(F.col("slot").isNotNull())
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit = " OR ".join(f"(slot = {i} AND until > {r} AND until - n <= {r})" for i, ranks in wanted.items() for r in set(ranks))
    upto = Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    chosen = counted.withColumn("until", F.sum("n").over(upto)).filter(hit).collect()
    for t, r in ranked:
        for row in chosen:
            if row["slot"] == slots[t.group, t.column, t.lo, t.hi] and row["until"] - row["n"] <= r < row["until"]:
                found[t.group, t.column, t.rank] = row["value"]

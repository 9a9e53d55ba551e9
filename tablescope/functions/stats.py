"""Column expressions for statistics whose conventions differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def corrected_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from the population skewness of ``n`` values."""
    return g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from the population excess kurtosis of ``n`` values."""
    return (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both sides are present; NULL when a side is constant."""
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def pearson_sql(x: str, y: str) -> str:
    """SQL text for Pearson r of two expressions already centred near their means.

    Plain sums: shared sums of several pairs are computed once. NULL when a side is constant.
    """
    n = f"nullif(count({x} * {y}), 0)"

    def moment(a: str, b: str) -> str:
        return f"(sum({a} * {b}) - sum({a}) * sum({b}) / {n})"

    varies = f"min({x}) < max({x}) AND min({y}) < max({y})"
    return f"CASE WHEN {varies} THEN {moment(x, y)} / nullif(sqrt({moment(x, x)}) * sqrt({moment(y, y)}), 0D) END"

"""Analysis of all column relations of one table, and the charts they suggest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.kinds import numeric_columns, string_columns
from tablescope.operators import anova, assoc, corr
from tablescope.operators.freq import excluded_categories, gated_categories
from tablescope.operators.order import materialize
from tablescope.operators.select import sample_rows, select_columns
from tablescope.plans.config import RelationConfig


def _message(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(text,)], "error string")


SECTIONS = (
    "metadata", "excluded_columns", "numerical", "numerical_summary", "correlation_matrix",
    "categorical", "categorical_summary", "rules", "theils_u", "mixed", "mixed_summary", "level_stats",
)


def analyze_relations(
    df: DataFrame, config: RelationConfig = RelationConfig(), tokens: Sequence[str] | None = None, sections: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """``{section: table}`` for numeric, categorical and mixed column pairs.

    Pair tables are worked out once, written (one row per pair or level) and shared between sections; summaries
    cover all pairs, the ranked sections the leading ``top_k``. A section without enough columns holds one ``error`` row.
    ``tokens`` keeps the columns whose name contains one of them; ``sections`` limits the work to some
    sections; ``sample_cap`` limits the rows, and is off by default.
    """
    wanted = set(sections or SECTIONS)
    if tokens:
        df = select_columns(df, tokens=tokens)
    if config.sample_cap:
        df = sample_rows(df, config.sample_cap, 42)
    out: dict[str, DataFrame] = {}
    numbers = numeric_columns(df)
    levels = gated_categories(df, string_columns(df), config.max_cardinality)
    texts, split = list(levels), [c for c, n in levels.items() if n >= 2]

    out["metadata"] = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(numbers)).cast("bigint").alias("numeric_columns"),
        F.lit(len(string_columns(df))).cast("bigint").alias("text_columns"),
        F.lit(len(texts)).cast("bigint").alias("usable_categories"),
    )
    out["excluded_columns"] = excluded_categories(df, string_columns(df), texts)
    if len(numbers) < 2:
        out["numerical"] = _message(df, "fewer than two numeric columns")
    elif wanted & {"numerical", "numerical_summary", "correlation_matrix"}:
        pairs = materialize(corr.correlation_pairs(df, config, numbers))
        out["numerical"] = corr.strong_correlations(df, config, pairs=pairs)
        out["numerical_summary"] = corr.correlation_summary(df, config, numbers, pairs.withColumnRenamed("pearson", "r"))
        out["correlation_matrix"] = pairs
    if len(texts) < 2:
        out["categorical"] = _message(df, "fewer than two usable categorical columns")
    elif wanted & {"categorical", "categorical_summary", "rules", "theils_u"}:
        table = materialize(assoc.contingency(df, config, texts, gated=True))
        tested = materialize(assoc.chi_square(df, config, table=table))
        out["categorical"] = assoc.strong_associations(df, config, tested=tested)
        out["categorical_summary"] = assoc.association_summary(df, config, tested=tested)
        out["rules"] = assoc.association_rules(df, config, table=table)
        if config.advanced_stats:
            out["theils_u"] = assoc.theils_u(df, config, table=table)
    if not numbers or not split:
        out["mixed"] = _message(df, "needs a numeric and a usable categorical column")
    elif wanted & {"mixed", "mixed_summary", "level_stats"}:
        stats = materialize(anova.level_stats(df, config, split, numbers, gated=True))
        out["level_stats"] = stats
        if "mixed" in wanted:
            pairs = materialize(anova.mixed_pairs(df, config, stats))
            out["mixed"] = anova.leading_pairs(pairs, config)
        else:
            pairs = anova.anova(df, config, levels=stats)
        out["mixed_summary"] = anova.mixed_summary(df, config, tested=pairs)
    return {name: frame for name, frame in out.items() if name in wanted}


def recommend_charts(df: DataFrame, config: RelationConfig = RelationConfig(), per_kind: int = 3) -> DataFrame:
    """``(type, col1, col2, reason, score)`` from the strongest relations and the column types."""
    spark = df.sparkSession
    numbers, texts = numeric_columns(df), string_columns(df)
    rules: list[tuple] = []
    if numbers:
        rules.append(("histogram_box", numbers[0], None, "first numeric column", None))
    if texts:
        rules.append(("bar_top10", texts[0], None, "first text column", None))
    if len(numbers) >= 2:
        rules.append(("scatter_fit", numbers[0], numbers[1], "first two numeric columns", None))
    if len(texts) >= 2:
        rules.append(("crosstab_heatmap", texts[0], texts[1], "first two text columns", None))
    out = spark.createDataFrame(rules, "type string, col1 string, col2 string, reason string, score double")

    def suggestion(table: DataFrame, kind: str, a: str, b: str, score: str, reason: str) -> DataFrame:
        best = table.filter(F.col(score).isNotNull()).orderBy(F.desc(score), a, b).limit(per_kind)
        return best.select(
            F.lit(kind).alias("type"), F.col(a).alias("col1"), F.col(b).alias("col2"), F.lit(reason).alias("reason"), F.col(score).alias("score")
        )

    levels = gated_categories(df, texts, config.max_cardinality)
    usable, split = list(levels), [c for c, n in levels.items() if n >= 2]
    if len(usable) >= 2:
        table = assoc.contingency(df, config, usable, gated=True)
        out = out.unionByName(suggestion(assoc.chi_square(df, config, table=table), "heatmap", "col1", "col2", "cramers_v", "cramers_v"))
    if len(numbers) >= 2:
        pairs = corr.corr_matrix(df, "pearson", numbers).withColumn("strength", F.abs("r"))
        out = out.unionByName(suggestion(pairs, "scatter", "col1", "col2", "strength", "correlation"))
    if split and numbers:
        stats = anova.level_stats(df, config, split, numbers, gated=True)
        out = out.unionByName(suggestion(anova.anova(df, config, levels=stats), "box", "cat", "num", "eta2", "eta_squared"))
    return out

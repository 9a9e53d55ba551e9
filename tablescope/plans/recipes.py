"""Named analyses: a token names an analysis, a template names a list of tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablescope.kinds import numeric_columns, string_columns
from tablescope.operators import chartdata, corr, multivariate, profile, quality, reshape, select, series, text
from tablescope.operators.freq import SharedAggregates
from tablescope.operators.order import materialize
from tablescope.plans import relations
from tablescope.sources import io


@dataclass(frozen=True)
class Recipe:
    description: str
    run: Callable[..., DataFrame | dict[str, DataFrame]]


@dataclass(frozen=True)
class RecipeResult:
    token: str
    description: str
    result: DataFrame | dict[str, DataFrame] | None
    error: str | None = None


def _first_text(df: DataFrame) -> str:
    names = string_columns(df)
    if not names:
        raise ValueError("no text columns found")
    return names[0]


def _write(df: DataFrame, fmt: str, path: str | None) -> DataFrame:
    if path is None:
        raise ValueError("this recipe writes a table and needs path=")
    io.write_table(df, path, fmt)
    return df.sparkSession.createDataFrame([(path, fmt)], "path string, format string")


def _save(df: DataFrame, path: str | None, **settings) -> DataFrame:
    if path is None:
        raise ValueError("this recipe writes tables and needs path=")
    written = io.write_report(relations.analyze_relations(df), path)
    return df.sparkSession.createDataFrame(sorted(written.items()), "section string, path string")


def full_profile(df: DataFrame, sections: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Everything about the columns of a table in one bundle; ``sections`` limits the work to some sections."""
    parts = {
        "overview": lambda: profile.shape(df),
        "columns": lambda: profile.column_profile(df),
        "types": lambda: profile.quick_eda(df),
        "missing": lambda: quality.missing_pct(df),
        "duplicates": lambda: quality.duplicate_rows_count(df),
        "outliers": lambda: quality.iqr_outliers(df),
    }
    if len(numeric_columns(df)) >= 2:
        parts["pearson"] = lambda: corr.corr_matrix(df, "pearson")
        parts["spearman"] = lambda: corr.corr_matrix(df, "spearman")
    if string_columns(df):
        parts["top_values"] = lambda: select.top_values_all(df)
    return {name: part() for name, part in parts.items() if sections is None or name in sections}


# Keyword arguments a recipe may take: order_by (row order), path (where to write), keys (key columns).
RECIPES: dict[str, Recipe] = {
    "C1": Recipe("summary statistics", lambda df, **kw: profile.describe(df)),
    "C2": Recipe("table information", lambda df, **kw: profile.table_info(df)),
    "C3": Recipe("missing counts", lambda df, **kw: quality.missing_count(df)),
    "C4": Recipe("column types", lambda df, **kw: profile.dtypes(df)),
    "C5": Recipe("distinct counts", lambda df, **kw: profile.nunique(df)),
    "C6": Recipe("first rows", lambda df, order_by=None, **kw: select.head(df, 5, order_by)),
    "C7": Recipe("last rows", lambda df, order_by=None, **kw: select.tail(df, 5, order_by)),
    "C8": Recipe("correlation matrix", lambda df, **kw: corr.corr_matrix(df)),
    "C9": Recipe("column names", lambda df, **kw: profile.column_names(df)),
    "C10": Recipe("bytes per column", lambda df, **kw: io.storage_footprint(df)),
    "C11": Recipe("missing percentages", lambda df, **kw: quality.missing_pct(df)),
    "C12": Recipe("correlation heat map", lambda df, **kw: reshape.stacked_correlations(df)),
    "C13": Recipe("values of the first column", lambda df, **kw: select.top_values(df, k=kw.get("k"))),
    "C14": Recipe("summary of all columns", lambda df, **kw: profile.describe_all(df)),
    "C15": Recipe("table shape", lambda df, **kw: profile.shape(df)),
    "C16": Recipe("duplicate row count", lambda df, **kw: quality.duplicate_rows_count(df)),
    "C17": Recipe("random rows", lambda df, **kw: select.sample_rows(df, 10)),
    "C18": Recipe("example values", lambda df, **kw: select.value_set(df, 10)),
    "C19": Recipe("transposed first rows", lambda df, order_by=None, **kw: reshape.transpose(df, 5, order_by)),
    "C20": Recipe("row index", lambda df, **kw: profile.row_index_info(df)),
    "C21": Recipe("rows with missing values", lambda df, **kw: quality.rows_with_missing(df)),
    "C22": Recipe("modes", lambda df, **kw: profile.mode(df)),
    "C23": Recipe("histograms", lambda df, **kw: chartdata.histogram(df, bins=10)),
    "C24": Recipe("summary of text columns", lambda df, **kw: profile.describe_categorical(df)),
    "C25": Recipe("leading correlated pairs", lambda df, **kw: corr.top_correlated_pairs(df)),
    "C26": Recipe("group means", lambda df, by=None, **kw: profile.group_means(df, by)),
    "C27": Recipe("write CSV in place of a spreadsheet", lambda df, path=None, **kw: _write(df, "csv", path)),
    "C28": Recipe("write JSON", lambda df, path=None, **kw: _write(df, "json", path)),
    "C29": Recipe("standard deviations", lambda df, **kw: profile.std(df)),
    "C30": Recipe("minima and maxima", lambda df, **kw: profile.min_max(df)),
    "C31": Recipe("zero counts", lambda df, **kw: quality.zero_counts(df)),
    "C32": Recipe("duplicate rows", lambda df, **kw: quality.duplicate_rows(df)),
    "C33": Recipe("valid counts", lambda df, **kw: quality.valid_count(df)),
    "C34": Recipe("key uniqueness", lambda df, keys=None, **kw: profile.key_uniqueness(df, keys or [df.columns[0]])),
    "C35": Recipe("pair grid", lambda df, **kw: chartdata.pair_grid(df)),
    "C36": Recipe("ascending sort", lambda df, **kw: select.sort_asc(df)),
    "C37": Recipe("descending sort", lambda df, **kw: select.sort_desc(df)),
    "C38": Recipe("total bytes", lambda df, **kw: io.footprint_summary(df)),
    "C39": Recipe("quality summary", lambda df, **kw: profile.quality_summary(df)),
    "C40": Recipe("negative counts", lambda df, **kw: quality.negative_counts(df)),
    "C41": Recipe("skewness", lambda df, **kw: profile.skewness(df)),
    "C42": Recipe("kurtosis", lambda df, **kw: profile.kurtosis(df)),
    "C43": Recipe("quartiles", lambda df, **kw: profile.quantiles(df)),
    "C44": Recipe("numeric modes", lambda df, **kw: profile.numeric_mode(df)),
    "C45": Recipe("distinct percentages", lambda df, **kw: profile.unique_ratio(df)),
    "C46": Recipe("duplicates per column", lambda df, **kw: quality.column_duplicates(df)),
    "C47": Recipe("box statistics", lambda df, **kw: chartdata.box_stats(df)),
    "C48": Recipe("columns with missing values", lambda df, **kw: quality.columns_with_missing(df)),
    "C49": Recipe("crosstab of the first two columns", lambda df, **kw: reshape.crosstab(df)),
    "C50": Recipe("all column relations", lambda df, **kw: relations.analyze_relations(df)),
    "C51": Recipe("time trend", lambda df, bucket=None, **kw: series.time_trend(df, bucket=bucket)),
    "C52": Recipe("outliers", lambda df, **kw: quality.iqr_outliers(df)),
    "C53": Recipe("principal components", lambda df, **kw: multivariate.pca_components(df)),
    "C54": Recipe("word counts", lambda df, **kw: text.word_frequencies(df)),
    "C55": Recipe("k-means clusters", lambda df, **kw: multivariate.kmeans_centers(df)),
    "C56": Recipe("Spearman correlation", lambda df, **kw: corr.corr_matrix(df, "spearman")),
    "C57": Recipe("Kendall correlation", lambda df, **kw: corr.corr_matrix(df, "kendall")),
    "C58": Recipe("variances", lambda df, **kw: profile.variance(df)),
    "C59": Recipe("standard errors", lambda df, **kw: profile.sem(df)),
    "C60": Recipe("chart suggestions", lambda df, **kw: relations.recommend_charts(df)),
    "C61": Recipe("pie chart", lambda df, **kw: chartdata.pie_counts(df, _first_text(df))),
    "SAVE": Recipe("write the relation report", lambda df, path=None, **kw: _save(df, path)),
    "EXPORT": Recipe("write CSV", lambda df, path=None, **kw: _write(df, "csv", path)),
    "PROFILE": Recipe("full profile", lambda df, **kw: full_profile(df)),
}

# Templates by name.
TEMPLATES: dict[str, list[str]] = {
    "basic": ["C2", "C15", "C6", "C3", "C1"],
    "statistical": ["C1", "C14", "C29", "C41", "C42", "C43"],
    "visualization": ["C12", "C23", "C35", "C47"],
    "missing_data": ["C3", "C11", "C21", "C48"],
    "correlation": ["C8", "C12", "C25", "C50"],
    "comprehensive": ["C2", "C15", "C3", "C1", "C8", "C12", "C23", "C50"],
    "advanced_ml": ["C51", "C52", "C53", "C55"],
    "text_mining": ["C54"],
}

def template(name: str = "basic") -> list[str]:
    """The tokens of a template; an unknown name gives the basic one."""
    return list(TEMPLATES.get(name, TEMPLATES["basic"]))


# Recipes that are per-column aggregates and nothing else.
AGGREGATES = frozenset(["C2", "C3", "C11", "C29", "C30", "C31", "C33", "C39", "C40", "C58", "C59"])


def run_recipe(df: DataFrame, tokens: Sequence[str] | str, eager: bool = False, **settings) -> list[RecipeResult]:
    """Run named analyses in order. One that fails, or is unknown, is reported and does not stop the rest.

    ``tokens`` may be a template name. Per-column aggregates of all recipes are worked out in one scan. Other results are lazy
    tables over the same input; persist ``df`` first when it is expensive to read. With ``eager`` each result is
    written once, so that a recipe that only fails while it runs is reported as well.
    """
    names = template(tokens) if isinstance(tokens, str) else list(tokens)
    with SharedAggregates(df) as shared:
        together = [t for t in names if t in AGGREGATES]
        if len(together) > 1:
            for token in together:
                _attempt(df, token, False, settings)
            try:
                shared.compute()
            except Exception:
                shared.results.clear()  # each recipe then tells its own failure
        return [_attempt(df, token, eager, settings) for token in names]


def _attempt(df: DataFrame, token: str, eager: bool, settings: dict) -> RecipeResult:
    recipe = RECIPES.get(token)
    if recipe is None:
        return RecipeResult(token, f"unknown token {token}", None, "unknown token")
    try:
        result = recipe.run(df, **settings)
        if eager:
            result = {k: materialize(v) for k, v in result.items()} if isinstance(result, dict) else materialize(result)
        return RecipeResult(token, recipe.description, result)
    except Exception as failure:
        return RecipeResult(token, recipe.description, None, f"{type(failure).__name__}: {failure}")

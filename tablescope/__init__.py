"""Exploratory analysis of large tables on Spark: every operator takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get the functions of this package with the task, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tablescope.operators.anova import anova, kruskal, level_stats, mixed_relations, mixed_summary
from tablescope.operators.assoc import association_rules, association_summary, chi_square, contingency, cramers_v, theils_u
from tablescope.operators.corr import corr_matrix, corr_subset, correlation_summary, strong_correlations, top_correlated_pairs
from tablescope.operators.order import with_row_index
from tablescope.operators.profile import column_profile, describe, describe_all, quick_eda
from tablescope.operators.quantiles import exact_quantiles
from tablescope.operators.select import apply_filter, page, preview, slice_rows
from tablescope.plans.config import RelationConfig
from tablescope.plans.recipes import RECIPES, full_profile, run_recipe, template
from tablescope.plans.relations import analyze_relations, recommend_charts
from tablescope.sources.io import narrow_schema, read_table, storage_footprint, write_table

__all__ = [
    "RECIPES",
    "RelationConfig",
    "analyze_relations",
    "anova",
    "apply_filter",
    "association_rules",
    "association_summary",
    "chi_square",
    "column_profile",
    "contingency",
    "corr_matrix",
    "corr_subset",
    "correlation_summary",
    "cramers_v",
    "describe",
    "describe_all",
    "exact_quantiles",
    "full_profile",
    "kruskal",
    "level_stats",
    "mixed_relations",
    "mixed_summary",
    "narrow_schema",
    "page",
    "preview",
    "quick_eda",
    "read_table",
    "recommend_charts",
    "run_recipe",
    "slice_rows",
    "storage_footprint",
    "strong_correlations",
    "template",
    "theils_u",
    "top_correlated_pairs",
    "with_row_index",
    "write_table",
]

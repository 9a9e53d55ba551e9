import math

import numpy as np
import pandas as pd
import pytest
from tests.conftest import by

from tablescope.operators import profile, quality, quantiles
from tablescope.plans import recipes


def test_profile_of_mixed_table(mix12):
    got = by(profile.column_profile(mix12), "column")
    x = got["x"]
    assert x["mean"] == pytest.approx(13.833333, abs=1e-6)
    assert x["std"] == pytest.approx(27.319102, abs=1e-6)
    assert (x["q25"], x["q50"], x["q75"], x["iqr"]) == (3.75, 6.5, 9.25, 5.5)
    assert x["skew"] == pytest.approx(3.380882, abs=1e-6)
    assert x["kurtosis"] == pytest.approx(11.585233, abs=1e-6)
    assert got["y"]["nulls"] == 1 and got["y"]["missing_pct"] == pytest.approx(100 / 12)
    assert got["k"]["skew"] == 0 and got["k"]["std"] == 0
    assert got["g"]["unique"] == 3 and got["g"]["mean"] is None


def test_shape_corrections_match_pandas(spark):
    pdf = pd.DataFrame({"v": np.random.default_rng(3).gamma(2, 3, 500) + 1e6})
    got = by(profile.column_profile(spark.createDataFrame(pdf)), "column")["v"]
    assert got["skew"] == pytest.approx(pdf.v.skew(), rel=1e-6)
    assert got["kurtosis"] == pytest.approx(pdf.v.kurt(), rel=1e-6)
    assert got["std"] == pytest.approx(pdf.v.std(), rel=1e-9)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    got = by(profile.column_profile(df), "column")["v"]
    assert (got["count"], got["nulls"], got["unique"], got["max"]) == (2, 2, 2, 3.0)
    assert by(quality.missing_count(df), "column")["v"]["missing"] == 2


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "v double, s string")
    got = by(profile.column_profile(empty), "column")
    assert got["v"]["n_rows"] == 0 and got["v"]["mean"] is None and got["v"]["missing_pct"] is None
    nulls = spark.createDataFrame([(None, "a")], "v double, s string")
    got = by(profile.column_profile(nulls), "column")
    assert got["v"]["count"] == 0 and got["v"]["q50"] is None and got["s"]["unique"] == 1
    assert quality.iqr_outliers(empty).count() == 0
    assert quality.duplicate_rows_count(empty).first()[0] == 0


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (10, "a")], "x int, c string")
    got = by(profile.mode(df), "column")
    assert got["c"]["mode"] == "a" and got["x"]["mode"] == "1"
    assert sorted(r["value"] for r in profile.all_modes(df, ["c"]).collect()) == ["a", "b"]


def test_small_sample_shape(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "x double")
    got = by(profile.column_profile(df), "column")["x"]
    assert got["skew"] == pytest.approx(1.697056, abs=1e-6) and got["kurtosis"] == pytest.approx(3.152, abs=1e-6)


def _exact(values, p):
    return float(np.quantile(np.array(values), p))


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_exact_quantiles_of_skewed_data(spark, monkeypatch, limit):
    """A third of the rows share one value; narrow limits force repeated bracketing."""
    monkeypatch.setattr(quantiles, "INSIDE_LIMIT", limit)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 3, 4000), np.full(2000, 1.0), [-1e9, 1e12]])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "w": np.arange(len(values)) % 7 * 1.0}))
    probs = (0.0, 0.001, 0.25, 0.333, 0.5, 0.75, 0.9999, 1.0)
    got = quantiles.exact_quantiles(df, ["v", "w"], probs)
    for p in probs:
        assert got[None, "v", p] == pytest.approx(_exact(values, p), rel=1e-12)
        assert got[None, "w", p] == pytest.approx(_exact(np.arange(len(values)) % 7, p))


def test_exact_quantiles_by_group(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000, p=[0.7, 0.29, 0.01]), "v": rng.normal(size=3000)})
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), ["v"], (0.25, 0.5), by="g")
    for (g, _, p), value in got.items():
        assert value == pytest.approx(pdf[pdf.g == g].v.quantile(p), rel=1e-12)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, "y"), (None, None), (None, None)], "a int, b string")
    assert quality.duplicate_rows_count(df).first()[0] == 3
    assert quality.duplicate_rows_all_count(df).first()[0] == 5
    assert sorted(map(tuple, quality.duplicate_rows(df).collect()), key=str) == [(1, "x"), (1, "x"), (None, None)]


def test_many_copies_are_written_in_steps(spark, monkeypatch):
    monkeypatch.setattr(quality, "COPIES_PER_STEP", 10)
    df = spark.range(95).selectExpr("1 as a")
    assert quality.duplicate_rows(df).count() == 94


def test_group_stats(mix12):
    got = by(profile.group_stats(mix12, "g", "x"), "level")
    assert (got["a"]["mean"], got["a"]["std"], got["a"]["n"]) == (26.5, 49.007, 4)
    assert got["c"]["std"] == 1.291 and set(got) == {"a", "b", "c"}


def test_outliers(mix12):
    got = by(quality.iqr_outliers(mix12), "column")
    assert got["x"]["outliers"] == 1 and set(got) == {"x"}
    assert [r["x"] for r in quality.iqr_outlier_rows(mix12, "x").collect()] == [100.0]


def test_nested_columns_count_by_content(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], True), (2, None, None)], "id int, v array<float>, b boolean")
    got = by(profile.column_profile(df), "column")
    assert set(got) == {"id", "v", "b"}
    assert (got["v"]["unique"], got["v"]["nulls"], got["v"]["mean"]) == (1, 1, None)
    rows = [(1, [1, 2], {"a": 1, "b": 2}), (1, [3, 4], {"a": 1, "b": 2}), (1, [1, 2], {"b": 2, "a": 1}), (1, [1, 2], {"a": 1, "b": 2})]
    same = spark.createDataFrame(rows, "id int, v array<int>, m map<string,int>")
    assert quality.duplicate_rows_count(same).first()["duplicates"] == 2
    assert {(r["column"], r["n_unique"]) for r in profile.nunique(same).collect()} == {("id", 1), ("v", 2), ("m", 1)}
    assert by(quality.missing_count(df), "column")["v"]["missing"] == 1
    assert math.isclose(by(profile.describe(df), "column")["id"]["mean"], 1.5)


def test_tails_keep_their_digits():
    from tablescope.functions.special import f_tail, log_beta

    for d2 in (1e2, 1e4, 1e6):
        assert math.isclose(f_tail(1.5, 2, d2), (1 + 3 / d2) ** (-d2 / 2), rel_tol=1e-9)
    for d2 in (1e9, 1e12):  # the limit for two degrees of freedom
        assert math.isclose(f_tail(1.5, 2, d2), math.exp(-1.5), rel_tol=1e-8)
    assert math.isclose(log_beta(2000, 3000), math.lgamma(2000) + math.lgamma(3000) - math.lgamma(5000), rel_tol=1e-12)
    assert math.isclose(log_beta(3, 5000), math.log(2 / (5000.0 * 5001 * 5002)), rel_tol=1e-12)


def test_functions_travel_with_the_task(tmp_path):
    """A session started elsewhere, whose workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
import tablescope
from tablescope.functions.special import chi2_sf
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("P", round(spark.range(1).select(chi2_sf(F.lit(2.0), F.lit(2.0)).alias("p")).first().p, 6))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f"P {round(math.exp(-1), 6)}" in done.stdout, done.stderr[-2000:]


def test_full_profile_works_out_the_asked_sections_only(spark, mix12, monkeypatch):
    """A section is the same by itself as in the bundle, and does not pay for the others."""
    names = ["overview", "missing", "duplicates"]
    whole = recipes.full_profile(mix12)
    assert list(whole) == ["overview", "columns", "types", "missing", "duplicates", "outliers", "pearson", "spearman", "top_values"]
    monkeypatch.setattr(recipes.corr, "corr_matrix", None)
    monkeypatch.setattr(recipes.profile, "column_profile", None)
    own = recipes.full_profile(mix12, names)
    assert list(own) == names
    for name in names:
        assert sorted(own[name].collect()) == sorted(whole[name].collect())

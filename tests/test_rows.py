"""Filters, order, slices, sources, series, charts."""

import csv

import numpy as np
import pandas as pd
import pytest
from tests.conftest import by
from pyspark.sql import functions as F

from tablescope.operators import chartdata, multivariate, order, reshape, select, series, text
from tablescope.sources import io


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(1, "1", 1.0), (2, " 3 ", 2.5), (3, "abc", float("nan")), (4, "nan", None), (5, "", -4.0), (6, "a.b(", 7.0), (7, None, 9.0)]
    return spark.createDataFrame(rows, "id int, s string, v double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(messy):
    assert ids(select.filter_equals(messy, "s", "abc")) == [3]
    assert ids(select.filter_equals(messy, "v", "1")) == [1]
    assert ids(select.filter_equals(messy, "v", "x")) == []
    assert ids(select.filter_greater(messy, "s", "0")) == [1, 2]
    assert ids(select.filter_greater(messy, "v", 2)) == [2, 6, 7]
    assert ids(select.filter_less(messy, "v", 2)) == [1, 5]
    assert ids(select.filter_contains(messy, "s", "A.B")) == [6]
    assert ids(select.filter_contains(messy, "s", "A.B(", literal=True)) == [6]
    assert ids(select.apply_filter(messy, "s", "Sounds Like", "x")) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(select.apply_filter(messy, "v", "Less Than", "abc", on_error="keep")) == [1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        select.apply_filter(messy, "v", "Less Than", "abc")


def test_integer_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    plan = select.filter_greater(spark.read.parquet(path), "id", 50)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id" in plan


def test_sorts_put_missing_last(messy):
    assert [r["id"] for r in select.sort_asc(messy, "v").collect()][-2:] != [7, 6]
    assert {r["id"] for r in select.sort_asc(messy, "v").collect()[-2:]} == {3, 4}
    assert {r["id"] for r in select.sort_desc(messy, "v").collect()[-2:]} == {3, 4}


def test_row_index_survives_skew_and_copies(spark):
    rows = [(1.0, "x")] * 500 + [(float(i), "y") for i in range(500)]
    df = spark.createDataFrame(rows, "v double, s string").repartition(7)
    got = sorted(order.with_row_index(df, "v").collect(), key=lambda r: r["row_index"])
    assert [r["row_index"] for r in got] == list(range(1000))
    assert [r["v"] for r in got] == sorted(r[0] for r in rows)


def test_running_totals(spark):
    df = spark.createDataFrame([(g, i, i % 3) for g in ("a", "b") for i in range(50)], "g string, i int, n int")
    got = by(order.running_totals(df.repartition(5), "i", ["n"], "g"), "g", "i")
    for g in ("a", "b"):
        for i in range(50):
            assert got[g, i]["n_before"] == sum(j % 3 for j in range(i))


def test_pages_put_the_table_back_together(spark, monkeypatch):
    df = spark.range(57).repartition(4)
    for limit in (100_000, 0):
        monkeypatch.setattr(select, "SHALLOW_ROWS", limit)
        pages = [[r["id"] for r in select.page(df, p, 20, "id").collect()] for p in range(select.page_count(df, 20))]
        assert sorted(x for p in pages for x in p) == list(range(57)) and [len(p) for p in pages] == [20, 20, 17]
    with pytest.raises(ValueError):
        select.slice_rows(df, 9, 3, order_by="id")
    assert [r["id"] for r in select.slice_rows(df, -4, 2, order_by="id").collect()] == [0, 1]


def test_preview_cuts_long_text(spark):
    df = spark.createDataFrame([("x" * 50, 1.0), ("y" * 51, None)], "s string, v double")
    got = sorted(map(tuple, select.preview(df).collect()))
    assert got == [("x" * 50, "1.00"), ("y" * 47 + "...", "")]


def test_sample_is_stable(spark):
    df = spark.range(1000)
    first, second = select.sample_rows(df, 20).collect(), select.sample_rows(df.repartition(9), 20).collect()
    assert first == second and len(first) == 20
    assert select.sample_rows(df.limit(5), 20).count() == 5


def test_sample_draws_copies_one_by_one(spark):
    """A value on a third of the rows gets about a third of the sample, in every layout, and a sample of all rows is the table."""
    rows = [(7, None, "x")] * 400 + [(k, None, "y") for k in range(400)] + [(None, k, "z") for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(6)
    hot = []
    for seed in range(12):
        got = [tuple(r) for r in select.sample_rows(df, 120, seed).collect()]
        again = [tuple(r) for r in select.sample_rows(df.repartition(3), 120, seed).collect()]
        assert got == again and len(got) == 120
        others = [r for r in got if r[2] != "x"]
        assert len(set(others)) == len(others) and set(got) <= set(rows)
        hot.append(120 - len(others))
    assert 34 < np.mean(hot) < 46 and 2 < np.std(hot) < 9
    assert sorted(map(str, select.sample_rows(df, 1300).collect())) == sorted(map(str, df.collect()))
    assert [r["n"] for r in select.sample_rows(df, 1199).groupBy("c").count().withColumnRenamed("count", "n").orderBy("c").collect()][0] in (399, 400)


def test_sample_of_nested_rows(spark):
    df = spark.sql("SELECT id, map('k', id) AS m, array(id, NULL) AS l, struct(id) AS s FROM range(40)")
    got = select.sample_rows(df, 9)
    assert got.dtypes == df.dtypes and got.count() == 9 and got.select("id").distinct().count() == 9


def test_others(spark):
    df = spark.createDataFrame([(chr(97 + i),) for i in range(12) for _ in range(20 - i)], "c string")
    got = by(select.top_n_plus_others(df, "c", 9, 10), "value")
    assert len(got) == 10 and got["Others"]["n"] == 11 + 10 + 9
    assert len(by(select.top_n_plus_others(df.filter("c < 'k'"), "c", 9, 10), "value")) == 10


def test_round_trips(spark, tmp_path, messy):
    for fmt in ("csv", "json", "parquet"):
        path = io.write_table(messy.select("id"), str(tmp_path / f"t.{fmt}"))
        assert ids(io.read_table(spark, path, schema="id int")) == [1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        io.write_table(messy, str(tmp_path / "t.xlsx"))
    path = io.write_table(messy.select("id"), str(tmp_path / "i.csv"), with_index=True, order_by="id")
    assert by(io.read_table(spark, path), "id")[7]["index"] == 6


def test_corrupt_rows_are_kept_in_previews(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    spark.createDataFrame([("a,b",), ("1,x",), ("oops,y",), ("3,z",)], "value string").coalesce(1).write.text(path)
    preview = io.read_preview(spark, path, "a int, b string")
    assert tuple(io.preview_quality(preview).first()) == (3, 1)


def test_csv_records_across_splits(spark, tmp_path):
    """Quoted line breaks, doubled quotes and records longer than a split: the same rows as one task reads, from many tasks."""
    rows = []
    for k in range(400):
        text = ["plain", 'a "quoted" word', "two\nlines", 'line\n"break", comma', "\n" * 5, "x" * 700 + "\n" + "y" * 900, "", "tail\r\nend"][k % 8]
        rows.append((k, text or None, k * 0.5))
    path = tmp_path / "t.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["k", "text\nof header", "v"])
        writer.writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2048)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    got = io.read_table(spark, str(path), "csv", schema="k int, text string, v double", multi_line=True)
    tasks = io.csv_records(spark, str(path)).rdd.getNumPartitions()
    found = sorted(map(tuple, got.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == rows and tasks >= 8
    assert [r["k"] for r in io.read_table(spark, str(path), "csv", multi_line=True).orderBy("k").limit(3).collect()] == [0, 1, 2]


def test_narrowing(spark):
    df = spark.createDataFrame([(0, 300, -5, 2**40, "a", 0.5), (255, 70_000, 100, 1, "a", 1.5), (7, 1, 2, 3, "b", 2.5), (7, 1, 2, 3, "b", 2.5), (7, 1, 2, 3, "b", 2.5)], "u8 long, u32 long, i8 long, big long, s string, f double")
    narrowed, plan = io.narrow_schema(df)
    assert dict(narrowed.dtypes) == {"u8": "smallint", "u32": "bigint", "i8": "tinyint", "big": "bigint", "s": "string", "f": "double"}
    assert by(plan, "column")["s"]["dictionary_candidate"] is True
    assert sorted(narrowed.collect()) == sorted(df.collect())
    assert io.footprint_summary(df).first()["total_bytes"] == 5 * 8 * 5 + 5
    assert io.narrow_schema(df.limit(0))[1].count() == 6


def test_rolling_agrees_with_pandas_for_short_and_long_windows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"t": np.arange(400), "v": rng.normal(50, 10, 400)})
    df = spark.createDataFrame(pdf).repartition(5)
    for window in (1, 7, 90, 399, 400):
        got = by(series.rolling_stats(df, "t", "v", window, order_by="t"), "ts")
        mean, std = pdf.v.rolling(window).mean(), pdf.v.rolling(window).std()
        for t in range(400):
            if t < window - 1:
                assert got[t]["rolling_mean"] is None and got[t]["rolling_std"] is None
            else:
                assert got[t]["rolling_mean"] == pytest.approx(mean[t], rel=1e-9)
                assert got[t]["rolling_std"] == (None if window == 1 else pytest.approx(std[t], rel=1e-9))


def test_windows_of_all_lengths_see_one_order(spark):
    """Ties of the time go by value at every length, and neither a large offset nor a trend costs digits."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"t": np.arange(2400) // 4, "v": 1e9 + rng.normal(size=2400)})
    df = spark.createDataFrame(pdf).repartition(7)
    ordered = pdf.sort_values(["t", "v"], ignore_index=True)
    first = None
    for window in (3, 200, 201, 1700):
        got = series.rolling_stats(df, "t", "v", window, order_by="t").orderBy("idx").toPandas()
        assert (got.ts == ordered.t).all() and (got.value == ordered.v).all()
        first = got if first is None else first
        assert (got[["idx", "ts", "value"]] == first[["idx", "ts", "value"]]).all(axis=None)
        shifted = (ordered.v - 1e9).rolling(window)
        assert got.rolling_mean.isna().sum() == window - 1
        assert np.allclose(got.rolling_mean[window - 1 :] - 1e9, shifted.mean()[window - 1 :], atol=2e-7)
        assert np.allclose(got.rolling_std[window - 1 :], shifted.std()[window - 1 :], rtol=1e-6)


def test_constant_windows_have_no_spread(spark):
    df = spark.createDataFrame([(k, 0.1) for k in range(50)], "t int, v double").repartition(4)
    got = series.rolling_stats(df, "t", "v", 7, order_by="t").where("idx >= 6").collect()
    assert len(got) == 44 and all(r["rolling_std"] == 0 and r["rolling_mean"] == 0.1 for r in got)


def test_autocorrelation_across_blocks(spark, mix12, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    s = pd.Series(np.cumsum(rng.normal(size=300)))
    df = spark.createDataFrame(pd.DataFrame({"t": s.index, "v": s.values})).repartition(6)
    got = by(series.autocorrelation(df, "t", "v", order_by="t"), "lag")
    assert len(got) == 20
    for lag, row in got.items():
        assert row["r"] == pytest.approx(s.autocorr(lag), rel=1e-9)
    assert by(series.autocorrelation(mix12, "id", "x", order_by="id"), "lag")[1]["r"] == pytest.approx(0.585206, abs=1e-6)


def test_histograms(mix12, spark):
    got = chartdata.histogram(mix12, ["x"], 5).orderBy("bin").collect()
    assert [r["n"] for r in got] == [11, 0, 0, 0, 1] and got[1]["left_edge"] == pytest.approx(20.8)
    assert [r["n"] for r in chartdata.equal_width_cut(mix12, "x", 4).orderBy("bin").collect()] == [11, 0, 0, 1]
    assert sum(r["n"] for r in chartdata.histogram(mix12, ["k"], 3).collect()) == 12


def test_ecdf_and_regression(spark, mix12):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "x double")
    assert [r["y"] for r in chartdata.ecdf(df, "x").orderBy("value").collect()] == [0, 0.25, 0.5, 0.75, 1]
    line = chartdata.regression(mix12, "x", "y").first()
    assert line["slope"] == pytest.approx(0.156302, abs=1e-6) and line["intercept"] == pytest.approx(9.979381, abs=1e-6)
    band = chartdata.regression_band(mix12, "x", "y").collect()
    assert len(band) == 100 and all(r["lower"] < r["fit"] < r["upper"] for r in band)


def test_kde_by_brute_force(spark):
    values = np.random.default_rng(8).normal(size=700)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    h = values.std(ddof=1) * len(values) ** (-0.2)
    for row in chartdata.kde(df, "v", 50).collect():
        want = np.exp(-0.5 * ((row["x"] - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
        assert row["density"] == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_wide_crosstab_and_transpose(mix12):
    got = by(reshape.crosstab_wide(mix12, "g", "h"), "g")
    assert (got["a"]["p"], got["a"]["q"], got["c"]["q"]) == (3, 1, 3)
    turned = by(reshape.transpose(mix12, 2, "id"), "column")
    assert turned["id"]["row2"] == "2" and turned["g"]["row1"] == "a"


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 1))
    pdf = pd.DataFrame(np.hstack([base + rng.normal(size=(400, 1)) * s for s in (0.1, 0.5, 2.0)]), columns=list("abc")).assign(k=1.0)
    df = spark.createDataFrame(pdf)
    values = np.sort(np.linalg.eigvalsh(pdf[list("abc")].corr().to_numpy()))[::-1]
    got = by(multivariate.pca_components(df), "component", "column")
    assert got[1, "a"]["explained"] == pytest.approx(values[0]) and got[2, "a"]["explained_ratio"] == pytest.approx(values[1] / 3)
    scores = multivariate.pca(df).agg(F.var_pop("pc1"), F.covar_pop("pc1", "pc2")).first()
    assert scores[0] == pytest.approx(values[0]) and scores[1] == pytest.approx(0, abs=1e-9)


def test_kmeans_finds_separated_groups(spark):
    rows = [(float(c * 100 + i % 3), float(-c * 50 + i % 2), i) for c in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, y double, id int")
    centers = by(multivariate.kmeans_centers(df, ["x", "y"]), "cluster", "column")
    assert [round(centers[i, "x"]["center"]) for i in range(3)] == [1, 101, 201]
    labelled = multivariate.kmeans(df, ["x", "y"], keep=["id"])
    assert {r["n"] for r in labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()} == {30}


def test_words(spark):
    df = spark.createDataFrame([("The cat's café, a cat",), ("the CAT naïve",), (None,)], "t string")
    got = {r["word"]: r["n"] for r in text.word_frequencies(df).collect()}
    assert got == {"the": 2, "cat's": 1, "café": 1, "cat": 2, "naïve": 1}
    assert text.text_stats(df).first()["max_words"] == 4


def test_time_column_detection(spark):
    df = spark.createDataFrame([("x", "2024-01-01", 1.0), ("y", "2024-01-02", 2.0)], "a string, b string, v double")
    assert series.detect_time_column(df) == "b"
    assert [r["value"] for r in series.time_trend(df).collect()] == [1.0, 2.0]


def test_layout_of_the_sample_query_follows_the_table(spark, monkeypatch, tmp_path):
    """No fixed number of parts, which would make a task of it grow with the table."""
    from catalog import QUERIES

    spark.range(40).selectExpr("id AS l_orderkey", "id % 9 AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    taken, sample = [], select.sample_rows
    monkeypatch.setattr(select, "sample_rows", lambda df, n: taken.append(df) or sample(df, n))
    assert QUERIES["sample_rows_any_layout"](spark, str(tmp_path)).first()["differing"] == 0
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in taken]
    assert sum("hashpartitioning(l_suppkey" in p for p in plans) == 1 and not any("REPARTITION_BY_NUM" in p for p in plans)

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tests.conftest import by

from tablescope.functions import special
from tablescope.operators import anova, assoc, corr, kendall, ranks
from tablescope.plans import recipes, relations
from tablescope.plans.config import RelationConfig

ANY_SIZE = RelationConfig(min_sample_size=1)


def tau_b(a, b):
    """Every pair of rows, by definition."""
    dx, dy = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
    return (dx * dy).sum() / math.sqrt((dx * dx).sum() * (dy * dy).sum())


@pytest.fixture(scope="module")
def tangled():
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=900).round(1), "b": rng.normal(size=900), "c": rng.integers(0, 5, 900).astype(float), "k": 7.0})
    pdf["b"] += pdf.a
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    pdf.loc[:300, "a"] = 1.5
    return pdf


def test_pearson(mix12, spark, tangled):
    got = by(corr.corr_matrix(mix12), "col1", "col2")
    assert got["x", "y"]["r"] == pytest.approx(0.643630, abs=1e-6) and got["x", "y"]["n"] == 11
    assert got["x", "k"]["r"] is None
    got = by(corr.corr_matrix(spark.createDataFrame(tangled)), "col1", "col2")
    want = tangled.corr()
    for (a, b), row in got.items():
        if "k" in (a, b):
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(want.loc[a, b], rel=1e-9)


@pytest.mark.parametrize("parts", [1, 13])
def test_spearman(spark, tangled, parts):
    """In many small partitions ties cross their borders; both must agree with pandas."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = by(corr.corr_matrix(spark.createDataFrame(tangled).repartition(parts), "spearman"), "col1", "col2")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for (a, b), row in got.items():
        ranks = tangled[[a, b]].dropna().rank()
        if "k" in (a, b):
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(np.corrcoef(ranks[a], ranks[b])[0, 1], rel=1e-9)
            assert row["n"] == len(ranks)


@pytest.mark.parametrize("parts, records", [(1, 10_000), (11, 10_000), (11, 7)])
def test_ranks_across_partitions_and_batches(spark, parts, records):
    """Average ranks of several groups, with values that fill whole partitions and batches."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"group": g, "value": v.astype(float)}) for g, v in enumerate([rng.integers(0, 3, 500), rng.normal(size=300), np.zeros(200), np.array([1.0]), rng.integers(0, 90, 400) * -0.0])]
    pdf = pd.concat(frames, ignore_index=True).assign(row=lambda d: np.arange(len(d)))
    got = ranks.ranked(spark.createDataFrame(pdf), "row").toPandas().sort_values("row")
    for key, value in (("shuffle.partitions", 4), ("execution.arrow.maxRecordsPerBatch", 10_000), ("adaptive.coalescePartitions.enabled", "true")):
        spark.conf.set(f"spark.sql.{key}", value)
    assert len(got) == len(pdf)
    assert (got["rank"].to_numpy() == pdf.groupby("group").value.rank().to_numpy()).all()
    assert (got.ties.to_numpy() == pdf.groupby(["group", "value"]).value.transform("size").to_numpy()).all()


def test_long_runs_are_not_kept():
    """The cells of a run whose length is known leave as they come, whatever its length; ranks are those of the whole."""
    values = np.repeat([0.0, 1.0, 2.0, 3.0], [5, 1000, 3, 400])
    none = np.zeros(len(values), np.int32)
    batches = pa.table({"group": none, "value": values, "_part": none}).to_batches(max_chunksize=10)
    taken = given = lag = 0
    out = []

    def counted():
        nonlocal taken
        for batch in batches:
            taken += batch.num_rows
            yield batch

    for batch in ranks._positions(counted(), {0: {0: (0, 0, 5, 450, 3.0, {1.0: 1000})}}):  # the last value goes on for 50 cells
        given += batch.num_rows
        lag = max(lag, taken - given)
        out += list(zip(batch.column("rank").to_pylist(), batch.column("ties").to_pylist()))
    assert lag < 30 and given == len(values)
    assert out == [(3.0, 5)] * 5 + [(505.5, 1000)] * 1000 + [(1007.0, 3)] * 3 + [(1233.5, 450)] * 400


@pytest.mark.parametrize("most", [0, 60, 1 << 18])
def test_ranks_by_tables_and_by_shuffle(spark, monkeypatch, most):
    """Spearman and Kruskal-Wallis agree with pandas, whichever columns are ranked by counts."""
    monkeypatch.setattr(ranks, "KNOWN_VALUES", most)
    monkeypatch.setattr(ranks, "LONG_RUN", 20)
    monkeypatch.setattr(ranks, "LEAST_CELLS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.integers(0, 3, 400) * -1.0, "b": rng.normal(size=400).round(1), "c": rng.integers(0, 9, 400) * 1.0, "g": rng.choice([*"xyz"], 400)})
    pdf["d"] = pdf.a + pdf.b
    for frame in (pdf, pdf.assign(c=pdf.c.where(pdf.c > 0), d=pdf.d.where(rng.random(400) < 0.8))):
        df = spark.createDataFrame(frame).repartition(3)
        got = by(corr.corr_matrix(df, "spearman"), "col1", "col2")
        tested = by(anova.kruskal(df, RelationConfig(min_sample_size=1)), "num")
        for (x, y), row in got.items():
            both = frame[[x, y]].dropna()
            assert row["n"] == len(both) and row["r"] == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-12)
        for num, row in tested.items():
            own = frame[[num, "g"]].dropna()
            r, n = own[num].rank(), len(own)
            h = 12 / (n * (n + 1)) * (r.groupby(own.g).sum() ** 2 / r.groupby(own.g).size()).sum() - 3 * (n + 1)
            t = own[num].value_counts().to_numpy()
            assert row["n"] == n and row["h_stat"] == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)), rel=1e-9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def scans(df):
    """File scans in a plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_pearson_and_contingency_scan_once(spark, tmp_path):
    """150 columns of numbers, and 40 of texts, are one scan each; results agree with pandas."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(300, 150)) + 1e6, columns=[f"x{i}" for i in range(150)])
    pdf["x1"] = pdf["x0"] * 2 + rng.normal(size=300)
    pdf.loc[rng.random(300) < 0.3, "x2"] = np.nan
    pdf["x3"] = 0.1
    spark.createDataFrame(pdf).repartition(5).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    matrix = corr.corr_matrix(df)
    assert scans(matrix) == 1
    got, want = by(matrix, "col1", "col2"), pdf.corr()
    assert len(got) == 150 * 149 // 2
    for (a, b), row in got.items():
        assert row["n"] == len(pdf[[a, b]].dropna())
        assert row["r"] is None if "x3" in (a, b) else row["r"] == pytest.approx(want.loc[a, b], abs=1e-9)
    texts = pd.DataFrame({f"c{i}": rng.choice([*"abcdefg"[: 2 + i % 5], None], 300) for i in range(40)})
    spark.createDataFrame(texts).repartition(5).write.parquet(str(tmp_path / "texts"))
    pairs = [(f"c{i}", f"c{j}") for i in range(40) for j in range(i + 1, 40)]
    table = assoc.cells(spark.read.parquet(str(tmp_path / "texts")), pairs)
    assert scans(table) == 1 and "Expand" not in table._jdf.queryExecution().executedPlan().toString()
    counted = {}
    for r in table.collect():
        counted[r["col1"], r["col2"], r["v1"], r["v2"]] = r["n"]
    for a, b in pairs[::37]:
        own = texts[[a, b]].dropna().groupby([a, b]).size()
        assert {k[2:]: n for k, n in counted.items() if k[:2] == (a, b)} == own.to_dict()


def test_cells_of_many_levels(spark, monkeypatch):
    """Tables that outgrow a task's bounds go out in parts; the counts are the same."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 700, 3000).astype(str), "b": rng.integers(0, 600, 3000).astype(str), "c": rng.choice(["x", "y"], 3000)})
    df = spark.createDataFrame(pdf).repartition(3)
    for most_cells, most_levels in ((1 << 25, 1 << 18), (50, 100)):
        monkeypatch.setattr(assoc, "MOST_CELLS", most_cells)
        monkeypatch.setattr(assoc, "MOST_LEVELS", most_levels)
        got = {(r["col1"], r["col2"], r["v1"], r["v2"]): r["n"] for r in assoc.cells(df, [("a", "b"), ("a", "c"), ("b", "c")]).collect()}
        want = {(x, y, *k): n for x, y in (("a", "b"), ("a", "c"), ("b", "c")) for k, n in pdf.groupby([x, y]).size().items()}
        assert got == want


@pytest.mark.parametrize("block", [200_000, 40])
def test_kendall(spark, tangled, monkeypatch, block):
    """With tiny blocks most pairs cross blocks, and the hot value of ``a`` gets a block of its own."""
    monkeypatch.setattr(kendall, "POINTS_PER_BLOCK", block)
    got = by(corr.corr_matrix(spark.createDataFrame(tangled), "kendall", ["a", "b", "c"]), "col1", "col2")
    for (a, b), row in got.items():
        s = tangled[[a, b]].dropna()
        assert row["r"] == pytest.approx(tau_b(s[a].to_numpy(), s[b].to_numpy()), rel=1e-9)


def test_chi_square_and_friends(mix12):
    row = assoc.chi_square(mix12).first()
    assert (row["n"], row["dof"]) == (11, 2)
    assert row["chi2"] == pytest.approx(2.261111, abs=1e-6) and row["p_value"] == pytest.approx(0.322854, abs=1e-6)
    assert row["cramers_v"] == pytest.approx(0.453382, abs=1e-6)
    assert assoc.theils_u(mix12).first()["u_col1_given_col2"] == pytest.approx(0.097649, abs=1e-6)
    rules = assoc.association_rules(mix12).collect()
    assert [(r["v1"], r["v2"], r["n"]) for r in rules] == [("a", "p", 3)]
    assert rules[0]["lift"] == pytest.approx(1.65) and rules[0]["confidence"] == pytest.approx(0.75)


def test_yates(spark):
    rows = [("a", "p")] * 10 + [("a", "q")] * 20 + [("b", "p")] * 30 + [("b", "q")] * 15
    row = assoc.chi_square(spark.createDataFrame(rows, "a string, b string")).first()
    assert row["chi2"] == pytest.approx(6.752232, abs=1e-6) and row["p_value"] == pytest.approx(0.009363, abs=1e-6)
    assert row["cramers_v"] == pytest.approx(0.300050, abs=1e-6)


def test_single_level_and_gate(spark):
    rows = [(f"v{i % 51:02d}", f"w{i % 50:02d}", "one") for i in range(2550)]
    df = spark.createDataFrame(rows, "wide string, edge string, flat string")
    got = by(assoc.chi_square(df), "col1", "col2")
    assert set(got) == {("edge", "flat")} and got["edge", "flat"]["cramers_v"] == 0
    assert anova.anova(df.selectExpr("flat", "1.0 * length(edge) as n")).count() == 0


def test_anova_and_kruskal(mix12):
    a = anova.anova(mix12, ANY_SIZE, ["g"], ["x"]).first()
    assert a["f_stat"] == pytest.approx(0.548480, abs=1e-6) and a["eta2"] == pytest.approx(0.120585, abs=1e-6)
    assert a["p_value"] == pytest.approx(0.598101, abs=1e-6) and a["effect"] == "medium"
    k = anova.kruskal(mix12, ANY_SIZE, ["g"], ["x"]).first()
    assert k["h_stat"] == pytest.approx(3.659091, abs=1e-6) and k["kruskal_p"] == pytest.approx(0.160486, abs=1e-6)
    assert anova.anova(mix12).count() == 0


def test_small_groups(spark):
    rows = [("a", float(i)) for i in range(40)] + [("b", float(i * 2)) for i in range(35)] + [("c", 1.0)] * 5
    df = spark.createDataFrame(rows, "g string, v double")
    assert anova.anova(df).first()["levels"] == 2
    assert anova.anova(df, RelationConfig(small_groups="skip_pair")).count() == 0


def test_tail_probabilities_match_the_jvm(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    for x, d in [(0.1, 1), (3.9, 8), (55.5, 57), (200.0, 120), (1e-9, 3)]:
        assert special.chi2_tail(x, d) == pytest.approx(1 - dist.ChiSquaredDistribution(float(d)).cumulativeProbability(x), abs=1e-9)
    for f, a, b in [(0.5, 2, 8), (1.54, 2, 59997), (4.0, 24, 1975), (30.0, 1, 10)]:
        assert special.f_tail(f, a, b) == pytest.approx(1 - dist.FDistribution(float(a), float(b)).cumulativeProbability(f), abs=1e-9)
    for p, d in [(0.975, 1), (0.975, 10), (0.3, 5), (0.995, 59998)]:
        assert special.t_quantile(p, d) == pytest.approx(dist.TDistribution(float(d)).inverseCumulativeProbability(p), abs=1e-6)


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-300, 1e-12, 0.001, 0.07, 0.3, 0.5, 0.9, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for row in df.select("p", special.norm_ppf(df.p).alias("z")).collect():
        assert row["z"] == pytest.approx(NormalDist().inv_cdf(row["p"]), rel=1e-9, abs=1e-12)


def test_relation_bundle(mix12):
    out = relations.analyze_relations(mix12, ANY_SIZE)
    assert out["metadata"].first()["usable_categories"] == 2
    strongest = out["numerical"].first()
    assert strongest["strength"] == "strong" and strongest["direction"] == "positive"
    assert out["categorical"].count() == 1 and out["mixed_summary"].first()["total_pairs"] == 8
    narrow = relations.analyze_relations(mix12.select("x", "g"))
    assert set(narrow["numerical"].columns) == {"error"} and set(narrow["categorical"].columns) == {"error"}
    no_text = relations.analyze_relations(mix12.select("x", "y"))
    assert set(no_text["mixed"].columns) == {"error"}


def test_relation_jobs_do_not_grow_with_columns(spark):
    def jobs(k):
        rng = np.random.default_rng(0)
        pdf = pd.DataFrame({f"n{i}": rng.normal(size=200) for i in range(k)} | {f"t{i}": rng.choice(list("abc"), 200) for i in range(k)})
        df = spark.createDataFrame(pdf).persist()
        df.count()
        group = f"columns-{k}"
        spark.sparkContext.setJobGroup(group, group)
        corr.corr_matrix(df).collect()
        assoc.chi_square(df).collect()
        anova.anova(df).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(7) <= jobs(3) + 1


def test_config_from_json(tmp_path):
    path = tmp_path / "settings.json"
    path.write_text('{"top_k": 3, "max_workers": 9}')
    config = RelationConfig.from_json(str(path))
    assert config.top_k == 3 and config.max_cardinality == 50


def test_recipes(mix12, tmp_path):
    every = recipes.run_recipe(mix12, list(recipes.RECIPES), order_by="id", path=str(tmp_path / "out"))
    failed = {r.token: r.error for r in every if r.error}
    assert set(failed) == {"C51"}, failed  # no time column in this table
    assert recipes.run_recipe(mix12, ["C99"])[0].error == "unknown token"
    assert recipes.template("nonsense") == recipes.template("basic")


def test_recipes_share_a_scan_and_report_late_failures(spark, tmp_path):
    """Eight aggregate recipes read the table once; one that fails while it runs is reported, the others come."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "y": rng.integers(-3, 4, 200).astype(float), "s": rng.choice(["a", "b", None], 200)})
    pdf.loc[::7, "y"] = np.nan
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tokens = ["C2", "C3", "C11", "C29", "C30", "C31", "C33", "C40"]
    shared = recipes.run_recipe(df, tokens)
    assert all(r.error is None and scans(r.result) == 0 for r in shared)  # all come from one written row
    for token, together in zip(tokens, shared):
        (alone,) = recipes.run_recipe(df, [token])
        assert together.result.columns == alone.result.columns
        assert sorted(map(str, together.result.collect())) == sorted(map(str, alone.result.collect())), token
    late = df.selectExpr("x", "y", "CASE WHEN x > -9 THEN raise_error('late') END AS z")
    results = recipes.run_recipe(late, ["C15", "C29", "C9", "C3"], eager=True)
    assert [r.error is None for r in results] == [True, True, True, False] or [r.error is None for r in results] == [True, False, True, False]
    assert "late" in results[3].error and results[0].result.first()["n_rows"] == 200

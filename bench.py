"""Headline queries, timed after one warm-up; prints one JSON line.

The table is loaded and kept in memory first, as an interactive analysis would; loading is timed too.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablescope.operators import anova, assoc, chartdata, corr, profile, quality, reshape, series, text  # noqa: E402
from tablescope.plans import relations  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))
ONLY = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tablescope-bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, name: str):
    start = time.perf_counter()
    frame = spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(CPUS).persist()
    frame.count()
    return frame, time.perf_counter() - start


def drain(result) -> None:
    frames = result.values() if isinstance(result, dict) else [result]
    for frame in frames:
        frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    tables = {}
    for name in ("lineitem", "orders", "events", "documents"):
        tables[name], times[f"load_{name}"] = load(spark, name)
    lineitem, orders, events, documents = (tables[n] for n in ("lineitem", "orders", "events", "documents"))
    runs = {
        "column_profile": lambda: profile.column_profile(lineitem),
        "quick_eda": lambda: profile.quick_eda(lineitem),
        "quantiles": lambda: profile.quantiles(lineitem),
        "iqr_outliers": lambda: quality.iqr_outliers(lineitem),
        "duplicate_rows_count": lambda: quality.duplicate_rows_count(lineitem),
        "corr_pearson": lambda: corr.corr_matrix(lineitem),
        "corr_spearman": lambda: corr.corr_matrix(lineitem, "spearman"),
        "corr_kendall": lambda: corr.corr_matrix(lineitem, "kendall", ["l_quantity", "l_extendedprice"]),
        "chi_square": lambda: assoc.chi_square(orders),
        "association_rules": lambda: assoc.association_rules(orders),
        "anova": lambda: anova.anova(lineitem),
        "kruskal": lambda: anova.kruskal(lineitem),
        "analyze_relations": lambda: relations.analyze_relations(lineitem),
        "crosstab": lambda: reshape.crosstab(lineitem, "l_returnflag", "l_linestatus"),
        "histogram": lambda: chartdata.histogram(lineitem),
        "box_stats_by": lambda: chartdata.box_stats_by(lineitem, "l_returnflag", "l_extendedprice"),
        "ecdf": lambda: chartdata.ecdf(lineitem, "l_extendedprice"),
        "kde": lambda: chartdata.kde(lineitem, "l_quantity"),
        "hexbin": lambda: chartdata.hexbin(lineitem, "l_quantity", "l_extendedprice"),
        "rolling_stats": lambda: series.rolling_stats(events, "ts", "value"),
        "autocorrelation": lambda: series.autocorrelation(events, "ts", "value"),
        "word_frequencies": lambda: text.word_frequencies(documents, "text"),
    }
    for name, run in runs.items():
        if ONLY and name not in ONLY:
            continue
        drain(run())
        samples = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            drain(run())
            samples.append(time.perf_counter() - start)
        times[name] = sorted(samples)[len(samples) // 2]
        print(f"{name}: {times[name]:.2f}s", file=sys.stderr, flush=True)
    times = {k: round(v, 3) for k, v in times.items()}
    total = round(sum(v for k, v in times.items() if not k.startswith("load_")), 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale, "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()

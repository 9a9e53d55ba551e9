"""Every registered query against its SQL at the smallest scale."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def comparable(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, 0.0 if value == 0 else float(f"{value:.6g}") if math.isfinite(value) else value)
    return (3, str(value))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6)
    return a == b


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


# Fixed by definition to tables of another size: these thresholds leave nothing at this scale.
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    frame = contract.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(([r[c] for c in columns] for r in frame.collect()), key=lambda row: [comparable(v) for v in row])
    cursor = oracle.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(([row[i] for i in at] for row in cursor.fetchall()), key=lambda row: [comparable(v) for v in row])
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if not all(same(x, y) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]

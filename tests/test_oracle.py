"""Every registered query against its DuckDB oracle, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "0.001"
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    problem, rows, _ = compare(spark, con, name, SF)
    assert problem is None, problem
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_a_difference_is_found(spark, con, monkeypatch):
    from catalog.base import REGISTRY
    wrong = REGISTRY["gate_sentiment"].sql.replace("< 15", "< 40")
    monkeypatch.setattr(REGISTRY["gate_sentiment"], "sql", wrong)
    problem, _, _ = compare(spark, con, "gate_sentiment", SF)
    assert problem is not None


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith("gate_") or n == "gate"])
def test_gates_accept_and_reject(spark, name):
    from pyspark.sql import functions as F
    df = entry.queries()[name](spark, f"/root/testdata/sf{SF}")
    seen = df.agg(F.count_if(F.col("reason").isNull()).alias("a"), F.count_if(F.col("reason").isNotNull()).alias("r")).first()
    assert seen.a > 0 and seen.r > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["task_id", "prompt", "system", "chosen", "rejected"]
    assert df.count() > 0

"""Every registered query that has SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from runsight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall())
    assert len(got) == len(expected)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_records_are_numbered_without_a_task_that_holds_a_status(spark):
    """record_envelope has no window over all orders of a status."""
    plan = registry.QUERIES["record_envelope"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderstatus" not in plan and "row_number() windowspecdefinition(series_id#" not in plan.split("taken")[0]


@pytest.mark.parametrize("name", ["log_telemetry", "mesher_progress"])
def test_lines_are_tried_once(spark, name):
    """What is written of the lines is read by all that follows; no pattern is tried on a line again."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan

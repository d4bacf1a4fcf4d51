"""Every query against its DuckDB equivalent on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from inkloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for name in os.listdir(smallest):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{smallest}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "∅"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, smallest, name):
    ours, theirs = QUERIES[name](spark, smallest).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, smallest, name):
    assert QUERIES[name](spark, smallest).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_python_in_sql_plans(spark, smallest):
    # a JSON decoder, charsets the JVM function refuses, HTML character references, and Markdown blocks
    python = {"embedded_json", "charset_decoded", "escapes_decoded", "markdown_headings"}
    for name in sorted(set(SQL) & set(QUERIES) - python):
        if name.startswith("stream_") or name in ("relay_jsonl",):
            continue
        plan = QUERIES[name](spark, smallest)._jdf.queryExecution().optimizedPlan().toString()
        assert "InArrow" not in plan and "PythonUDF" not in plan and "InPandas" not in plan, name

"""Every query that has SQL gives what DuckDB gives on the same tables."""

import duckdb
import pandas as pd
import pytest

from textmill.plans import MODULES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {name: (query, module.ORACLES.get(name)) for module in MODULES for name, query in module.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def cell(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return "null"
    return repr(round(float(value), 6)) if pd.api.types.is_number(value) and not pd.api.types.is_bool(value) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    out = rows(query(spark, FOLDER).toPandas())
    assert out[0]
    if sql:
        assert out == rows(duck.sql(sql).df())

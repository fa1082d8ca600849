"""Packages of more members than an archive from elsewhere may have."""

import duckdb
import pytest

from tests.test_plans import rows
from textmill.plans import packages as P
from textmill.sources import archives as A


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("many")
    n = 16 * (A.ENTRIES + 10)
    duckdb.sql(f"COPY (SELECT i AS doc_id, 'text ' || i AS text, 'src' || i % 20 AS source FROM range({n}) AS r(i)) TO '{path}/documents.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["package_members", "package_faults", "package_manifests", "package_directories"])
def test_many_members(spark, folder, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    columns, out = rows(P.QUERIES[name](spark, folder).toPandas())
    assert (columns, out) == rows(duck.sql(P.ORACLES[name]).df())


def test_splits_of_an_archive(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(bytes(200_000))
    reader = A.ZipMembersReader({"path": str(tmp_path), "split_bytes": 1000}, {})
    assert len(reader.partitions()) <= A.ARCHIVE_SPLITS

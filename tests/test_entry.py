import os

import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "segment", "text", "score"] and rows.count() == 50


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 92


def test_coverage_names_what_there_is():
    """Every query that COVERAGE.md names is registered, and has SQL unless it is marked."""
    path = os.path.join(os.path.dirname(entry.__file__), "COVERAGE.md")
    queries, sql = entry.queries(), entry.oracle_sql()
    with open(path) as f:
        cells = [line.rsplit("|", 2)[1] for line in f if line.startswith("| ") and "Queries" not in line]
    names = [n.strip() for cell in cells for n in cell.split(",") if n.strip() not in ("–", "(tests)")]
    plain = [n for n in names if "(tests)" not in n]
    assert set(plain) <= set(sql) and {n.replace(" (tests)", "") for n in names} <= set(queries)

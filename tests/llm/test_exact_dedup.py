import re
from collections import defaultdict

from pyspark.sql import functions as F

from textmill.llm import exact_dedup as E

ROWS = [(5, "a  b"), (3, "a\tb"), (9, None), (7, ""), (2, "x"), (2, "x"), (11, "a b "), (12, "long " * 50_000), (10, "long " * 50_000)]


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    return sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, rows int")


def test_groups(spark):
    out = E.exact_dedup(frame(spark, ROWS)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == expected(ROWS)
    assert sorted(r.doc_id for r in out if r.kept) == [2, 3, 7, 10, 11]  # of two equal rows with id 2, one


def test_digest_collisions_come_apart(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    weak = lambda text: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(text.cast("binary"), 256), 1, 1)))
    out = E.exact_dedup(frame(spark, rows), digest=weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == expected(rows)


def test_state_goes_on_over_batches_and_runs(spark, tmp_path):
    path, checkpoint = str(tmp_path / "landed"), str(tmp_path / "state")
    landed = E.land(frame(spark, [(i, f"text {i % 7}") for i in range(50, 90)]).repartition(4), path)
    E.seen(spark, path, landed.schema, checkpoint, files_per_trigger=1).collect()
    E.land(frame(spark, [(3, "text 3")]), path)
    out = E.seen(spark, path, landed.schema, checkpoint, files_per_trigger=1).collect()
    assert [(r.rows, r["first"].doc_id) for r in out] == [(1 + len([i for i in range(50, 90) if i % 7 == 3]), 3)]


def test_empty(spark):
    assert E.exact_dedup(frame(spark, [])).collect() == []


def test_kept_documents(spark):
    out = E.kept_documents(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "digest", "rows"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 7, 10, 11]


def test_a_store_outlives_the_run(spark, tmp_path):
    """The second run sees texts of the first, compares them at their locators, and takes collisions apart across runs."""
    weak = lambda text: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(text.cast("binary"), 256), 1, 1)))
    rows = [(i, f"text {i % 30}") for i in range(20, 60)], [(i, f"text {i % 40}") for i in range(10, 15)] + [(100, "text  25"), (101, None)]
    for name, digest in (("strong", E.sha256), ("weak", weak)):
        for k, part in enumerate(rows):
            frame(spark, part).write.parquet(str(tmp_path / f"{name}{k}"))
            out = E.exact_dedup(spark.read.parquet(str(tmp_path / f"{name}{k}")), digest=digest, store=str(tmp_path / f"store-{name}")).collect()
            known = [r for p in rows[: k + 1] for r in p]
            wanted = {x for x in expected(known) if x[0] in dict(part)}
            assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == wanted
            assert {r.doc_id for r in out if r.kept} == {i for i, keep, _ in wanted if i == keep}


def test_clashing_names_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1, 2, 3), (1, "a", "x", 1, 2, 3), (None, "a", "y", 4, 5, 6), (None, "b", "y", 4, 5, 6)], "doc_id long, text string, locator string, __file int, file0 int, _metadata int")
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in E.exact_dedup(rows).collect()) == [("1", "None", False), ("1", "None", False), ("None", "None", True), ("None", "None", True)]
    out = E.kept_documents(rows)
    assert out.columns == rows.columns and sorted((r.text, r.locator, r['__file']) for r in out.collect()) == [("a", "y", 4), ("b", "y", 4)]
    three = rows.select("doc_id", "text", F.col("locator"))
    assert E.exact_dedup(three.limit(2)).where("kept").count() == 1

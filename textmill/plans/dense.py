"""Exact vector search and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense as D
from ..operators import metrics as M

K, FLOOR = 5, 0.2


def _found(spark: SparkSession, sf_dir: str, floor: float = -1.0) -> DataFrame:
    """Every vector whose id is divisible by 20, against all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return D.top_k(rows, rows.where("id % 20 = 0"), K, floor)


_FOUND = f"""
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
pairs AS (SELECT q.id AS query_id, v.id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs QUALIFY rank <= {K})
"""


def dense_topk_floor(spark, sf_dir):
    return _found(spark, sf_dir, FLOOR).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def dense_recall_mrr(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    queries = labels.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    hits = _found(spark, sf_dir).join(labels, "id").join(queries, "query_id").where("label = query_label").groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.join(hits, "query_id", "left")
    measures = [F.round(M.recall_at(F.col("first"), K), 6).alias("recall"), F.round(M.mrr_at(F.col("first"), K), 6).alias("mrr"), F.count("*").alias("queries")]
    return rows.rollup(F.col("query_label").alias("label")).agg(*measures)


def dense_valid(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", D.valid(F.col("embedding"), 64).alias("valid"), F.round(D.dot(F.col("embedding"), F.col("embedding")), 5).alias("norm"))


def dense_floor_sweep(spark, sf_dir):
    found = _found(spark, sf_dir)
    floors = spark.createDataFrame([(x / 10,) for x in range(0, 6)], "floor double")
    return found.where("rank = 1").join(F.broadcast(floors), how="cross").groupBy("floor").agg(F.count_if(F.col("score") >= F.col("floor")).alias("above"), F.count_if(F.col("score") < F.col("floor")).alias("below"))


def _units(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as units by content hash; vectors for those that aren't divisible by 3."""
    units = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", F.sha2("text", 256).alias("hash"))
    vectors = units.where("doc_id % 3 <> 0").groupBy("hash").agg((F.min("doc_id") % 2 == 0).alias("truncated"))
    return units, vectors


_UNITS = """
WITH units AS (SELECT source, doc_id, sha256(text) AS hash FROM documents),
vectors AS (SELECT hash, min(doc_id) % 2 = 0 AS truncated FROM units WHERE doc_id % 3 <> 0 GROUP BY hash)
"""


def vector_missing(spark, sf_dir):
    units, vectors = _units(spark, sf_dir)
    return D.missing(units, vectors, "hash").select("hash").distinct()


def vector_pending(spark, sf_dir):
    return D.pending(*_units(spark, sf_dir), "hash", "doc_id")


def vector_coverage(spark, sf_dir):
    rows = D.coverage(*_units(spark, sf_dir), "source", "hash")
    return rows.withColumn("state", F.when(F.col("covered") == F.col("units"), "ready").when(F.col("covered") == 0, "not_indexed").otherwise("partial"))


def vector_upsert(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return D.upsert(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1 or vec_id % 3 = 0").withColumn("label", F.col("label") + 100), ["vec_id"])


QUERIES = {f.__name__: f for f in (dense_topk_floor, dense_recall_mrr, dense_valid, dense_floor_sweep, vector_missing, vector_pending, vector_coverage, vector_upsert)}
ORACLES = {
    "dense_topk_floor": _FOUND + f"SELECT query_id, id, rank, round(score, 6) AS score FROM found WHERE score >= {FLOOR}",
    "dense_recall_mrr": _FOUND
    + """, h AS (SELECT query_id, min(rank) AS first FROM found JOIN v ON v.id = found.id JOIN v q ON q.id = query_id WHERE q.label = v.label GROUP BY query_id)
SELECT label, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) AS queries
FROM v LEFT JOIN h ON h.query_id = v.id WHERE v.id % 20 = 0 GROUP BY ROLLUP (label)""",
    "dense_valid": "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid, round(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)), 5) AS norm FROM embeddings",
    "dense_floor_sweep": _FOUND + "SELECT f / 10 AS floor, count(*) FILTER (score >= f / 10) AS above, count(*) FILTER (score < f / 10) AS below FROM found, range(0, 6) AS r(f) WHERE rank = 1 GROUP BY f",
    "vector_missing": _UNITS + "SELECT DISTINCT hash FROM units ANTI JOIN vectors USING (hash)",
    "vector_pending": _UNITS + "SELECT hash, max(doc_id) AS doc_id FROM units ANTI JOIN vectors USING (hash) GROUP BY hash",
    "vector_coverage": _UNITS
    + """SELECT *, CASE WHEN covered = units THEN 'ready' WHEN covered = 0 THEN 'not_indexed' ELSE 'partial' END AS state FROM (
SELECT source, count(*) AS units, count(v.hash) AS covered, coalesce(sum(truncated::INT), 0)::BIGINT AS truncated FROM units LEFT JOIN vectors v USING (hash) GROUP BY source)""",
    "vector_upsert": "SELECT vec_id, CASE WHEN vec_id % 2 = 1 OR vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings",
}

"""A vector store over the vectors table: its rules, and rankings by vectors of several sources."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense as D
from ..operators import embedding as M
from ..operators import fusion
from ..operators import vectors as V
from ..sources.tables import scratch, table


def _vectors(spark, sf_dir):
    """A vector for each number, by the model m<label modulo 3>; its hash stands for a text."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.concat(F.lit("m"), F.col("label") % 3).alias("model_key"), F.sha2(F.col("vec_id").cast("string"), 256).alias("text_sha256"), F.col("embedding").alias("vector"))


def _units(spark, sf_dir):
    """Documents as units; several have the text of one number."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("course"), F.col("doc_id").alias("unit_id"), F.sha2((F.col("doc_id") % 150).cast("string"), 256).alias("text_sha256"))


def vector_put(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    old = rows.where("vec_id < 60").withColumn("text", F.lit("old"))
    new = rows.where("vec_id >= 40").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("text", F.concat(F.lit("new"), F.col("seq")))
    new = new.withColumn("vector", F.when(F.col("vec_id") % 7 == 3, F.slice("vector", 1, 63)).otherwise(F.col("vector")))
    stored, rejected = V.put(old, new, ["model_key", "text_sha256"], "seq", 64)
    return stored.select("vec_id", "text").unionByName(rejected.select("vec_id", F.concat(F.lit("rejected "), F.col("text")).alias("text")))


def model_registry(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("n")).select(F.concat(F.lit("m"), F.col("label")).alias("model_key"), F.col("n").alias("dimensions"), "label")
    old = rows.where("label < 6").select("model_key", "dimensions")
    new = rows.where("label > 3").select("model_key", F.when(F.col("label") == 5, 32).otherwise(F.col("dimensions")).alias("dimensions"))
    return V.registered(old, new)


def vectors_of_units(spark, sf_dir):
    rows = V.of_units(_units(spark, sf_dir), _vectors(spark, sf_dir), "m1")
    return rows.select("course", "unit_id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


def missing_units(spark, sf_dir):
    return V.missing_units(_units(spark, sf_dir), _vectors(spark, sf_dir), "m1").groupBy("course").agg(F.count("*").alias("units"), F.countDistinct("text_sha256").alias("texts"))


def manifest_sync(spark, sf_dir):
    rows = _units(spark, sf_dir)
    return V.synced(rows, rows.where("course in ('src2', 'src7') and unit_id % 3 = 0").withColumn("text_sha256", F.sha2("text_sha256", 256)))


def vector_purge(spark, sf_dir):
    """Other models' vectors go where the model covers all units (those of its own numbers), and stay where it doesn't."""
    vectors, units = _vectors(spark, sf_dir), _units(spark, sf_dir)
    covered = units.join(vectors.where("model_key = 'm2'").select("text_sha256"), "text_sha256", "left_semi")
    out = None
    for name, manifest in (("covered", covered), ("all", units)):
        part = V.purged(vectors, manifest, "m2").groupBy("model_key").agg(F.count("*").alias("n")).withColumn("manifest", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def other_models(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return V.has_others(rows, "m2").withColumn("after", F.lit(False)).unionByName(V.has_others(V.purged(rows, _units(spark, sf_dir).limit(0), "m2"), "m2").withColumn("after", F.lit(True)))


def coverage_states(spark, sf_dir):
    """Courses' states. src4 waits for a rebuild; texts whose hash begins with 0 have changed since; src1 and src9 have no vectors."""
    units, vectors = _units(spark, sf_dir), _vectors(spark, sf_dir).where("model_key <> 'm0'")
    units = units.where("course <> 'src5' or text_sha256 >= 'f'")
    rows = units.join(vectors.select("text_sha256", F.lit(1).alias("has")).unionByName(units.where("unit_id % 2 = 0").select("text_sha256", F.lit(1).alias("has"))).distinct(), "text_sha256", "left")
    rows = rows.withColumn("has", F.when(~F.col("course").isin("src1", "src9"), F.col("has")))
    found = rows.groupBy("course").agg(F.count("*").alias("total"), F.count("has").alias("embedded"), F.count_if(F.col("has").isNotNull() & ~F.startswith("text_sha256", F.lit("0"))).alias("current"))
    return found.select("course", "total", "embedded", F.coalesce(V.coverage_state(F.col("embedded"), F.col("total"), F.col("course") == "src4", F.col("current")), F.lit("ready")).alias("state"))


def embed_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.estimate_tokens(F.col("text")).alias("tokens"))
    return V.batches(docs, "source", "doc_id", "tokens", 8, 2048).select("doc_id", "batch", "single", "truncated")


#: Signs that the model of _embed takes.
_SIGNS = 1500


def _embed(texts: list[str], truncate: bool) -> list[list[float]]:
    """Stands for a model: four numbers of a text's hash."""
    if not truncate and any(len(t) > _SIGNS for t in texts):
        raise M.Overflow
    hashes = [hashlib.sha256(t[:_SIGNS].encode()).hexdigest() for t in texts]
    return [[int(h[i : i + 8], 16) / 2**32 for i in (0, 8, 16, 24)] for h in hashes]


def embed_incremental(spark, sf_dir):
    """Vectors of all documents, as they come in four files, each text embedded once; those that are too long are cut."""
    units = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    path, out = scratch(spark, "units"), scratch(spark, "embedded")
    units.repartition(4, "doc_id").write.parquet(path)
    stream = spark.readStream.schema(units.schema).option("maxFilesPerTrigger", 1).parquet(path)
    M.embed_stream(stream, out, scratch(spark, "embedded-state"), "hash", _embed, 4)
    vectors = M.stored(spark, out).select("text_sha256", "truncated", F.round(F.get("vector", F.lit(0)), 9).alias("first"), F.round(F.get("vector", F.lit(3)), 9).alias("last"))
    return units.select("doc_id", "text_sha256").join(vectors, "text_sha256").select("doc_id", "truncated", "first", "last")


def dense_by_source(spark, sf_dir):
    """For every twentieth vector the best eight of each of two sources (by number), fused by rank."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries, lists = rows.where("id % 20 = 0"), None
    for source in (0, 1):
        one = D.top_k(rows.where(F.col("id") % 2 == source), queries, 8, 0.0).select("query_id", "id", "rank")
        lists = one if lists is None else lists.unionByName(one)
    return fusion.fuse(lists, "id", ["query_id"]).select("query_id", "id", F.round("fused", 9).alias("fused"))


QUERIES = {f.__name__: f for f in (vector_put, model_registry, vectors_of_units, missing_units, manifest_sync, vector_purge, other_models, coverage_states, embed_batches, embed_incremental, dense_by_source)}
_V = "WITH v AS (SELECT vec_id, 'm' || (label % 3) AS model_key, sha256(vec_id::VARCHAR) AS text_sha256, embedding AS vector FROM embeddings), u AS (SELECT source AS course, doc_id AS unit_id, sha256((doc_id % 150)::VARCHAR) AS text_sha256 FROM documents)"
ORACLES = {
    "embed_incremental": f"""SELECT doc_id, length(text) > {_SIGNS} AS truncated, round(('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS first, round(('0x' || substr(h, 25, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS last
FROM (SELECT doc_id, text, sha256(left(text, {_SIGNS})) AS h FROM documents WHERE text IS NOT NULL)""",
    "vector_put": "SELECT vec_id, CASE WHEN vec_id >= 40 AND vec_id % 7 <> 3 THEN 'new2' ELSE 'old' END AS text FROM embeddings WHERE vec_id < 60 OR vec_id % 7 <> 3 UNION ALL SELECT vec_id, 'rejected new' || s FROM embeddings, unnest([1, 2]) AS t(s) WHERE vec_id >= 40 AND vec_id % 7 = 3",
    "model_registry": "SELECT 'm' || label AS model_key, max(len(embedding))::INT AS dimensions, CASE WHEN label > 5 THEN 'added' WHEN label = 5 THEN 'conflict' ELSE 'known' END AS state FROM embeddings GROUP BY label",
    "vectors_of_units": _V + " SELECT course, unit_id, round(vector[1]::DOUBLE, 6) AS first FROM u JOIN v USING (text_sha256) WHERE model_key = 'm1'",
    "missing_units": _V + " SELECT course, count(*) AS units, count(DISTINCT text_sha256) AS texts FROM u WHERE text_sha256 NOT IN (SELECT text_sha256 FROM v WHERE model_key = 'm1') GROUP BY 1",
    "manifest_sync": _V + " SELECT course, unit_id, CASE WHEN course IN ('src2', 'src7') THEN sha256(text_sha256) ELSE text_sha256 END AS text_sha256 FROM u WHERE course NOT IN ('src2', 'src7') OR unit_id % 3 = 0",
    "vector_purge": _V + " SELECT model_key, count(*) AS n, 'all' AS manifest FROM v GROUP BY 1 UNION ALL SELECT model_key, count(*), 'covered' FROM v WHERE model_key = 'm2' GROUP BY 1",
    "other_models": "SELECT true AS others, false AS after UNION ALL SELECT false, true",
    "coverage_states": _V
    + """, w AS (SELECT * FROM u WHERE course <> 'src5' OR text_sha256 >= 'f'), h AS (SELECT text_sha256 FROM v WHERE model_key <> 'm0' UNION SELECT text_sha256 FROM w WHERE unit_id % 2 = 0),
c AS (SELECT course, count(*) AS total, count(*) FILTER (has) AS embedded, count(*) FILTER (has AND NOT starts_with(text_sha256, '0')) AS cur FROM (SELECT *, course NOT IN ('src1', 'src9') AND text_sha256 IN (SELECT text_sha256 FROM h) AS has FROM w) GROUP BY 1)
SELECT course, total, embedded, CASE WHEN course = 'src4' THEN 'rebuild_needed' WHEN embedded = 0 THEN 'not_indexed' WHEN embedded < total THEN 'partial' WHEN cur < total THEN 'stale' ELSE 'ready' END AS state FROM c""",
    "embed_batches": r"""WITH d AS (SELECT doc_id, source, ceil(len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda x: x <> '')) * 2.29) > 2048 AS truncated, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents)
SELECT doc_id, batch, bool_or(truncated) OVER (PARTITION BY source, batch) AS single, truncated FROM d""",
    "dense_by_source": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.id AS query_id, v.id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, id % 2 ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0)
SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS fused FROM r WHERE rank <= 8 GROUP BY 1, 2""",
}

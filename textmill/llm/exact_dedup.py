"""Exact dedup by a stateful stream.

1. land(): each row becomes (doc_id, digest, locator) in a small table. The locator says where the row's bytes are: file
   and row of the Parquet table it came from.
2. seen(): a Structured Streaming query over that table keeps, by digest, the number of rows and the smallest
   (doc_id, locator). Its state is in RocksDB, on disk, checkpointed to the shared folder, and has no watermark: nothing
   expires, so a later run with the same store goes on where this one ended.
3. checked(): digests with several rows are hits. Their whole texts are grouped by digest and text, so that equal digests
   of different texts come apart. Texts of earlier runs are read at their locators, by texts_at().

Counts are combined before each shuffle, so a group that holds a third of all rows sends one row per task. The last join
by digest carries no text; Spark splits its skewed partitions.

Defined results: a null text is an empty one; empty texts are equal to each other. A null doc_id is smaller than all others. Of
rows with the same doc_id and the same text, the one with the smaller locator stays. Tables without rows give none. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, new_path, saved, table

#: State on disk. Each partition has a store of its own; without fallocate a small one takes little disk.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # what the stores of an executor hold in memory together, however many partitions it has
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Hit digests that a task may hold as a hash table (8 bytes each); with more of them the join shuffles.
BROADCAST_HITS = 1_000_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _traced(docs: DataFrame) -> bool:
    """Whether docs still say which file and row of a Parquet table each row comes from."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return "_metadata" not in docs.columns


def with_locator(docs: DataFrame) -> DataFrame:
    """doc_id, text and locator. Rows that come from no Parquet table are written to one first."""
    if not _traced(docs):
        docs = saved(docs.select("doc_id", "text"), "documents")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def land(docs: DataFrame, path: str, digest=sha256) -> DataFrame:
    """doc_id, digest and locator of each row, appended to the table at path."""
    return _land(with_locator(docs), path, digest)


def _land(located: DataFrame, path: str, digest) -> DataFrame:
    rows = located.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), "locator")
    rows.write.mode("append").option("compression", "zstd").parquet(path)
    return located.sparkSession.read.schema(rows.schema).parquet(path)


def seen(spark: SparkSession, landed: str, schema, checkpoint: str | None = None, files_per_trigger: int = 10_000) -> DataFrame:
    """digest, rows, first (doc_id and locator): what the stream's state holds when all at landed has passed.

    With the checkpoint of an earlier run only files that are new since then pass, and only digests they touch come out.
    """
    out = new_path(spark, "seen")
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landed)
        state = stream.groupBy("digest").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "locator")).alias("first"))

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint or new_path(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    # a digest has a row for each batch that changed it; both values only move one way
    return spark.read.schema(state.schema).parquet(out).groupBy("digest").agg(F.max("rows").alias("rows"), F.min("first").alias("first"))


def checked(located: DataFrame, hits: DataFrame, digest=sha256, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """digest, norm, rows, first: the hits' groups by their whole normalised texts. located: as with_locator() gives them."""
    keys = hits.select(F.xxhash64("digest").alias("near"))
    if hits.count() <= broadcast_hits:
        keys = F.broadcast(keys)
    rows = located.withColumn("norm", normalised(F.col("text"))).withColumn("digest", digest(F.col("norm")))
    rows = rows.withColumn("near", F.xxhash64("digest")).join(keys, "near", "left_semi")
    return rows.groupBy("digest", "norm").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "locator")).alias("first"))


def texts_at(spark: SparkSession, locators: DataFrame) -> DataFrame:
    """locator (with the columns beside it) and text, read from the files that the locators name. Their names pass the driver, no rows do."""
    files = [r.file for r in locators.select("locator.file").distinct().toLocalIterator()]
    if not files:
        return locators.withColumn("text", F.lit(None).cast("string"))
    rows = spark.read.parquet(*files).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"), "text")
    return rows.join(locators, "locator")


def exact_dedup(docs: DataFrame, digest=sha256, files_per_trigger: int = 10_000, store: str | None = None) -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, digest, locator, keep_locator.

    store: a folder in which digests and state outlive the run. A later run with it, over new rows, counts those of all runs; a row
    whose text an earlier run holds goes, with the earlier one's id as keep_id if that is smaller. Full bytes are then
    compared with the text at the earlier row's locator, whose table must still be there.
    """
    spark = docs.sparkSession
    docs = with_locator(docs)
    path = new_path(spark, "digests") if store is None else f"{store}/digests/{uuid.uuid4().hex}"
    landed = _land(docs, path, digest)
    source, checkpoint = (path, None) if store is None else (f"{store}/digests/*", f"{store}/state")
    state = saved(seen(spark, source, landed.schema, checkpoint, files_per_trigger=files_per_trigger), "groups")
    hits = state.where("rows > 1")
    texts = checked(docs, hits.select("digest"), digest).select("digest", "norm")
    if store is not None:
        before = hits.select("digest", F.col("first.locator").alias("locator")).join(landed.select("locator"), "locator", "left_anti")
        texts = texts.unionByName(texts_at(spark, saved(before, "before")).select("digest", normalised(F.col("text")).alias("norm"))).distinct()
    apart = saved(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "apart")
    if store is not None:  # digests that came apart once stay apart
        apart.write.mode("append").parquet(f"{store}/apart")
        apart = saved(spark.read.schema(apart.schema).parquet(f"{store}/apart").join(state, "digest", "left_semi").distinct(), "apart")
    plain = landed.join(hits, "digest", "left").select("doc_id", "digest", "locator", F.coalesce("rows", F.lit(1)).alias("group_size"), F.coalesce("first", F.struct("doc_id", "locator")).alias("first"))
    if not apart.isEmpty():
        # different texts under one digest: these rows take their group from their own text, among all that ever landed
        every = docs if store is None else texts_at(spark, spark.read.schema(landed.schema).parquet(source).join(apart, "digest", "left_semi").select("doc_id", "locator")).select("doc_id", "text", "locator")
        own = docs.withColumn("norm", normalised(F.col("text"))).withColumn("digest", digest(F.col("norm")))
        own = own.join(checked(every, apart, digest).join(apart, "digest", "left_semi"), ["digest", "norm"])
        plain = plain.join(apart, "digest", "left_anti").unionByName(own.select("doc_id", "digest", "locator", F.col("rows").alias("group_size"), "first"))
    return plain.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.struct("doc_id", "locator").eqNullSafe(F.col("first")).alias("kept"),
        "digest",
        "locator",
        F.col("first.locator").alias("keep_locator"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns. Rows are found again by locator, so repeated rows and null ids come apart."""
    columns = docs.columns
    if not _traced(docs):
        given = docs.toDF(*[f"c{n}" for n in range(len(columns))])  # no name of them clashes
        docs = saved(given, "documents")
        docs = docs.withColumnsRenamed({f"c{n}": c for n, c in enumerate(columns) if c != "_metadata"})
    file, row = free_name(docs, "file"), free_name(docs, "row")
    located = docs.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    gone = exact_dedup(docs).where("not kept").select(F.col("locator.file").alias(file), F.col("locator.row").alias(row))
    out = located.join(gone, [file, row], "left_anti").drop(file, row)
    return out.toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

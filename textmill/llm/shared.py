"""Folders and small readers that every operator of this subpackage uses."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are worked on in blocks of about so many bytes, which bounds a Python worker's memory.
BLOCK_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. It has to be set but where all run on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def without_intermediates(spark: SparkSession, result, name: str) -> tuple[DataFrame, str]:
    """result(), saved, and its path. The tables that were written on the way are deleted then, as nothing reads them any more."""
    _scopes.append([])
    try:
        out = saved(result(), name)
        *between, path = _scopes[-1]
    finally:
        _scopes.pop()
    remove(spark, between)
    return out, path


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, prefix: str) -> str:
    """A name that no column of docs has, however it is written: Spark finds columns without regard to case."""
    taken = {c.lower() for c in docs.columns}
    return next(c for c in (f"{prefix}{n}" for n in range(len(taken) + 1)) if c not in taken)


#: Stands for a null doc_id.
LOWEST = -(1 << 63)
#: Repeated doc_ids that tasks may hold; with more of them the join with them shuffles.
BROADCAST_IDS = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """id, sub, text: id is doc_id (LOWEST where it is null); sub is 0, but for ids that several rows have a hash of the text.

    So (id, sub) tells documents apart: rows of one doc_id with other texts are documents of their own, in order of that hash, and
    rows with one doc_id and one text are the same document, with the same results.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), F.col("text").cast("string").alias("text"))
    again = saved(rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id", F.lit(True).alias("again")), "again")
    n = again.count()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("sub"), "text")
    rows = rows.join(F.broadcast(again) if n <= BROADCAST_IDS else again, "id", "left")
    return rows.select("id", F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long")).alias("sub"), "text")


def doc_id() -> Column:
    """doc_id of a keyed row."""
    return F.when(F.col("id") != LOWEST, F.col("id")).alias("doc_id")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its rows. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def blocks(at: np.ndarray, size: int = BLOCK_BYTES):
    """Ranges of rows (first, after last) of about size bytes; a longer row has a block to itself."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j

"""Vectors of texts by a model behind a callable, batch by batch, so that a run that breaks goes on where it was."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 32
VECTORS = "model_key string, text_sha256 string, vector array<double>, truncated boolean"
#: (texts, truncate) to vectors. Raises Overflow if a text is too long and may not be cut.
Embedder = Callable[[list[str], bool], list[list[float]]]


class Overflow(Exception):
    """A text is longer than the model takes."""


def _checked(vectors: list[list[float]], n: int, dimensions: int) -> list[list[float]]:
    if len(vectors) != n or any(len(v) != dimensions or not all(map(math.isfinite, v)) for v in vectors):
        raise ValueError(f"the model gave something else than {n} vectors of {dimensions} finite numbers")
    return [list(map(float, v)) for v in vectors]


def batch_vectors(texts: list[str], embed: Embedder, dimensions: int) -> Iterator[tuple[list[float], bool]]:
    """Vector of each text, and whether it was cut. Where a batch overflows its texts go one by one, and only those that overflow by themselves are cut."""
    try:
        yield from ((v, False) for v in _checked(embed(texts, False), len(texts), dimensions))
    except Overflow:
        for text in texts:
            try:
                yield _checked(embed([text], False), 1, dimensions)[0], False
            except Overflow:
                yield _checked(embed([text], True), 1, dimensions)[0], True


def embedded(units: DataFrame, model_key: str, embed: Embedder, dimensions: int, size: int = BATCH) -> DataFrame:
    """A vector for each row of units (text_sha256, text), in batches of `size` within tasks."""

    def of(parts):
        held: list[tuple[str, str]] = []

        def batch():
            rows = [(model_key, h, v, cut) for (h, _), (v, cut) in zip(held, batch_vectors([t for _, t in held], embed, dimensions), strict=True)]
            held.clear()
            return pd.DataFrame(rows, columns=["model_key", "text_sha256", "vector", "truncated"])

        for part in parts:
            for row in zip(part["text_sha256"], part["text"], strict=True):
                held.append(row)
                if len(held) == size:
                    yield batch()
        if held:
            yield batch()

    return units.select("text_sha256", "text").mapInPandas(of, VECTORS)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The vectors in a store, with the number of the batch that they came in; a folder that isn't there has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], VECTORS + ", batch long")
    return spark.read.schema(VECTORS + ", batch long").option("basePath", path).parquet(path)


def embed_stream(units: DataFrame, path: str, checkpoint: str, model_key: str, embed: Embedder, dimensions: int, progress: Callable[[int, int], None] | None = None, size: int = BATCH) -> None:
    """All units that are there and have no vector by the model yet, to a store. units: a stream of text_sha256, text.

    Each batch of the stream is a folder of the store, written as a whole: what a broken run has written stays, and the next one with its checkpoint starts with
    the batch that broke. Texts that have a vector, in whatever batch, aren't given to the model again. progress: called with a batch's number and its new vectors.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        have = stored(spark, path).where((F.col("model_key") == model_key) & (F.col("batch") != number)).select("text_sha256")
        pending = batch.dropDuplicates(["text_sha256"]).join(have, "text_sha256", "left_anti")
        embedded(pending, model_key, embed, dimensions, size).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if progress:
            progress(number, spark.read.parquet(f"{path}/batch={number}").count())

    units.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def coverage(units: DataFrame, vectors: DataFrame, by: str) -> DataFrame:
    """by, total, embedded, truncated: every unit counts, also those of one text. vectors: of one model."""
    rows = units.join(vectors.select("text_sha256", "truncated"), "text_sha256", "left").groupBy(by)
    return rows.agg(F.count("*").alias("total"), F.count("truncated").alias("embedded"), F.count_if("truncated").alias("truncated"))

"""Streams over append-only logs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold for what is started inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def latest_states(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A streaming table of each key's last value and number of events. State is kept by key, without expiry."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("events"))


def activity(events: DataFrame, key: str, time: str, width: str, delay: str) -> DataFrame:
    """Events of each key by tumbling windows; rows later than `delay` are left out."""
    rows = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Events of each key with no gap of that length between them."""
    rows = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, to a Parquet table; each batch is a folder that a repeated batch overwrites."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Places of rows within keys of any size.

A window over a key puts all its rows in one task. Here rows are dealt out by ranges of (key, order), so a key with many rows lies in several tasks; each numbers
what it has, and what the tasks before have of the same key is added, of which there is a line for each task at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table, read again: what is worked out from them twice agrees."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def positions(rows: DataFrame, key: list[str], *order: Column | str, total: str | None = None) -> DataFrame:
    """rows with place (from 1) and count, and with a column to add up its running sum, upto, in the order of each key. order: unique in it."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = rows.sparkSession
    dealt = written(rows.repartitionByRange(*(F.col(c) for c in key), *order).withColumn("__part", F.spark_partition_id()), "ranks")
    amount = F.lit(0) if total is None else F.col(total)
    own = Window.partitionBy("__part", *key)
    dealt = dealt.withColumns({"place": F.row_number().over(own.orderBy(*order)).cast("long"), "count": F.count("*").over(own), "upto": F.sum(amount).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))})
    parts = dealt.groupBy("__part", *key).agg(F.count("*").alias("__n"), F.sum(amount).alias("__sum"))
    # keys in several parts: a part has two of them at most, its first and its last
    several = Window.partitionBy(*key)
    before = several.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.withColumn("__first", F.row_number().over(Window.partitionBy("__part").orderBy(*key))).withColumn("__last", F.row_number().over(Window.partitionBy("__part").orderBy(*(F.desc(c) for c in key))))
    ends = ends.where("__first = 1 or __last = 1").withColumn("__parts", F.count("*").over(several)).where("__parts > 1")
    carried = ends.select("__part", *key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(several).alias("__all"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__upto"))
    carried = spark.createDataFrame(carried.collect(), carried.schema)  # two lines a task at most
    on = [dealt["__part"] == carried["__part"], *(dealt[c].eqNullSafe(carried[c]) for c in key)]
    out = dealt.join(F.broadcast(carried), on, "left").select(
        *(dealt[c] for c in rows.columns), (F.col("place") + F.coalesce("__before", F.lit(0))).alias("place"), F.coalesce("__all", "count").alias("count"), (F.col("upto") + F.coalesce("__upto", F.lit(0))).alias("upto")
    )
    return out if total is not None else out.drop("upto")

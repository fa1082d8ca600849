"""Rank fusion, budgets and pools over ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """rank from 1 in each list."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def fuse(lists: DataFrame, id_column: str, per: list[str] | None = None, weight: Column | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the lists that hold an id. lists: id, rank, [weight]."""
    gain = (F.lit(1.0) if weight is None else weight) / (F.lit(k) + F.col("rank"))
    return lists.groupBy(*(per or []), id_column).agg(F.sum(gain).alias("fused"))


def native_score(lists: DataFrame, id_column: str) -> DataFrame:
    """The score an id has in the first list that holds it. lists: id, list_no, score."""
    return lists.groupBy(id_column).agg(F.min_by("score", "list_no").alias("score"))


def cut_to_budget(rows: DataFrame, budget: int, words: str, by: list[str], *order) -> DataFrame:
    """Rows in order while the running sum of words is within the budget; the first that exceeds it ends the list."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(words).over(w)).where(F.col("used") <= budget)


def pool(lists: DataFrame, id_column: str, n: int, per: list[str], seed: int = 0) -> DataFrame:
    """The first n of each list, each id once, in an order that gives no list away."""
    rows = lists.where(F.col("rank") <= n).select(*per, id_column).distinct()
    return rows.withColumn("place", F.sha2(F.concat_ws(":", F.lit(str(seed)), *per, id_column), 256))


def merge_verdicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The vote of the last file that has one for the keys."""
    return rows.groupBy(*keys).agg(F.max_by("vote", "file_no").alias("vote"))

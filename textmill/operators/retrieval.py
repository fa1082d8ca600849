"""Retrieval by vectors where they cover all of a course as it is, and by keywords elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion
from .vectors import coverage_state

DENSE, KEYWORDS = "dense", "bm25"
#: Passages of each list that are fused.
CANDIDATES = 50


def routes(units: DataFrame, vectors: DataFrame, by: str, rebuild: Column | None = None) -> DataFrame:
    """by, total, embedded, mode, reason: how each course is searched, and why not by vectors.

    units: by, indexed (hash of the text that its manifest names), text_sha256 (of the text as it is now); vectors: text_sha256, of one model. rebuild: whether the
    course's vectors wait for a rebuild.
    """
    have = vectors.select("text_sha256").distinct()
    rows = units.join(have.select(F.col("text_sha256").alias("indexed"), F.lit(1).alias("has")), "indexed", "left").join(have.select("text_sha256", F.lit(1).alias("now")), "text_sha256", "left")
    found = rows.groupBy(by).agg(F.count("*").alias("total"), F.count("has").alias("embedded"), F.count("now").alias("current"))
    reason = coverage_state(F.col("embedded"), F.col("total"), F.lit(False) if rebuild is None else rebuild, F.col("current"))
    return found.select(by, "total", "embedded", F.when(reason.isNull(), DENSE).otherwise(KEYWORDS).alias("mode"), reason.alias("reason"))


def best(hits: DataFrame, by: str, kind: str, *order: Column | str, n: int = CANDIDATES) -> DataFrame:
    """hits with rank: the first n of each course's list of each kind. Tasks send no more than that of a list."""
    return fusion.ranked(hits, [by, kind], *order).where(F.col("rank") <= n)


def retrieved(told: DataFrame, dense: DataFrame, keywords: DataFrame, by: str, id_columns: list[str], words: str, budget: int) -> DataFrame:
    """by, mode, reason, id_columns, fused, used: each course's passages in order, from its own kind of lists, up to a budget of words.

    told: routes(); dense, keywords: by, id_columns, words and rank in several lists.
    """
    lists = dense.select(by, *id_columns, words, "rank", F.lit(DENSE).alias("mode")).unionByName(keywords.select(by, *id_columns, words, "rank", F.lit(KEYWORDS).alias("mode")))
    lists = lists.join(told.select(by, "mode", "reason"), [by, "mode"])
    fused = lists.groupBy(by, "mode", "reason", *id_columns).agg(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))).alias("fused"), F.max(words).alias(words)).withColumn("fused", F.round("fused", 9))
    # a course has a few lists of CANDIDATES passages here
    return fusion.cut_to_budget(fused, budget, words, [by], F.desc("fused"), *id_columns)

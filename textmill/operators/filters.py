"""Predicates and narrowing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import positions

#: Similarity of an edit that is worth a suggestion, and from which it is applied.
SUGGESTED, APPLIED = 0.5, 0.6


def near_miss(reason: Column, similarity: Column, not_alike: str) -> Column:
    """Whether an edit was rejected as not alike, but by little."""
    return (reason == not_alike) & F.coalesce((similarity >= SUGGESTED) & (similarity < APPLIED), F.lit(False))


def projected(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Only the fields that may be exported, as far as there are such."""
    return rows.select(*[f for f in fields if f in rows.columns])


def final_answers(answers: Column) -> Column:
    """Of an attempt's answers (kind, status) those that won't change: chosen ones, and open ones that have been judged."""
    return F.filter(answers, lambda a: (a["kind"] != "N") | (a["status"] == "F"))


def members(rows: DataFrame, label: Column, courses: DataFrame, course: str) -> DataFrame:
    """The rows whose label's key is the key of one of the courses. Labels without a key match nothing."""
    keys = courses.select(T.label_key(F.col(course)).alias("__key")).where("__key <> ''").distinct()
    return rows.withColumn("__key", T.label_key(label)).join(keys, "__key", "left_semi").drop("__key")


def selected(rows: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """The rows of a selection; an empty one selects all."""
    empty = selection.limit(1).agg((F.count("*") == 0).alias("__all"))
    chosen = selection.select(key).distinct().withColumn("__chosen", F.lit(True))
    return rows.join(chosen, key, "left").join(F.broadcast(empty), how="cross").where("__all or __chosen").drop("__all", "__chosen")  # one row


def text_status(page: Column, least: int) -> Column:
    """As an aggregate over a document's pages: ready, or ready_no_text where over half of them hold less than `least` characters, or there is none."""
    return F.when(F.coalesce(F.avg((F.length(page) < least).cast("int")), F.lit(1)) > 0.5, "ready_no_text").otherwise("ready")


def limit_faults(members: DataFrame, package: str, order: str, ratio: float, total: int) -> DataFrame:
    """Members with a fault: ratio where one expands more than so many times, total from where a package holds more bytes. members: size, packed."""
    # a package may have any number of members
    placed = positions(members, [package], order, total="size")
    fault = F.when(F.col("size") / F.col("packed") > ratio, "ratio").when(F.col("upto") > total, "total")
    return placed.withColumn("fault", fault).where("fault is not null").drop("place", "count", "upto")

"""A store of vectors: rows of model_key, text_sha256 and vector, and a manifest of each course's units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import valid
from .ranks import positions


def registered(models: DataFrame, new: DataFrame) -> DataFrame:
    """model_key, dimensions, state: known models stay as they are, absent ones are added; another number of dimensions is a conflict.

    models, new: model_key, dimensions.
    """
    rows = models.select("model_key", F.col("dimensions").alias("old")).join(new.select("model_key", F.col("dimensions").alias("new")), "model_key", "full")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNotNull() & (F.col("new") != F.col("old")), "conflict").otherwise("known")
    return rows.select("model_key", F.coalesce("old", "new").alias("dimensions"), state.alias("state"))


def put(old: DataFrame, new: DataFrame, keys: list[str], order: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """The store with new's rows in place of those with their keys, of several the last by `order`; and the rows whose vector isn't valid."""
    good = valid(F.col("vector"), dimensions)
    last = new.where(good).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n", order)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last), new.where(~F.coalesce(good, F.lit(False)))


def of_units(units: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Each unit with its vector by a model. units: unit_id, text_sha256."""
    return units.join(vectors.where(F.col("model_key") == model).select("text_sha256", "vector"), "text_sha256")


def missing_units(units: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Every unit without a vector by a model; units with one text all count."""
    return units.join(vectors.where(F.col("model_key") == model).select("text_sha256"), "text_sha256", "left_anti")


def synced(manifest: DataFrame, units: DataFrame) -> DataFrame:
    """The manifest with the units of their courses in place of what these had. Both: course, unit_id, text_sha256."""
    return manifest.join(units.select("course").distinct(), "course", "left_anti").unionByName(units)


def purged(vectors: DataFrame, manifest: DataFrame, model: str) -> DataFrame:
    """Vectors without those of other models, if the model has all of the manifest; else all of them."""
    lacking = missing_units(manifest, vectors, model).limit(1).agg((F.count("*") == 0).alias("complete"))
    return vectors.join(F.broadcast(lacking), how="cross").where(~F.col("complete") | (F.col("model_key") == model)).drop("complete")  # one row


def has_others(vectors: DataFrame, model: str) -> DataFrame:
    """others: whether the store has vectors of other models."""
    return vectors.where(F.col("model_key") != model).limit(1).agg((F.count("*") > 0).alias("others"))


def coverage_state(embedded: Column, total: Column, rebuild: Column, current: Column) -> Column:
    """Why a course can't be searched by vectors: the store must be rebuilt, nothing or not all is embedded, or texts have changed since; null if it can."""
    return F.when(rebuild, "rebuild_needed").when(embedded == 0, "not_indexed").when(embedded < total, "partial").when(current < total, "stale")


def batches(units: DataFrame, course: str, order: str, tokens: str, size: int, capacity: int) -> DataFrame:
    """batch, single and truncated of each unit: batches of `size` in order; where a batch holds a unit over `capacity` its units go one by one,
    and those over it are cut."""
    placed = positions(units, [course], order)  # a course may have any number of units
    rows = placed.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("place", "count")
    cut = F.col(tokens) > capacity
    return rows.withColumn("truncated", cut).withColumn("single", F.max("truncated").over(Window.partitionBy(course, "batch")))

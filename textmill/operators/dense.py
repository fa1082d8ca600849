"""Exact dense retrieval.

Queries are a stated set of rows. Both sides are packed into blocks; every block of queries meets every block of vectors in
some task, which keeps the best k of each query by one matrix product. What is shuffled after that is k rows a query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, VECTOR_BLOCK = 512, 8192
#: Bytes of a block's numbers: with many dimensions a block has fewer rows.
BLOCK_BYTES = 16 << 20


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def valid(vector: Column, dimensions: int) -> Column:
    """Of the right length, and all its values finite."""
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def _packed(rows: DataFrame, name: str, n: int, size: int) -> DataFrame:
    """Rows (id, vector) as blocks of about `size`."""
    blocks = max(1, -(-n // size))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    return rows.select("id", "vector", block).groupBy("block").agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("vector")).alias(f"{name}_values")).drop("block")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, floor: float = -1.0, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, id, score, rank: for each query its k nearest others by the dot product, at least `floor`; ties by id.

    vectors, queries: id, vector.
    """
    n, wide = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, wide)))
    left = _packed(queries, "query", queries.count(), min(query_block, most))
    right = _packed(vectors, "vector", n, min(vector_block, most))

    def best(batches):
        for b in batches:
            for q_ids, q, v_ids, v in zip(*(b.column(c) for c in ("query_ids", "query_values", "vector_ids", "vector_values")), strict=True):
                qi, vi = np.array(q_ids.as_py()), np.array(v_ids.as_py())
                x = q.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(qi), -1)
                y = v.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vi), -1)
                s = x @ y.T
                s[qi[:, None] == vi[None, :]] = -np.inf
                for i, row in enumerate(s):
                    keep = np.flatnonzero(row >= max(floor, np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf))
                    keep = keep[np.isfinite(row[keep])]
                    keep = keep[np.lexsort((vi[keep], -row[keep]))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), qi[i])), pa.array(vi[keep]), pa.array(row[keep])], names=["query_id", "id", "score"])

    found = left.join(right, how="cross").mapInArrow(best, "query_id long, id long, score double")  # blocks with blocks
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def missing(units: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Units without a vector."""
    return units.join(vectors.select(key), key, "left_anti")


def pending(units: DataFrame, vectors: DataFrame, key: str, order: str) -> DataFrame:
    """Of the units without a vector, the last one of each key."""
    return missing(units, vectors, key).groupBy(key).agg(F.max(order).alias(order))


def coverage(units: DataFrame, vectors: DataFrame, group: str, key: str) -> DataFrame:
    """group, units, covered, truncated."""
    joined = units.join(vectors.select(key, F.lit(1).alias("has"), F.col("truncated").cast("int").alias("cut")), key, "left")
    return joined.groupBy(group).agg(F.count("*").alias("units"), F.count("has").alias("covered"), F.coalesce(F.sum("cut"), F.lit(0)).alias("truncated"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)

"""Quality by importance resampling.

Two generative models over hashed word unigrams and bigrams: one of the target (documents labelled good), one of all
documents. A document's log weight is the log of the ratio of its probabilities under them, put to a text of `effective`
n-grams, so that long and short texts compare. Adding Gumbel noise to the log weights and keeping the k largest draws k documents
without replacement in proportion to their weights. k is the share of labelled documents with quality 1, of all documents.

The target is a bounded sample: up to `target_rows` good documents, the ones with the smallest hashed doc_id. Counts of the
raw model cover every n-gram of every document; tasks add them up in tables of a fixed size. The k-th largest key is found by
narrowing histograms, exactly and without a sort.

Defined results: a null text has no n-grams and weight 0 (as probable under both models), as empty ones have. Rows with
one doc_id share their noise, as do those without one. Where rows tie with the k-th key all of them are kept, so kept rows can outnumber k. Without
labels, or without good ones, all weights are 0, and without labels all rows are kept. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix, words
from .shared import blocks, saved, table, utf8

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
#: Added to the counts of both models once they are put to the same total.
ADDED = 8.0
EFFECTIVE = 200.0
SEED = 13


def grams(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each unigram and bigram of rows that lie end to end."""
    _, _, h, cuts = words(data, at, lower=True)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    pair = mix(h[1:] * np.uint64(3) + h[:-1])[row[1:] == row[:-1]] if len(h) > 1 else h[:0]
    return (np.concatenate([h, pair]) % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[1:][row[1:] == row[:-1]]])


def models(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """docs: text, target (boolean). Counts of each bucket in the target and in all."""

    def count(batches):
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            data, at = utf8(b.column("text"))
            good = b.column("target").to_numpy(zero_copy_only=False)
            for i, j in blocks(at):
                bucket, row = grams(data[at[i] : at[j]], at[i : j + 1] - at[i], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[i:j][row].astype(bool)], minlength=buckets)
        found = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(target[found]), pa.array(raw[found])], names=["bucket", "target", "raw"])

    rows = docs.select("text", "target").mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r in rows.collect():  # a row for each bucket at most
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    return target, raw


def ratios(target: np.ndarray, raw: np.ndarray, added: float = ADDED) -> np.ndarray:
    """Log ratio of the two models for each bucket."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + added) / (raw * target.sum() / raw.sum() + added))


def weights(docs: DataFrame, log_ratio: np.ndarray, effective: float = EFFECTIVE) -> DataFrame:
    """doc_id, n_grams, log_weight."""

    def of(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at):
                bucket, row = grams(data[at[i] : at[j]], at[i : j + 1] - at[i], len(log_ratio))
                n = np.bincount(row, minlength=j - i)
                total = np.bincount(row, weights=log_ratio[bucket], minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(effective * total / np.maximum(n, 1))], names=["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_grams long, log_weight double")


def gumbel(seed: int):
    """Standard Gumbel noise, a function of doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest of a column of longs; None for k < 1 or fewer rows than k."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    above = 0  # rows over high
    while low < high:
        step = -(-(high - low + 1) // bins)
        held = keys.where(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - {low}L) div {step}L").alias("bin")).count()
        for b, count in sorted(held.collect(), reverse=True):
            if above + count >= k:
                low, high = low + b * step, min(high, low + (b + 1) * step - 1)
                break
            above += count
    return low


def resample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept."""
    labels = labels.select("doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
    labelled, good = labels.agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    chosen = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(target_rows)
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("target", F.lit(True))), "doc_id", "left")
    log_ratio = ratios(*models(marked.withColumn("target", F.coalesce("target", F.lit(False))), buckets))
    scored = weights(docs, log_ratio).withColumn("gumbel_key", F.col("log_weight") + gumbel(seed)).withColumn("order", F.floor(F.col("gumbel_key") * float(1 << 32)))
    scored = saved(scored, "weights")
    rows = scored.count()
    least = kth_largest(scored, "order", round(rows * good / labelled)) if labelled else None
    kept = F.lit(True) if not labelled else F.col("order") >= least if least is not None else F.lit(False)
    return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Retrieval, classification and word error measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def first_rank(hits: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """query, first: the rank of the first hit that is relevant; null where none is. gold: one row for each relevant pair."""
    found = hits.join(gold.select(query, item).distinct(), [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("first"))
    return gold.select(query).distinct().join(found, query, "left")


def first_of_label(hits: DataFrame, labels: DataFrame, query: str, item: str) -> DataFrame:
    """first_rank() where what has the query's label is relevant; queries whose label nothing else has are left out. labels: item, label. No pairs of one label are made."""
    others = labels.groupBy("label").agg((F.count("*") > 1).alias("several"))
    own = labels.select(F.col(item).alias(query), "label").join(others.where("several"), "label").select(query, "label")
    asked = own.join(hits.select(query).distinct(), query, "left_semi")
    found = hits.join(labels, item).join(own.withColumnRenamed("label", "wanted"), query).where("label = wanted").groupBy(query).agg(F.min("rank").alias("first"))
    return asked.select(query).join(found, query, "left")


def paired(a: DataFrame, b: DataFrame, query: str, k: int) -> DataFrame:
    """Queries that each of two runs wins, loses or shares by whether a relevant hit is among the first k."""
    rows = a.select(query, (F.col("first") <= k).alias("x")).join(b.select(query, (F.col("first") <= k).alias("y")), query)
    x, y = F.coalesce("x", F.lit(False)), F.coalesce("y", F.lit(False))
    return rows.agg(F.count_if(x & ~y).alias("wins"), F.count_if(~x & y).alias("losses"), F.count_if(x == y).alias("ties"))


def precision(rows: DataFrame, by: list[str], predicted: Column, correct: Column) -> DataFrame:
    """labelled, right and precision (null where nothing is labelled) of each group's predictions; unlabelled rows don't count."""
    labelled = predicted & correct.isNotNull()
    return rows.groupBy(*by).agg(
        F.count_if(labelled).alias("labelled"), F.count_if(labelled & correct).alias("right"), F.try_divide(F.count_if(labelled & correct), F.count_if(labelled)).alias("precision"), F.count_if(predicted & correct.isNull()).alias("unlabelled")
    )


def recall_at(first: Column, k: int) -> Column:
    """Share of queries whose first relevant hit is among the first k; 0 for no queries."""
    return F.coalesce(F.avg(F.when(first <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mrr_at(first: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(first <= k, 1.0 / first).otherwise(0.0)), F.lit(0.0))


def recall(rows: DataFrame, by: list[str], predicted: Column, correct: Column) -> DataFrame:
    """correct, found and recall (null where nothing is correct) of each group and of all rows, by rollup; unlabelled rows don't count."""
    return rows.rollup(*by).agg(F.count_if(correct).alias("correct"), F.count_if(predicted & correct).alias("found"), F.try_divide(F.count_if(predicted & correct), F.count_if(correct)).alias("recall"))


def word_errors(rows: DataFrame) -> DataFrame:
    """id, words, substitutions, deletions, insertions: of hypothesis against reference, both made comparable.

    Of the alignments with the fewest errors the one with the fewest substitutions counts. A row without reference words has nulls.
    """
    rows = rows.select("id", F.split(T.comparable(F.col("reference")), " ").alias("r"), F.split(T.comparable(F.col("hypothesis")), " ").alias("h"))

    def of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), *_errors(b.column("r"), b.column("h"))], names=["id", "words", "substitutions", "deletions", "insertions"])

    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, words long, substitutions long, deletions long, insertions long")


#: Numbers in a row of the tables of alignments that are worked out together.
CELLS = 1 << 16


def _coded(lists: pa.Array, codes: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words that aren't empty, each list's first one's place, and how many it has."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    n = np.bincount(np.repeat(np.arange(len(n)), n)[filled], minlength=len(n))
    return codes[filled], np.cumsum(n) - n, n


def _errors(r: pa.Array, h: pa.Array) -> list[pa.Array]:
    """words, substitutions, deletions, insertions of each pair of lists. Pairs of like lengths are aligned together."""
    words, of_r = [r.flatten(), h.flatten()], len(r.flatten())
    coded = pa.concat_arrays(words).dictionary_encode()
    codes, filled = coded.indices.to_numpy(), np.concatenate([pc.not_equal(w, "").to_numpy(zero_copy_only=False) for w in words]).astype(bool)
    x, at_x, n = _coded(r, codes[:of_r], filled[:of_r])
    y, at_y, m = _coded(h, codes[of_r:], filled[of_r:])
    total, substituted = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    order, begin = np.lexsort((m, n // 4)), int(np.count_nonzero(n == 0))
    order = np.concatenate([order[n[order] == 0], order[n[order] > 0]])  # lists without words first
    while begin < len(order):
        some = order[begin : begin + max(1, CELLS // (int(m[order[begin]]) + 1))]
        some = some[: max(1, CELLS // (int(m[some].max()) + 1))]
        begin += len(some)
        some = some[np.argsort(-n[some], kind="stable")]
        total[some], substituted[some] = _aligned(_padded(x, at_x[some], n[some], -1), n[some], _padded(y, at_y[some], m[some], -2), m[some])
    deleted = (total - substituted + n - m) // 2
    none = n == 0
    return [pa.array(n.astype(np.int64)), *(pa.array(c, pa.int64(), mask=none) for c in (substituted, deleted, total - substituted - deleted))]


def _padded(codes: np.ndarray, first: np.ndarray, n: np.ndarray, rest: int) -> np.ndarray:
    """A column for each list."""
    place = np.arange(n.max(initial=0))[:, None]
    inside = place < n
    out = np.full(inside.shape, rest, np.int32)
    out[inside] = codes[(first + place)[inside]]
    return out


def _aligned(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors and substitutions of each column's words y against x, n falling. Row by row along the reference; an error costs `one`, a substitution 1 more.

    Rows hold the cost less that of inserting all of y up to there, so insertions inside a row are a running minimum.
    """
    kind, one = (np.int32, 1 << 16) if len(x) + len(y) < 1 << 14 else (np.int64, 1 << 32)
    row = np.zeros((len(y) + 1, len(n)), kind)
    for i, left in enumerate(np.searchsorted(-n, -np.arange(len(x)))):  # of those columns the reference goes on
        new = np.empty((len(y) + 1, left), kind)
        new[0] = (i + 1) * one
        kept = np.where(y[:, :left] == x[i, :left], kind(-one), kind(1))
        kept += row[:-1, :left]
        np.minimum(kept, row[1:, :left] + kind(one), out=new[1:])
        row[:, :left] = np.minimum.accumulate(new, axis=0)
    return np.divmod(row[m, np.arange(len(n))].astype(np.int64) + m * one, one)

"""Repeated word sequences, removed by relative Lempel-Ziv parsing.

1. Index. Every block of documents is a reference. Its index holds its phrases, which are content-defined runs of words (see
   phrases.py), with document and place; of equal ones in all blocks the one in the document with the smallest id counts.
   A task reads a block, and the indexes meet by a shuffle on the phrases' triggers.
2. Copies. There each phrase of a document finds the like one of an earlier document: a copy, with its source. At the ends of
   repeated passages a phrase matches only in part. Such phrases are looked up window by window, which gives the rest of the
   copies, to the word.
3. Factors. A document is factored from left to right. Copies from one source at one distance are merged; from each word
   on, the copy that reaches farthest makes the next factor, and words that none covers are literals.
4. Spans. A factor of at least `length` words is a duplicate span. One that begins where the last one ended is checked at that
   boundary: it is taken back to the left as far as its copy goes, as windows that cross the boundary are copied too.

No document meets another one, and none a whole block: only phrases that stand in both do, and each with the first one only.

Defined results: a null text has no words; texts of fewer than `length` words keep all. A document with null doc_id counts as
the smallest. Rows with one doc_id never remove each other's words; equal rows get the same result. Other columns are
ignored; no rows give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import phrases as P
from .hashing import words
from .shared import blocks, doc_id, keyed, saved, table, utf8

LENGTH, GRAM = 50, 12
PART_WORDS = 1 << 19


def _symbols(length: int, part_words: int = PART_WORDS):
    def read(batch: pa.RecordBatch):
        """A long document is searched in parts that overlap by a window less a word."""
        data, at = utf8(batch.column("text"))
        for i, j in blocks(at):
            _, _, hashes, cuts = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            if j - i > 1 or len(hashes) <= 2 * part_words:
                yield i, j, np.zeros(j - i, np.int64), hashes, cuts
                continue
            for a in range(0, len(hashes), part_words):
                part = hashes[a : a + part_words + length - 1]
                yield i, j, np.array([a]), part, np.array([0, len(part)])

    return read


_COPY = ("id", "sub", "start", "stop", "src_id", "src_sub", "src_start")
COPIES = ", ".join(f"{c} long" for c in (*_COPY, "trigger", "window"))


def _look_up(length: int, group: int):
    """For BORDER rows sorted by trigger: the copies in their windows. Windows of triggers with too many phrases come out with their hash."""

    def settle(rows):
        trigger, ids, subs, start, _, _ = rows
        row, step, window = P.windows(rows, length, np.uint64)
        doc, sub, at, trigger = ids[row], subs[row], start[row] + step, trigger[row]
        order = np.lexsort((at, sub, doc, window, trigger))
        doc, sub, at, window, trigger = doc[order], sub[order], at[order], window[order], trigger[order]
        new = np.append(True, (trigger[1:] != trigger[:-1]) | (window[1:] != window[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = P.later(True, (doc[first], sub[first], at[first]), (doc, sub, at))
        first = first[late]
        copy = np.stack([doc[late], sub[late], at[late], doc[first], sub[first], at[first]])
        copy = copy[:, np.lexsort((copy[2], copy[2] - copy[5], copy[4], copy[3], copy[1], copy[0]))]
        n = copy.shape[1]
        going = (copy[[0, 1, 3, 4]][:, 1:] == copy[[0, 1, 3, 4]][:, :-1]).all(0) & (copy[2, 1:] <= copy[2, :-1] + 1) & (np.diff(copy[2] - copy[5]) == 0)
        begins = np.flatnonzero(np.append(True, ~going)) if n else np.zeros(0, np.int64)
        ends = np.append(begins[1:], n) - 1 if n else begins
        none = pa.nulls(len(begins), pa.int64())
        own = copy[:, begins]
        return P.batch(id=own[0], sub=own[1], start=own[2], stop=copy[2, ends] + length, src_id=own[3], src_sub=own[4], src_start=own[5], trigger=none, window=none)

    def whole(rows):
        trigger, ids, subs, start, _, _ = rows
        row, step, window = P.windows(rows, length, np.uint64)
        at, none = start[row] + step, pa.nulls(len(row), pa.int64())
        return P.batch(id=ids[row], sub=subs[row], start=at, stop=at + length, src_id=none, src_sub=none, src_start=none, trigger=trigger[row], window=window)

    return lambda batches: P.by_trigger(batches, settle, whole, group)


def copies(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """id, sub, start, stop, src_id, src_sub, src_start: word runs that documents with smaller ids hold too, with the first such place.

    Together they cover each window of `length` words that such a document holds. docs: keyed.
    """
    symbols = _symbols(length, part_words)
    found, wide = P.told(docs, symbols, length, gram, True)
    out = found.where("later").select("id", "sub", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"), "src_id", "src_sub", "src_start")
    rows = P.bordering(docs, symbols, length, gram, found.where("not later").select("id", "sub", "place"), wide, -(-length // 6))
    compared = saved(rows.mapInArrow(_look_up(length, group or P.GROUP), COPIES), "compared")
    out = out.unionByName(compared.where("window is null").select(*_COPY))
    single = compared.where("window is not null").drop("src_id", "src_sub", "src_start")
    if single.isEmpty():
        return out
    firsts = single.groupBy("trigger", "window").agg(F.min(F.struct("id", "sub", "start")).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("trigger", "window", "first")
    late = single.join(firsts, ["trigger", "window"]).where("id > first.id")
    return out.unionByName(late.select("id", "sub", "start", "stop", *[F.col(f"first.{c}").alias(f"src_{c}") for c in ("id", "sub", "start")]))


def factored(starts: np.ndarray, stops: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A document's factors from left to right: begin, end, and which copy it is of. sources: rows of src_id, src_sub, src_start.

    A factor goes from the last one's end, or the next copied word, to the end of the copy that reaches farthest there.
    """
    shift = sources[:, 2] - starts
    order = np.lexsort((starts, shift, sources[:, 1], sources[:, 0]))
    key = np.column_stack([sources[:, :2], shift])[order]
    reach = stops[order].copy()
    same = (key[1:] == key[:-1]).all(1)
    block = np.cumsum(np.append(0, ~same))
    # in a block, copies are merged as long as they touch
    far = np.maximum.accumulate(reach + block * (1 << 40)) - block * (1 << 40)
    new = np.append(True, ~same | (starts[order][1:] > far[:-1]))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order)) - 1
    first, last, which = starts[order][head], far[tail], order[head]
    by = np.lexsort((-last, first))
    first, last, which = first[by], last[by], which[by]
    # the copy that reaches farthest among those which begin here or before
    best = np.maximum.accumulate(last)
    holder = np.maximum.accumulate(np.where(last == best, np.arange(len(last)), 0))
    begins, ends, of, at = [], [], [], int(first[0])
    while True:
        k = int(np.searchsorted(first, at, "right")) - 1
        if best[k] <= at:  # literals up to the next copy
            if k + 1 == len(first):
                break
            at = int(first[k + 1])
            continue
        begins.append(at)
        ends.append(int(best[k]))
        of.append(int(holder[k]))
        at = ends[-1]
    of = np.array(of, np.int64)
    return np.array(begins), np.array(ends), np.stack([first[of], last[of], which[of]], 1)


def spans(starts, stops, src_id, src_sub, src_start, length: int) -> tuple[list[int], list[int], int]:
    """First and last + 1 words of a document's duplicate spans, and the number of its factors."""
    if not starts:
        return [], [], 0
    begins, ends, copy = factored(np.array(starts), np.array(stops), np.column_stack([src_id, src_sub, src_start]))
    back = np.where(np.append(-1, ends[:-1]) == begins, copy[:, 0], begins)  # at a boundary, as far back as the copy goes
    long = ends - back >= length
    return back[long].tolist(), ends[long].tolist(), len(begins)


def without_words(docs: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, kept_sha256, kept (the remaining words, joined by a space). docs: keyed; found: copies() of them.

    A document's copies are bounded by its length.
    """

    def cut(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            lists = [b.column(c) for c in _LISTS]
            for i0, j0 in blocks(at):
                out = []
                for i in range(i0, j0):
                    first, last, factors = spans(*(x[i].as_py() for x in lists), length)
                    tokens = data[at[i] : at[i + 1]].tobytes().split()
                    gone = P.covered(len(tokens), first, last)
                    kept = b" ".join([w for w, g in zip(tokens, gone, strict=True) if not g] if gone.any() else tokens)
                    out.append((b.column("doc_id")[i].as_py(), len(tokens), int(gone.sum()), factors, hashlib.sha256(kept).hexdigest(), kept.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)

    own = ("start", "stop", "src_id", "src_sub", "src_start")
    rows = found.groupBy("id", "sub").agg(F.collect_set(F.struct(*own)).alias("copies"))
    rows = rows.select("id", "sub", *[F.col(f"copies.{c}").alias(name) for c, name in zip(own, _LISTS, strict=True)])
    joined = docs.join(rows, ["id", "sub"], "left").select(doc_id(), "text", *_LISTS)
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string, kept string")


_LISTS = ("starts", "stops", "src_ids", "src_subs", "src_starts")
_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_factors", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    return without_words(docs, copies(docs)).drop("kept", "n_factors")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM d),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM n, unnest(range(1, n - 48)) AS r(i)),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
x AS (SELECT doc_id, i FROM s JOIN f USING (h) WHERE first < doc_id),
p AS (SELECT doc_id, i, w[i] AS word FROM n, unnest(range(1, n + 1)) AS r(i)),
c AS (SELECT p.doc_id, p.i, word, count(x.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)
"""

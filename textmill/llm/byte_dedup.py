"""Repeated byte strings, removed by prefix-free parsing.

1. Parse. Triggers of a rolling hash cut each document into phrases (see phrases.py): a trigger is the gram with the smallest hash
   of a window, so each window of `length` bytes has one, and what stands in the window alone decides which.
2. Dictionary. Phrases are told apart by hash, trigger by trigger; the parse is the table of their places. Triggers that occur
   once leave the parse: their windows have no like. Where a trigger has one phrase only, all windows at one distance
   from it are neighbours in corpus order, and all but the first occurrence go.
3. Suffix arrays. Where a trigger has several phrases, their bytes are fetched, one copy of each, and dealt out by trigger.
   A task sorts the suffixes of the dictionary - what stands from a window's start through its trigger, which is prefix-free, as
   no such string holds its trigger's hash twice - by doubling their ranks, and the suffixes of the parse - what follows from the
   trigger on, as far as a window reaches - with the common prefix of each two neighbours.
4. Corpus order. Windows sorted by the rank of their dictionary suffix, then by that of the parse suffix after it, are in the
   order of the corpus's suffixes. Neighbours share `length` bytes if the first is the same and the second's common
   prefix is long enough. Of each run of such neighbours the first place in the corpus stays.

The order is worked out trigger by trigger, so it is dealt to tasks like the triggers, and no task sees the whole dictionary.
Phrases of a trigger that has more than a task holds are compared by an aggregate of window hashes instead.

Defined results: a null text has no bytes; a text shorter than `length` keeps all of them. Documents are ordered by doc_id, null
first; rows with the same doc_id and other texts by a hash of the text; equal rows are one document and get the same
result. Other columns are ignored; no rows give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import phrases as P
from .shared import BLOCK_BYTES, blocks, doc_id, keyed, saved, table, utf8

LENGTH, GRAM = 100, 32


def _symbols(length: int, part_bytes: int = BLOCK_BYTES):
    def read(batch: pa.RecordBatch):
        """A long document is read in parts that overlap by a window less a byte."""
        data, at = utf8(batch.column("text"))
        for i, j in blocks(at, part_bytes):
            if j - i > 1 or at[j] - at[i] <= 2 * part_bytes:
                yield i, j, np.zeros(j - i, np.int64), data[at[i] : at[j]], at[i : j + 1] - at[i]
                continue
            for a in range(int(at[i]), int(at[j]), part_bytes):
                part = data[a : min(a + part_bytes + length - 1, int(at[j]))]
                yield i, j, np.array([a - at[i]]), part, np.array([0, len(part)])

    return read


def suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """Strings as rows, right-aligned, of codes from 1 on; 0 stands before them. Gives the rank of every suffix among all of them, by its
    first column; equal suffixes have equal ranks, from 1. Ranks of the first 7 codes are doubled until they cover a row or tell no more apart."""
    rows, width = codes.shape
    there = codes > 0
    wide = np.zeros((rows, width + 6), np.int64)
    wide[:, :width] = codes
    key = np.zeros((rows, width), np.int64)
    for j in range(7):
        key = (key << 9) | wide[:, j : j + width]
    ranks = np.zeros((rows, width), np.int64)
    known, reach = 0, 7
    while True:
        values, inverse = np.unique(key[there], return_inverse=True)
        ranks[there] = inverse + 1
        if reach >= width or len(values) == known:
            return ranks
        known = len(values)
        key = ranks << 32
        key[:, : width - reach] |= ranks[:, reach:]
        reach *= 2


def _aligned(flat: np.ndarray, first: np.ndarray, stop: np.ndarray, width: int, right: bool) -> np.ndarray:
    """flat[first:stop] of each row as codes from 1 on, in a matrix; 0 stands where there is nothing."""
    at = (stop[:, None] - width if right else first[:, None]) + np.arange(width)
    inside = (at >= first[:, None]) & (at < stop[:, None])
    return np.where(inside, flat[np.clip(at, 0, len(flat) - 1)].astype(np.int16) + 1, 0).astype(np.int16)


def _as_strings(matrix: np.ndarray) -> np.ndarray:
    """A row as one value that sorts like it."""
    return np.ascontiguousarray(matrix.astype(">u2")).view(f"S{2 * matrix.shape[1]}")[:, 0]


def parse_order(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parse suffixes as rows: the place of each in sorted order, and there the common prefix with the one before."""
    order = np.argsort(_as_strings(right), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ordered = right[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(1), differ.argmax(1), right.shape[1])
    return place, np.concatenate([[0], common])


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest of values[first + 1 : last + 1], for first < last."""
    table, n = [values], 1
    while 2 * n <= len(values):
        table.append(np.minimum(table[-1][:-n], table[-1][n:]))
        n *= 2
    level = np.log2(np.maximum(last - first, 1)).astype(np.int64)
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level).tolist():
        m = level == k
        out[m] = np.minimum(table[k][first[m] + 1], table[k][last[m] + 1 - (1 << k)])
    return out


def corpus_order(ahead: np.ndarray, raw: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of phrases in corpus order: phrase, place in it, and whether it shares its `length` bytes with the one before.

    ahead: where each phrase's trigger is. Windows of different triggers are never neighbours that share all bytes.
    """
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    first = np.cumsum(size) - size
    trigger = first + ahead
    place, common = parse_order(_aligned(flat, trigger, np.minimum(first + size, trigger + length), length, right=False))
    left = _aligned(flat, first, trigger + gram, length, right=True)
    _, kept, own = np.unique(_as_strings(left), return_index=True, return_inverse=True)  # the dictionary
    ranks = suffix_ranks(left[kept])
    n = size - length + 1
    phrase = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    before = ahead[phrase] - step  # bytes ahead of the trigger
    rank = ranks[own[phrase], length - gram - before]
    order = np.argsort((rank << 32) | place[phrase], kind="stable")
    phrase, step, rank, before, at = phrase[order], step[order], rank[order], before[order], place[phrase[order]]
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(rank[1:] == rank[:-1])
    shared = np.full(len(near), length)
    apart = at[near] < at[near + 1]
    shared[apart] = least_between(common, at[near][apart], at[near + 1][apart])
    same[near + 1] = shared >= length - before[near]
    return phrase, step, same


RUNS = "id long, sub long, start long, stop long, trigger long, window long"


def _compare(length: int, gram: int, group: int):
    """For BORDER rows sorted by trigger: runs of windows that repeat earlier ones. Windows of triggers with too many phrases come out with their hash."""

    def runs(doc, sub, at):
        """Windows that go, as runs."""
        order = np.lexsort((at, sub, doc))
        doc, sub, at = doc[order], sub[order], at[order]
        begins = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (at[1:] > at[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(doc)) - 1 if len(doc) else begins
        none = pa.nulls(len(begins), pa.int64())
        return P.batch(id=doc[begins], sub=sub[begins], start=at[begins], stop=at[ends] + length, trigger=none, window=none)

    def settle(rows):
        _, ids, subs, start, ahead, raw = rows
        phrase, step, same = corpus_order(ahead, raw, length, gram)
        kind = np.cumsum(~same)
        doc, sub, at = ids[phrase], subs[phrase], start[phrase] + step
        order = np.lexsort((at, sub, doc, kind))
        doc, sub, at, kind = doc[order], sub[order], at[order], kind[order]
        new = np.append(True, kind[1:] != kind[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = P.later(False, (doc[first], sub[first], at[first]), (doc, sub, at))
        return runs(doc[late], sub[late], at[late])

    def whole(rows):
        trigger, ids, subs, start, _, _ = rows
        row, step, window = P.windows(rows, length, np.uint8)
        at = start[row] + step
        return P.batch(id=ids[row], sub=subs[row], start=at, stop=at + length, trigger=trigger[row], window=window)

    return lambda batches: P.by_trigger(batches, settle, whole, group)


def duplicate_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int | None = None, part_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, sub, start, stop: byte runs covered by strings of `length` bytes that also start earlier. Runs may overlap. docs: keyed."""
    symbols = _symbols(length, part_bytes)
    found, wide = P.told(docs, symbols, length, gram, False, "id", "sub", "start", "n", "later", "place")
    out = found.where("later").select("id", "sub", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    rows = P.bordering(docs, symbols, length, gram, found.where("not later").select("id", "sub", "place"), wide)
    compared = saved(rows.mapInArrow(_compare(length, gram, group or P.GROUP), RUNS), "compared")
    out = out.unionByName(compared.where("window is null").select("id", "sub", "start", "stop"))
    single = compared.where("window is not null")
    if single.isEmpty():
        return out
    firsts = single.groupBy("trigger", "window").agg(F.min(F.struct("id", "sub", "start")).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("trigger", "window", "first")
    late = P.later(False, tuple(F.col(f"first.{c}") for c in ("id", "sub", "start")), (F.col("id"), F.col("sub"), F.col("start")))
    return out.unionByName(single.join(firsts, ["trigger", "window"]).where(late).select("id", "sub", "start", "stop"))


def without_bytes(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes). docs: keyed. A document's runs are bounded by its length."""

    def cut(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            starts, stops = b.column("starts"), b.column("stops")
            for i0, j0 in blocks(at):
                out = []
                for i in range(i0, j0):
                    text = data[at[i] : at[i + 1]]
                    gone = P.covered(len(text), starts[i].as_py(), stops[i].as_py())
                    kept = text[~gone].tobytes()
                    out.append((b.column("doc_id")[i].as_py(), len(text), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum()), hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)

    spans = runs.groupBy("id", "sub").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("runs"))
    spans = spans.select("id", "sub", F.col("runs.start").alias("starts"), F.col("runs.stop").alias("stops"))
    joined = docs.join(spans, ["id", "sub"], "left").select(doc_id(), "text", "starts", "stops")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    return without_bytes(docs, duplicate_bytes(docs)).drop("kept")


SQL = r"""
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS w FROM n, unnest(range(1, n - 98)) AS r(i)),
x AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
p AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS b FROM n, unnest(range(1, n + 1)) AS r(i)),
c AS (SELECT p.doc_id, p.i, b, count(x.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)
"""

r"""Importance resampling towards a target distribution, over hashed n-grams whose CRCs are composed.

A feature is a run of one to three words, joined by one space; its bucket is its CRC-32 modulo the number of buckets. The CRC of each
word is computed once. Those of runs follow by algebra over GF(2): appending n bytes to a text multiplies its CRC by the n-th power of
a 32 x 32 matrix and adds the CRC of the bytes, so crc(a + " " + b) = Z^len(b) (Z crc(a) + crc(" ")) + crc(b). Powers of two of the
matrix are tables by byte, applied to whole arrays; no run is ever written out as a string.

A bucket's gain is the log ratio of its (smoothed) shares in the target and in all documents, in thousandths, floored. A document's weight is the
sum of gains over its features; with Gumbel noise drawn from its doc_id, the documents of most score are a draw without replacement by weight.
Of those with at least `least_words` words the share `percent` is drawn. Tasks count buckets in tables of a fixed size, which alone reach the
driver; the score that just gets in is found by narrowing histograms; ranks come from ranges of scores with the counts before them.

Words: A-Z are lowered, bytes of ASCII but letters and digits separate. Defined results: a null text has no words, no features and weight 0; so has an empty
one. A null doc_id hashes as an empty one and ranks after others of its score. Rows with one doc_id share their noise; of equal rows each is a
document, and they take ranks one after the other. Without target every gain is what the formula says for t = T = 0. No
rows give none. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .importance import kth_largest
from .ordered import running
from .shared import blocks, saved, table, utf8

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Longer words have their CRC taken one by one.
SHORT = 64

WORD = np.ones(256, bool)
WORD[:128] = [chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _tables() -> list[np.ndarray]:
    """For each k, the 2^k-th power of the matrix of one zero byte, as four tables by byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> 1) ^ np.where(steps & 1, np.uint32(0xEDB88320), np.uint32(0))
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = (columns >> np.uint32(8)) ^ steps[columns & np.uint32(255)]
    out = []
    for _ in range(32):
        by_byte = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            by_byte[bit // 8][(np.arange(256) >> bit % 8 & 1).astype(bool)] ^= columns[bit]
        out.append(by_byte)
        columns = times(by_byte, columns)
    return [steps, *out]


def times(by_byte: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix by every vector of x."""
    return by_byte[0][x & np.uint32(255)] ^ by_byte[1][x >> np.uint32(8) & np.uint32(255)] ^ by_byte[2][x >> np.uint32(16) & np.uint32(255)] ^ by_byte[3][x >> np.uint32(24)]


STEP, *ZEROS = _tables()
SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC times the power n of the matrix: what it adds to the CRC of a text that n bytes longer."""
    crc = crc.copy()
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        at = np.flatnonzero(n >> k & 1)
        crc[at] = times(ZEROS[k], crc[at])
    return crc


def joined(crc: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of text, space, word from those of text and word, and the word's bytes."""
    return shifted(times(ZEROS[0], crc) ^ SPACE, length) ^ word


def word_crcs(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that lie end to end in buf: CRC and length of each word, and for each row the number of words before it. at: offsets, from 0."""
    buf, n = LOWER[buf], len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = WORD[buf]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    length = last - first
    order = np.argsort(-length, kind="stable")
    by_length = length[order]
    long = int(np.searchsorted(-by_length, -SHORT))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(by_length[long]) if long < len(order) else 0):
        z = int(np.searchsorted(-by_length, -k))  # words of more than k bytes
        crc[long:z] = crc[long:z] >> np.uint32(8) ^ STEP[(crc[long:z] ^ buf[first[order[long:z]] + k]) & np.uint32(255)]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(buf[first[order[i]] : last[order[i]]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out, length, np.searchsorted(first, at)


def features(buf: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each feature, and the words of each row."""
    one, length, cuts = word_crcs(buf, at)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    two = joined(one[:-1], one[1:], length[1:])
    three = joined(two[:-1], one[2:], length[2:])
    pair, triple = row[1:] == row[:-1], row[2:] == row[:-2]
    return np.concatenate([one, two[pair], three[triple]]) % np.uint32(buckets), np.concatenate([row, row[1:][pair], row[2:][triple]]), np.diff(cuts)


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at):
                total += np.bincount(features(data[at[i] : at[j]], at[i : j + 1] - at[i], buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    t_all, s_all, n = float(target.sum()), float(raw.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)])


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def of(batches):
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in blocks(at):
                bucket, row, words = features(data[at[i] : at[j]], at[i : j + 1] - at[i], len(gain))
                # sums of whole numbers, exact in doubles
                total = np.bincount(row, weights=gain[bucket], minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(words), pa.array(np.bincount(row, minlength=j - i)), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (from 1 for those drawn, null for others). target: text."""
    gain = gains(counts(target, buckets), counts(docs, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = saved(weights(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    least = kth_largest(able, "score", k)
    result = ["doc_id", "n_words", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*result, F.lit(None).cast("long").alias("rank"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    enters = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    ranked = running(scored.where(enters).withColumn("all", F.lit(0).cast("long")), "all", order, order, name="ranked")
    return ranked.select(*result, F.when(F.col("n") <= k, F.col("n")).alias("rank")).unionByName(scored.where(~enters).select(*result, F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0::BIGINT), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) AS r(i))),
texts AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT NULL, -row_number() OVER (), text FROM benchmark),
words AS (
  SELECT r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT r, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM words),
counted AS (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g),
crcs AS (
  SELECT g, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda i: ((strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM counted)), steps),
features AS (SELECT r, bucket, sum(n)::BIGINT AS n FROM counted JOIN crcs USING (g) GROUP BY r, bucket),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (r < 0), 0)::DOUBLE AS t FROM features GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM buckets, totals),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE r > 0 GROUP BY r),
scored AS (
  SELECT doc_id, r, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts JOIN words USING (r) LEFT JOIN weighed USING (r) WHERE r > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""

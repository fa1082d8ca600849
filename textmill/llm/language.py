"""Language ID by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of a fixed length, all of them, the last one padded. On each window filters of
several widths slide over the bytes; each filter's largest value in the window is kept (max pooling, then ReLU), and a softmax
layer gives the languages' probabilities. A document's are the mean over its windows, weighted by their bytes. A filter is a
table with a row for each byte and place in it, so a window's values are sums of table rows.

The network is trained in numpy (Adam) on the driver, on a bounded sample, documented in README: of the LANGUAGES most frequent
languages up to `per_language` documents each, SAMPLE documents in all, the ones with the smallest hashed doc_id, and up to three
windows of each. Counts that the sample depends on cover all rows. Prediction covers all rows and whole texts.

Defined results: `und` and score 0 where the text is null or has no letter, or where no row has a language to learn from.
Rows without a language or doc_id aren't learned from. Repeated rows get equal results; rows with one doc_id and other texts are
predicted one by one. Other columns are ignored; no rows give none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, free_name, table, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: documents of a language, languages, documents.
PER_LANGUAGE, LANGUAGES, SAMPLE = 500, 500, 20_000
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    window: int
    tables: dict[int, np.ndarray]  # width: (width, 256, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows as rows of bytes: each filter's largest value, and where it is."""
        top, where = [], []
        for width, t in self.tables.items():
            n = x.shape[1] - width + 1
            values = t[0].take(x[:, :n], axis=0)
            for j in range(1, width):
                values += t[j].take(x[:, j : j + n], axis=0)
            at = values.argmax(1)
            where.append(at)
            top.append(np.take_along_axis(values, at[:, None], 1)[:, 0])
        return np.concatenate(top, 1) + self.bias, np.concatenate(where, 1)

    def highest(self, x: np.ndarray) -> np.ndarray:
        out = []
        for width, t in self.tables.items():
            n = x.shape[1] - width + 1
            values = t[0].take(x[:, :n], axis=0)
            for j in range(1, width):
                values += t[j].take(x[:, j : j + n], axis=0)
            out.append(values.max(1))
        return np.concatenate(out, 1) + self.bias

    def softmax(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.softmax(self.highest(x[i : i + 128])) for i in range(0, len(x), 128)])


def cut(text: np.ndarray, window: int) -> np.ndarray:
    """A text's windows as rows, padded with zeros; an empty text has one."""
    n = max(1, -(-len(text) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(text)] = text
    return out.reshape(n, window)


def gradient(net: Network, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Of the windows' cross entropy, each times its share: by tables, bias, out and out_bias. Only the place of a filter's largest value counts."""
    top, where = net.pooled(x)
    p = net.softmax(top)
    p[np.arange(len(x)), y] -= 1
    p *= share[:, None].astype(np.float32)
    back = (p @ net.out.T) * (top > 0)
    grads, first = [], 0
    for w, t in net.tables.items():
        g, filters = np.zeros_like(t), t.shape[2]
        own = slice(first, first + filters)
        first += filters
        for j in range(w):
            np.add.at(g[j], (np.take_along_axis(x, where[:, own] + j, 1), np.arange(filters)[None, :]), back[:, own])
        grads.append(g)
    return [*grads, back.sum(0), np.maximum(top, 0).T @ p, p.sum(0)]


def train(texts: list[bytes], labels: list[str], window: int = WINDOW, widths=WIDTHS, filters: int = FILTERS, epochs: int = EPOCHS) -> Network:
    """A network for texts of at most a window each."""
    rng = np.random.default_rng(SEED)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = np.concatenate([cut(np.frombuffer(t[:window], np.uint8), window) for t in texts])
    hidden = filters * len(widths)
    net = Network(
        languages,
        window,
        {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths},
        np.zeros(hidden, np.float32),
        rng.normal(0, 0.1, (hidden, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    params = [*net.tables.values(), net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            rows = order[i : i + BATCH]
            grads = gradient(net, x[rows], y[rows], weight[y[rows]] / len(rows))
            step += 1
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(of: int, rest: int) -> Column:
    """A row without doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == rest, F.lit(True))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, window: int = WINDOW) -> Network | None:
    """docs: doc_id, text, lang. None where no row has text and language."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = docs.sparkSession.createDataFrame(counts.collect(), "lang string, n long")
    per_language = max(1, min(per_language, SAMPLE // max(1, counts.count())))
    hashed = F.xxhash64(F.lit(SEED), "doc_id")
    share = (F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))).alias("share")
    rows = rows.select("doc_id", "text", "lang", share).join(F.broadcast(counts), "lang").where(F.col("share") * F.col("n") < per_language)
    chars = F.length("text")
    places = F.array_distinct(F.array(F.lit(1), F.greatest(F.lit(1), F.expr(f"int(length(text) / 2) - {window // 2}")), F.greatest(F.lit(1), chars - window + 1)))
    parts = F.transform(places, lambda p: F.substring(F.col("text"), p, F.lit(window)))
    sample = rows.select("share", "doc_id", "lang", parts.alias("parts")).orderBy("share", "doc_id").limit(2 * SAMPLE).collect()
    texts = [(p.encode()[:window], r.lang) for r in sample for p in r.parts]
    return train([t for t, _ in texts], [x for _, x in texts], window) if texts else None


def _told(net: Network | None, b: pa.RecordBatch, text: str, letters: str):
    """Of a batch's rows block by block: first and last + 1 row, languages, scores."""
    data, at = utf8(b.column(text))
    there = b.column(letters).to_numpy(zero_copy_only=False)
    for i, j in blocks(at, 1 << 18):
        names, scores = [UNKNOWN] * (j - i), [0.0] * (j - i)
        own = [k for k in range(i, j) if there[k]] if net else []
        if own:
            for k, p in zip(own, _documents(net, [data[at[k] : at[k + 1]] for k in own]), strict=True):
                names[k - i], scores[k - i] = net.languages[int(p.argmax())], float(p.max())
        yield i, j, names, scores


def _letters() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def of(batches):
        for b in batches:
            for i, j, names, scores in _told(net, b, "text", "letters"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text", _letters().alias("letters")).mapInArrow(of, "doc_id long, lang_pred string, score double")


def kept_documents(docs: DataFrame, net: Network | None, least: float, wanted=None) -> DataFrame:
    """The rows of docs whose language is told with a score of `least` or more and is among `wanted` (None: any), with their columns.

    Rows without a language get the one that is told. Each row is decided on by its own text, where it is read. Without a network
    none can be told, so none stays.
    """
    letters = free_name(docs, "letters")
    place = docs.columns.index("lang")

    def of(batches):
        for b in batches:
            lang = b.column("lang").to_pylist()
            for i, j, names, scores in _told(net, b, "text", letters):
                keep = pa.array([s >= least and n != UNKNOWN and (wanted is None or n in wanted) for n, s in zip(names, scores, strict=True)])
                filled = pa.array([x or n for x, n in zip(lang[i:j], names, strict=True)], pa.string())
                part = b.slice(i, j - i).drop_columns([letters])
                yield part.set_column(place, "lang", filled).filter(keep)

    return docs.withColumn(letters, _letters()).mapInArrow(of, docs.schema)


def _documents(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    windows = [cut(t, net.window) for t in texts]
    p = net.probabilities(np.concatenate(windows))
    n = np.array([len(w) for w in windows])
    size = np.full(n.sum(), net.window, float)
    size[np.cumsum(n) - 1] = [max(1, len(t) - (k - 1) * net.window) for t, k in zip(texts, n.tolist(), strict=True)]
    first = np.cumsum(n) - n
    return np.clip(np.add.reduceat(p * size[:, None], first) / np.add.reduceat(size, first)[:, None], 0, 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    return predict(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")

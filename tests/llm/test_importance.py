import random
from collections import Counter
from math import log

import numpy as np
import pytest

from textmill.llm import importance as I

DOCS, LABELS = "doc_id long, text string, target int, bucket int", "doc_id long, quality int, toxic int, text string"


def corpus(n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choices(["spam%", "buy", "the"] if bad else ["stone", "river", "the", "of", "wall"], k=rng.randrange(5, 80))), 0, 0))
        if i % 2:
            labels.append((i, int(not bad), int(bad), "x"))
    return rows, labels


def test_keeps_good_documents(spark):
    rows, labels = corpus()
    out = I.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 400 and sum(r.kept for r in out) == 320
    assert sum(r.kept for r in out if r.doc_id % 5) >= 315


def test_edge_cases(spark):
    rows, labels = corpus(50)
    docs = spark.createDataFrame(rows + [(1000, None, 0, 0), (1001, "", 0, 0), (7, "again", 0, 0), (1002, "the " * 100_000, 0, 0)], DOCS)
    labels = spark.createDataFrame(labels, LABELS)
    out = I.resample(docs, labels).collect()
    assert len(out) == 54 and {r.log_weight for r in out if r.doc_id in (1000, 1001)} == {0.0}
    assert all(r.kept for r in I.resample(docs, labels.limit(0)).collect())
    assert I.resample(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("bins", [2, 5, 4096])
def test_kth_largest(spark, bins):
    rng = random.Random(bins)
    values = [rng.randrange(-(10**6), 10**6) for _ in range(200)] + [5] * 50
    keys = spark.createDataFrame([(v,) for v in values], "k long")
    for k in (1, 2, 57, 130, 250):
        assert I.kth_largest(keys, "k", k, bins) == sorted(values, reverse=True)[k - 1]
    assert I.kth_largest(keys, "k", 251, bins) is None and I.kth_largest(keys, "k", 0, bins) is None


def test_weights_and_draw(spark):
    """Log weights by counting n-grams document by document, and the draw by sorting keys; ties included."""
    rows, labels = corpus(120)
    rows += [(500, None, 0, 0), (501, "", 0, 0), (3, rows[3][1], 0, 0)]
    out = I.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    good = {i for i, quality, toxic, _ in labels if quality and not toxic}

    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return I.grams(data, np.array([0, len(data)]), I.BUCKETS)[0].tolist()

    assert len(buckets("One two  three")) == 5 and len(set(buckets("a b a b"))) == 4
    raw, target = Counter(), Counter()
    for i, text, *_ in rows:
        raw.update(buckets(text))
        if i in good:
            target.update(buckets(text))
    scale = sum(target.values()) / sum(raw.values())
    ratio = lambda b: log((target[b] + I.ADDED) / (raw[b] * scale + I.ADDED))
    weight = {i: I.EFFECTIVE * sum(map(ratio, buckets(t))) / max(1, len(buckets(t))) for i, t, *_ in rows}
    assert all(abs(r.log_weight - weight[r.doc_id]) < 1e-6 * max(1, abs(r.log_weight)) for r in out)
    k = round(len(rows) * sum(q for _, q, *_ in labels) / len(labels))
    keys = sorted((int(np.floor(r.gumbel_key * 2**32)) for r in out), reverse=True)
    assert {r.doc_id for r in out if r.kept} == {r.doc_id for r in out if int(np.floor(r.gumbel_key * 2**32)) >= keys[k - 1]}


def test_held_out_labels(spark):
    """Trained on half of the labels, weights tell the other half apart: AUC on sf0.01."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r.log_weight for r in I.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    test = [(out[r.doc_id], r.quality == 1 and not r.toxic) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = ([w for w, g in test if g == x] for x in (True, False))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("AUC", auc)
    assert auc > 0.75 and len(good) > 50 and len(bad) > 20

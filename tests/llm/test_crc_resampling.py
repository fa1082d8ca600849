import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm import crc_resampling as R

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORDS.findall(data)
    return w, [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ9 é -_.\n語"), max_size=12) | st.just("x" * 200 + " b c") | st.just("é" * 40), max_size=6))
def test_features_are_those_of_the_strings(texts):
    parts = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, parts)])
    bucket, row, words = R.features(np.frombuffer(b"".join(parts), np.uint8), at, 10_000)
    expected = sorted((i, zlib.crc32(g) % 10_000) for i, t in enumerate(texts) for g in grams(t)[1])
    assert sorted(zip(row.tolist(), bucket.tolist(), strict=True)) == expected
    assert words.tolist() == [len(grams(t)[0]) for t in texts]


def test_algebra():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.randbytes(rng.randrange(0, 50)), rng.randbytes(rng.choice([0, 1, 7, 300, 5000]))
        crc = [np.array([zlib.crc32(x)], np.uint32) for x in (a, b)]
        assert R.joined(*crc, np.array([len(b)]))[0] == zlib.crc32(a + b" " + b)


def brute(rows, target, percent=5, least=20):
    s = Counter(zlib.crc32(g) % 10_000 for _, t in rows for g in grams(t)[1])
    t = Counter(zlib.crc32(g) % 10_000 for x in target for g in grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, text in rows:
        own = grams(text)[1]
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(g) % 10_000) for g in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(grams(text)[0])])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_equals_brute_force(spark, percent):
    rng = random.Random(4)
    vocabulary = ["stone", "River", "über", "x1", "a-b", "語", "the"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "the " * 60_000), (None, "stone " * 30), (None, "stone " * 30), (3, rows[3][1]), (9, "river " * 25), (504, "w" * 100_000 + " x")]
    target = ["stone river the", None, "über stone"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, score int")
    out = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).collect()
    got = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out]
    assert sorted(got, key=key) == sorted((tuple(r[:5]) for r in brute(rows, target, percent)), key=key)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).collect() == []
    assert [r.weight for r in R.resample(spark.createDataFrame([(1, None)], "doc_id long, text string"), none).collect()] == [0]


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    expected = duck.sql(f"SELECT {', '.join(names)} FROM ({R.SQL})").fetchall()
    assert sorted(map(tuple, R.query(spark, folder).select(*names).collect()), key=key) == sorted(expected, key=key)
    assert sum(r[4] is not None for r in expected) > 5

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import ordered as O
from textmill.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, part int, depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own_ in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own_) - 1) * words
            leaves[p[:d]] += p not in children
    return sorted(
        (m[0][0], len(p), members[p[:-1]][0][0] if p else -1, len(m), children[p] if p in children else 0, leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c, e in m if e).encode()).hexdigest()) for p, m in members.items()
    )


def got(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.select(*NAMES).collect())


def table(spark, rows, n=5):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(n)


@pytest.fixture
def dealt(spark):
    """Small tables stay in several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def random_rows(seed, convs=120):
    rng = random.Random(seed)
    say = lambda: rng.choice(["a b", "c", "", None, "nb sp x", "long\ttext here"])
    rows = []
    for c in rng.sample(range(-45, 400), convs):
        rows += [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), say()) for t in range(rng.randrange(1, 9))]
    return rows + rng.choices(rows, k=20) + [(None, 1, "user", "x")]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    assert got(T.trie(table(spark, rows))) == brute(rows)


def test_long_and_nested(spark, dealt, monkeypatch):
    """A conversation over many tasks, copies of it, prefixes of prefixes (paths that hang deep), hot nodes, and a list of members in many pieces."""
    monkeypatch.setattr(T, "HOT", 5)
    monkeypatch.setattr(T, "LISTED", 7)
    rows = [(c, t, "user", f"w{t} x") for c in (0, 7, 400) for t in range(150)]
    rows += [(1000 - c, t, "user", f"n{t} x") for c in range(40) for t in range(3 + c)]
    rows += [(c, t, "user", "same words") for c in range(2000, 2100) for t in range(4)] + [(c, 9, "assistant", f"then {c}") for c in range(2000, 2050)]
    assert got(T.trie(table(spark, rows))) == brute(rows)


def test_collisions_are_split(spark, monkeypatch):
    """With a first fingerprint that tells next to nothing, groups are found wrong and split by more of them."""
    whole = T.turn_hash
    monkeypatch.setattr(T, "turn_hash", lambda k: whole(k) % 2 if k < 2 else whole(k))
    rows = random_rows(5)
    assert T.verified(table(spark, rows))[2] == 3
    assert got(T.trie(table(spark, rows))) == brute(rows)


def test_running(spark, dealt):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(np.sort(rng.choice([1, 2, 2, 2, 2, 5, 9], 500)), rng.integers(-(2**62), 2**62, 500), strict=True))]
    out = O.running(spark.createDataFrame(rows, "k long, i long, v long").withColumn("w", F.col("i")), "k", [F.asc("k"), F.asc("i")], [F.asc("k"), F.asc("i")], ("w",), {"v": 12345677}).collect()
    assert len({r.part for r in out if r.k == 2}) > 1
    n, total, poly = defaultdict(int), defaultdict(int), defaultdict(int)
    expected = []
    for k, i, v in rows:
        n[k] += 1
        total[k] += i
        poly[k] = (poly[k] + v * pow(12345677, n[k], 2**64)) % 2**64
        expected.append((i, n[k], total[k], poly[k] - 2**64 if poly[k] >= 2**63 else poly[k]))
    assert sorted((r.i, r.n, r.w_to, r.v_to) for r in out) == expected


def test_empty(spark):
    assert T.trie(table(spark, [])).collect() == [] and T.trie(table(spark, [(None, 1, "a", "b")])).collect() == []
    assert got(T.trie(table(spark, [(21, 0, "user", "a")]))) == brute([(21, 0, "user", "a")])


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    expected = sorted(tuple(-1 if x is None else x for x in r) for r in duck.sql(f"SELECT {', '.join(NAMES)} FROM ({T.SQL})").fetchall())
    assert got(T.query(spark, folder)) == expected == brute(duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())

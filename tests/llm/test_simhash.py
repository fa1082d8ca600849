import random
import re
from collections import defaultdict

import pytest
import xxhash

from textmill.llm import simhash as S
from textmill.llm.components import components


def brute_print(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, distance):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in prints}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("distance,bucket", [(2, 4096), (2, 3), (3, 4096), (3, 4), (5, 64)])
def test_links_connect_all(spark, distance, bucket):
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for v in list(values)[:12]:
        for _ in range(12):
            for _ in range(rng.randrange(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    prints = {i: v for i, v in enumerate(sorted(values))}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in S.links(fps, distance, bucket).collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in edges)
    where, groups = {v: i for i, v in prints.items()}, {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(groups[where[a]], groups[where[b]])
            changed |= groups[where[a]] != low or groups[where[b]] != low
            groups[where[a]] = groups[where[b]] = low
    assert groups == brute_components(prints, distance)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000, None), (4000, ""), (6000, " \n"), (7000, "One two"), (6500, "one\ttwo"), (8000, "É a b"), (8001, "x" * 100_000), (8002, "w " * 100_000)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    prints = {i: brute_print(t, 3) for i, t in rows}
    out = S.near_dedup(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in out} == prints
    assert {r.doc_id: r.component_id for r in out} == brute_components(prints, 2)


def test_components(spark):
    rng = random.Random(3)
    for edges in ([(i, i + 1) for i in range(300)], [(rng.randrange(400), rng.randrange(400)) for _ in range(300)], [(500, i) for i in range(499)], []):
        edges = [(a, b) for a, b in edges if a != b]
        near = defaultdict(set)
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        expected = {}
        for i in sorted(near):
            todo = [i]
            while todo:
                if (j := todo.pop()) not in expected:
                    expected[j] = i
                    todo += near[j]
        out = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in out} == expected and len(out) == len(expected)


def test_empty(spark):
    assert S.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []

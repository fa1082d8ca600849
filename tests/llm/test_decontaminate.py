import random
import re
import time

import numpy as np
import pytest

from textmill.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id long, seed long", "item_id long, text string, doc_id long"


def brute(docs, items, overlap=13, identity=0.8, least=5):
    """Pairs with an overlap on some diagonal, without seeds."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, text in docs:
        d = split(text)
        for k, item in items:
            q = split(item)
            if len(q) < least:
                continue
            for shift in range(-len(q) + 1, len(d)):
                first, last = max(0, -shift), min(len(q), len(d) - shift)
                same = np.array([q[p] == d[p + shift] for p in range(first, last)])
                if same.sum() >= 4:
                    a, z = D.best_overlap(same, identity)
                    if z - a >= min(overlap, -(-len(q) * 4 // 5)):
                        out.add((i, k))
    return out


def test_finds_planted(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "É"] * 20
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(text(rng.randrange(14, 50)))) for i in range(20)] + [(50, "alpha beta gamma delta epsilon"), (51, "the of"), (52, None), (53, ""), (54, "one two three four five six seven eight")]
    docs = [(i, " ".join(text(rng.randrange(0, 200)))) for i in range(60)]
    planted = set()
    for i in range(100, 140):
        k, item = items[rng.randrange(20)]
        q = item.split()
        for _ in range(len(q) // 12):
            q[rng.randrange(len(q))] = "changed"
        docs.append((i, " ".join([*text(30), " ,".join(q).upper(), *text(30)])))
        planted.add((i, k))
    docs += [(200, "x alpha, BETA gamma. delta epsilon y"), (201, None), (202, ""), (203, "of the of the " * 5000 + items[3][1]), (204, "one two three four five six seven eight")]
    found = D.overlaps(spark.createDataFrame([(*r, 1, 2) for r in docs], DOCS), spark.createDataFrame([(*r, 3) for r in items], ITEMS)).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert len(pairs) == len(found) and planted <= pairs and {(200, 50), (203, 3), (204, 54)} <= pairs
    assert pairs == brute([d for d in docs if d[0] != 203], items) | {(203, 3)}
    assert {i for i, _ in pairs}.isdisjoint(range(60))


def test_clean_documents_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p", 0, 0), (2, "q r s t", 0, 0), (2, "q r s t", 0, 0)], DOCS)
    items = spark.createDataFrame([(9, "a b c d e f g h i j k l m n", 0)], ITEMS)
    out = D.clean_documents(docs, items)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2, 2]
    assert D.overlaps(docs.limit(0), items).collect() == [] and D.overlaps(docs, items.limit(0)).collect() == []


def longest(same):
    """Length of the longest stretch with 80 % matches, all of them tried."""
    return max((z - a for a in range(len(same)) for z in range(a + 1, len(same) + 1) if 5 * sum(same[a:z]) >= 4 * (z - a)), default=0)


def test_best_overlap_is_longest():
    rng = random.Random(9)
    for _ in range(500):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randrange(1, 40))])
        a, z = D.best_overlap(same, 0.8)
        assert z - a == longest(same.tolist()) and 5 * same[a:z].sum() >= 4 * (z - a)


@pytest.mark.parametrize("size,most", [(5, 1), (6, 1), (7, 1), (8, 1), (10, 2), (13, 1), (13, 2), (16, 2), (16, 3), (20, 3), (20, 4)])
def test_substitutions_up_to_a_fifth(spark, size, most):
    """Items copied whole with substitutions anywhere are all found."""
    rng = random.Random(size + most)
    items, docs, expected = [], [], set()
    for i in range(60):
        item = [f"i{i}x{j}" for j in range(size)]
        same = [True] * size
        for j in rng.sample(range(size), most):
            same[j] = False
        if longest(same) < min(13, -(-size * 4 // 5)):
            continue
        copy = [w if s else f"d{i}x{j}" for j, (w, s) in enumerate(zip(item, same, strict=True))]
        items.append((i, " ".join(item), 0))
        docs.append((i, " ".join([*(f"a{i}x{j}" for j in range(9)), *copy, *(f"z{i}x{j}" for j in range(9))]), 0, 0))
        assert longest(same) >= min(13, -(-size * 4 // 5))
        expected.add((i, i))
    found = D.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected


def fewest_substitutions(masks, most):
    """For each length up to `most`, the fewest substitutions in a stretch that no mask hits, over all such stretches."""
    span = max(map(len, masks))
    states, out = {(0, 0): 0}, []
    for _ in range(most):
        after = {}
        for (history, n), cost in states.items():
            for match in (0, 1):
                h, m = (history << 1 | match) & ((1 << span) - 1), min(span, n + 1)
                if not any(m >= len(mask) and h & int(mask, 2) == int(mask, 2) for mask in masks):
                    after[h, m] = min(after.get((h, m), most), cost + 1 - match)
        states = after
        out.append(min(states.values()))
    return out


def test_masks_hit_every_overlap():
    long, short = fewest_substitutions(D.MASKS, 150), fewest_substitutions(D.SHORT_MASKS, 7)
    assert all(long[n - 1] > n // 5 for n in range(7, 151)) and all(short[n - 1] > n // 5 for n in range(4, 7))


def test_a_benchmark_in_parts(spark):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20)), 0) for i in range(30)]
    docs = [(i, f"x {items[i][1]} y {items[-1 - i][1]}", 0, 0) for i in range(20)]
    found = [{(r.doc_id, r.item_id, r.matches, r.doc_start) for r in D.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), part_tokens=n).collect()} for n in (50, 1 << 20)]
    assert found[0] == found[1] and len(found[0]) >= 40
    assert D.clean_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), part_tokens=50).count() == 0


def test_null_and_repeated_ids(spark):
    item = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(None, item, 0, 0), (None, "q r", 0, 0), (3, item, 0, 0), (3, "other words here", 0, 0), (4, None, 0, 0)], DOCS)
    items = spark.createDataFrame([(None, item, 0), (9, item, 0), (9, item, 0)], ITEMS)
    assert {(r.doc_id, r.item_id) for r in D.overlaps(docs, items).collect()} == {(None, None), (None, 9), (3, None), (3, 9)}
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in D.clean_documents(docs, items).collect() if r.doc_id) == [(False, 3, "other words here"), (False, 4, None)]
    assert D.clean_documents(docs, items).count() == 3


def test_repetitive_texts(spark):
    items = [(i, ("the of " * 10) + f"end{i} of it", 0) for i in range(20)]
    docs = [(1, "the of " * 20_000, 0, 0), (2, "of " * 40_000, 0, 0)]
    began = time.time()
    found = D.overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, i) for i in range(20)} and all(r.matches >= 20 for r in found)
    assert time.time() - began < 30

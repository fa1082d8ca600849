import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_packing import ODD
from tokenizers import Tokenizer

from textmill.llm import cost_packing as P
from textmill.llm.shared import vocabulary


def naive(sizes, capacity, linear):
    """The method by looking at every sequence for every piece."""
    lengths = P.room_for(sum(sizes), capacity)
    rooms, costs, out = list(lengths), [0] * len(lengths), []
    waiting = {n: [(i, 0) for i, size in enumerate(sizes) if size == n] for n in range(capacity + 1)}
    for n in range(capacity, 0, -1):
        for i, start in waiting[n]:
            fits = lambda least: [s for s, r in enumerate(rooms) if r >= least]  # noqa: B023, E731
            cheapest = fits(n) or fits((n + 1) // 2) or fits(max(rooms))
            s = min(cheapest, key=lambda s: (costs[s], s))
            m = min(n, rooms[s])
            out.append((i, start, m, s, lengths[s] - rooms[s]))
            rooms[s] -= m
            costs[s] += m * (linear + m)
            if m < n:
                waiting[n - m].append((i, start + m))
    return out, lengths, costs


@pytest.mark.parametrize("seed", range(12))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 100])
    sizes = sorted((rng.choice([1, capacity, rng.randint(1, capacity), rng.randint(1, 5)]) for _ in range(rng.randrange(1, 150))), reverse=True)
    assert P.balanced(np.array(sizes), capacity, 7) == naive(sizes, capacity, 7)


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and all(r.length > 0 and r.doc_tokens == len(ids[i]) for r in own)
        assert sum(r.length for r in own) == len(ids[i])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert n == capacity or n < capacity and n & (n - 1) == 0
        assert all(r.sequence_length == n and r.sequence_cost == sum(x.length * (P.LINEAR + x.length) for x in own) for r in own)
    return by_doc, by_sequence


@pytest.mark.parametrize("block", [300, 1 << 22])
def test_pack(spark, block):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choices(["the", "stone", "an", "tion", "è"], k=rng.randrange(0, 90))) for i in range(600)} | {1000 + i: t for i, t in enumerate(ODD)} | {2000: "word " * 3000}
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, START int, ids string")
    check(P.pack(docs, capacity=64, block_tokens=block).collect(), texts, 64)


def test_balance(spark):
    """On sf0.01: no padding, few documents cut that fit a sequence, and costs of mixed sequences near each other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = check(P.pack(docs).collect(), texts, 1024)
    fit = [own for own in by_doc.values() if own[0].doc_tokens <= 1024]
    cut = sum(len(own) > 1 for own in fit)
    mixed = [own[0].sequence_cost for own in by_sequence.values() if len(own) > 1 and own[0].sequence_length == 1024]
    print("cut", cut, "of", len(fit), "spread", np.std(mixed) / np.mean(mixed))
    assert cut < 0.25 * len(fit) and np.std(mixed) < 0.05 * np.mean(mixed)


def test_empty_repeated_and_null(spark):
    schema = "doc_id long, text string"
    assert P.pack(spark.createDataFrame([], schema)).collect() == []
    out = P.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "a b")], schema)).collect()
    assert sorted((r.doc_id or 0, r.start, r.doc_tokens) for r in out if r.start == 0) == [(0, 0, 1), (0, 0, 3), (1, 0, 2), (1, 0, 2)]
    assert sum(r.length for r in out) == 8 and {r.sequence_length & (r.sequence_length - 1) for r in out} == {0}

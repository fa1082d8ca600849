import random
import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from textmill.llm import maxent as M

SCHEMA = "doc_id long, text string, word long, n long"


def corpus(n=300):
    rng = random.Random(1)
    kinds = [["the", "of", "stone", "Ation", "ring"], ["le", "la", "eaux", "ment", "é"], ["der", "und", "keit", "ung", "ö"]]
    rows = []
    for i in range(n):
        k = rng.choice(kinds)
        rows.append((i, " ".join("".join(rng.choices(k, k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.randrange(0, 80)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "x " * 100_000), (5, "the of")]


def split(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w.decode()) for w in (text or "").encode().split()] + [None]


@pytest.mark.parametrize("head", [20, 1 << 18])
def test_base_score(spark, head):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    trained = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in trained for w in split(t))
    n, v = sum(c.values()), len(c)
    expected = sorted((i, len(ws), sum(c[w] > 0 for w in ws), round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, t in rows for ws in [split(t)])
    out = M.score(docs, ~M.held_out(), head=head).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == expected
    assert {r.train_tokens for r in out} == {n}
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small(spark, rounds=M.ROUNDS, head=50):
    rows = [(i, t) for i, t in corpus(80) if len(t or "") < 5000]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    counts = M.vocabulary(docs).collect()
    return rows, docs, counts, M.train(docs, M.start(spark.createDataFrame(counts), head)[0], rounds)


def chances(m, context, kind_of):
    """By walking every softmax: log probability of each outcome among the classes, and of each member of each class."""
    softmax = lambda z: z - np.log(np.exp(z).sum())
    def at(k, salt):
        rows = [int((((int(c) + salt) % 2**64) * int(M._B) % 2**64) >> (65 - len(m.weight[k]).bit_length())) for c in (context if not k else [context[n] for n in M.INSIDE])]
        return sum(m.weight[k][r].astype(float) for r in rows)
    top = softmax(m.prior[0] + at(0, 0))
    out = {}
    for k in range(M.CLASSES):
        d = int(m.depth[k])
        for number in range(int(m.rare[k]) + 1):
            digits = [number // M.FAN ** (d - 1 - level) % M.FAN for level in range(d)]
            p = top[M.OWN + k]
            for level, digit in enumerate(digits):
                node = int(m.base[k, level]) + number // M.FAN ** (d - level)
                p += softmax(m.prior[1][node] + at(1, (node + 1) * int(M._A)))[digit]
            out[k, number] = p
    return top, out


def test_scores_and_probabilities(spark):
    """Scores are those of the walk through all softmaxes, and all tokens' probabilities add up to one after each context."""
    rows, docs, counts, m = small(spark)
    assert min(np.abs(w).max() for w in m.weight) > 0 and m.depth.max() >= 1
    c = {np.uint64(r.word % 2**64): r.c for r in counts}
    place = {h: (int(t), int(n), int(x)) for h, t, n, x in zip(m.head, m.top, m.member, m.head_count)}
    score = {}
    for r in M.scores(docs, spark.sparkContext.broadcast(m)).where("word is null").collect():
        score[r.doc_id] = (r.counted + r.rest, r.n)
    for i, text in rows[:4] + rows[-4:-1]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        hashes, ending, cuts = M.tokens(data, np.array([0, len(data)]))
        kind, _ = m.places(*m.known(hashes), ending)
        total = 0.0
        for t, context in enumerate(zip(*M.features(hashes, kind, cuts))):
            top, members = chances(m, context, kind)
            if t < 2:
                everything = np.exp(top[: M.OWN]).sum() + sum(np.exp(p) for p in members.values())
                assert abs(everything - 1) < 1e-5
            if hashes[t] in place:
                k, n, x = place[hashes[t]]
                total += (top[k] if k < M.OWN else members[k - M.OWN, n]) / np.log(10)
            else:  # its count comes by the join
                k = int(m.class_of[ending[t]])
                total += members[k, int(m.rare[k])] / np.log(10) - m.tail[k]
        if i != 5:  # two rows have this id
            assert abs(total - score[i][0]) < 1e-3 * score[i][1]
    # the tail's shares: each count plus one, and one for unknown tokens
    tail = np.ones(M.CLASSES)
    for r in counts:
        if np.uint64(r.word % 2**64) not in place:
            tail[m.class_of[r.ending]] += r.c + 1
    assert np.allclose(np.log10(tail), m.tail)


def test_gradient(spark):
    """Against sums over tokens one by one, before any training."""
    rows, docs, counts, m = small(spark, rounds=0)
    found = {r.row: M._long(np.frombuffer(r.sums, "<u2")).reshape(2, -1) for r in M.gradient(docs, spark.sparkContext.broadcast(m)).collect()}
    expected = {}
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        hashes, ending, cuts = M.tokens(data, np.array([0, len(data)]))
        kind, member = m.places(*m.known(hashes), ending)
        for own, k, rows_, prior, outcome in m.softmaxes(M.features(hashes, kind, cuts), kind, member):
            for t in range(len(outcome)):
                p = np.exp((prior if prior.ndim == 1 else prior[t]).astype(float))
                p /= p.sum()
                for r in rows_:
                    e = expected.setdefault((k << 32) + int(r[t]), np.zeros((2, len(p))))
                    e[0] -= p
                    e[0, outcome[t]] += 1
                    e[1] += p
    assert found.keys() == expected.keys()
    assert all(np.allclose(found[k], expected[k], rtol=0.02, atol=0.02) for k in found)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0, 0)], SCHEMA)
    (row,) = M.score(docs, M.F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and np.isfinite(row.score)
    assert M.score(docs.limit(0), M.F.lit(True)).collect() == []


def test_rows_are_added_without_sorting():
    """Many rows of a table, some often: the sums are right, small shares aren't lost on large ones, and it takes less time than to sort rows first."""
    rng = np.random.default_rng(2)
    rows = [np.minimum(rng.zipf(1.3, 20_000), 1 << 15).astype(np.int64) for _ in range(2)]
    values = rng.random((20_000, 16), np.float32)
    total = np.full((1 << 16, 16), 2.0**26)
    M._add(total, rows, values)
    assert np.allclose(total - 2.0**26, np.stack([sum(np.bincount(r, values[:, k], 1 << 16) for r in rows) for k in range(16)], 1), atol=1e-4)

    def by_sorting():
        """Short numbers sort faster, and only rows that occur again are summed up first."""
        for r in rows:
            order = np.argsort(r.astype(np.uint16), kind="stable")
            ordered = r[order]
            first = np.append(True, ordered[1:] != ordered[:-1])
            alone = first & np.append(first[1:], True)
            total[r[order[alone]]] += values[order[alone]]
            order, first = order[~alone], np.flatnonzero(first[~alone])
            total[r[order[first]]] += np.add.reduceat(values[order], first, axis=0)

    def seconds(add):
        start = time.perf_counter()
        add()
        return time.perf_counter() - start

    assert min(seconds(lambda: M._add(total, rows, values)) for _ in range(15)) < 0.85 * min(seconds(by_sorting) for _ in range(15))


def least(f, n=15):
    out = []
    for _ in range(n):
        start = time.perf_counter()
        f()
        out.append(time.perf_counter() - start)
    return min(out)


def test_tokens_are_found_in_the_head():
    """By their first bits: as by a search through all of it, where many share these bits as well, in less time."""
    rng = np.random.default_rng(3)
    head = np.unique(np.concatenate([rng.integers(0, 1 << 64, 250_000, np.uint64, endpoint=False), np.arange(1 << 40, (1 << 40) + 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    asked = np.concatenate([rng.choice(head[1:-1], 15_000), rng.integers(0, 1 << 64, 5_000, np.uint64, endpoint=False), head[:600], head[:600] + np.uint64(1), head[-3:]])
    for h in (head, head[1:-1], head[:1], head[:0]):
        m = M.Model(h, *[None] * 10)
        inside, at = m.known(asked)
        assert (inside == np.isin(asked, h)).all() and (h[at[inside]] == asked[inside]).all()
    m = M.Model(head, *[None] * 10)
    m.known(asked)
    assert least(lambda: m.known(asked)) < 0.85 * least(lambda: head[np.minimum(np.searchsorted(head, asked), len(head) - 1)] == asked)


def softmax_tables(rng, largest):
    weight = [(rng.random((1 << 14, M.TOP)) * 2 - 1) * largest, (rng.random((1 << 16, M.FAN)) * 2 - 1) * largest]
    prior = [np.log(rng.dirichlet(np.ones(M.TOP))), np.maximum(np.log(rng.dirichlet(np.full(M.FAN, 0.1), 1000)), -30)]
    return M.Model(*[None] * 9, [x.astype(np.float32) for x in prior], [x.astype(np.float32) for x in weight])


@pytest.mark.parametrize("largest", [3, 100])
def test_odds(largest):
    """Odds are the powers of the logits, however large these are, and no power is taken for each token: it takes less time than by logits."""
    rng = np.random.default_rng(4)
    m = softmax_tables(rng, largest)
    powered = m.powered()
    rows, nodes = [rng.integers(0, 1 << 16, 16_000) for _ in M.INSIDE], rng.integers(0, 1000, 16_000)

    def by_logits():
        z = m.weight[1].take(rows[0], axis=0)
        z += m.weight[1].take(rows[1], axis=0)
        z += m.prior[1][nodes]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(1, keepdims=True)

    def by_odds():
        z, whole = powered.odds(1, rows, powered.prior[1].take(nodes, axis=0))
        z /= whole[:, None]
        return z

    z = m.weight[1][rows[0]].astype(float) + m.weight[1][rows[1]] + m.prior[1][nodes]
    expected = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(by_odds(), expected / expected.sum(1, keepdims=True), rtol=1e-4, atol=1e-7)
    assert largest > 3 or least(by_odds) < 0.85 * least(by_logits)


def test_rows_are_added_by_outcome():
    """Many arrays at once: the sums are those of adding in place, small shares aren't lost on large ones, and it takes less time."""
    rng = np.random.default_rng(5)
    rows = [[rng.integers(0, 1 << 16, 10_000) for _ in M.INSIDE] for _ in range(12)] + [[np.zeros(9_000, np.int64)] * 2]
    values = [rng.random((len(r[0]), 16), np.float32) for r in rows]
    by_outcome, in_place = np.full((16, 1 << 16), 2.0**26), np.full((1 << 16, 16), 2.0**26)

    def places():
        for r, v in zip(rows, values):
            M._add(in_place, r, v)

    M._add_by_outcome(by_outcome, rows, values)
    places()
    assert np.allclose(by_outcome.T - 2.0**26, in_place - 2.0**26, atol=1e-4)
    assert least(lambda: M._add_by_outcome(by_outcome, rows, values), 5) < 0.85 * least(places, 5)

import hashlib
import random

import numpy as np
import pytest

from textmill.llm import byte_dedup as B
from textmill.llm import word_dedup as W
from textmill.llm import phrases
from textmill.llm.shared import keyed


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if (w := data[s : s + length]) in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, length):
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, ws in sorted(split.items()):
        for s in range(len(ws) - length + 1):
            first.setdefault(tuple(ws[s : s + length]), i)
    for i, ws in split.items():
        gone = [False] * len(ws)
        for s in range(len(ws) - length + 1):
            if first[tuple(ws[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        out[i] = (len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "stone", "è", "über", "a", "|", "tion", "re\n", " x", "longerword"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passages = [text(n) for n in (12, 30, 60, 90)]
    rows = [(0, None), (1, ""), (2, "a"), (3, "ab " * 400), (4, "ab " * 500), (5, "z" * 700), (6, "q" + "z" * 300)]
    for i in range(10, 90):
        parts = [text(rng.randrange(0, 60))] + [x for _ in range(rng.randrange(0, 4)) for x in (rng.choice(passages), text(rng.randrange(0, 20)))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(100 + i, t) for i, t in rows[20:30]] + [(200, rows[40][1] + " end")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, starts string, anchor int").repartition(3)


@pytest.mark.parametrize("length,gram,hot,group,wide", [(100, 32, 1000, 20_000, 1000), (20, 7, 1000, 20_000, 1000), (20, 7, 8, 4, 1000), (100, 24, 3, 20_000, 4)])
def test_bytes(spark, monkeypatch, length, gram, hot, group, wide):
    monkeypatch.setattr(phrases, "WIDE", wide)
    monkeypatch.setattr(phrases, "LEAST_HOT", hot)
    monkeypatch.setattr(phrases, "GROUP", group)
    rows = corpus(1)
    docs = keyed(frame(spark, rows))
    out = B.without_bytes(docs, B.duplicate_bytes(docs, length, gram)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_bytes(rows, length)


@pytest.mark.parametrize("length,gram,hot,group,wide", [(50, 12, 1000, None, 1000), (10, 4, 1000, None, 1000), (10, 4, 8, 4, 1000), (10, 4, 8, None, 2)])
def test_words(spark, monkeypatch, length, gram, hot, group, wide):
    monkeypatch.setattr(phrases, "WIDE", wide)
    monkeypatch.setattr(phrases, "LEAST_HOT", hot)
    rows = corpus(2)
    docs = keyed(frame(spark, rows))
    out = W.without_words(docs, W.copies(docs, length, gram, group), length).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_words(rows, length)


@pytest.mark.parametrize("group,hot", [(20_000, 1000), (3, 5)])
def test_long_documents_in_parts(spark, monkeypatch, group, hot):
    monkeypatch.setattr(phrases, "LEAST_HOT", hot)
    rng = random.Random(5)
    long = " ".join(rng.choices(["ab", "c", "def", "gh", "ijk", "lm"], k=4000))
    rows = [(1, long), (2, long[3000:7000]), (3, "q " + long[:5000] + " z"), (4, "short")]
    docs = keyed(frame(spark, rows))
    out = W.without_words(docs, W.copies(docs, 9, 4, group, 300), 9).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_words(rows, 9)
    out = B.without_bytes(docs, B.duplicate_bytes(docs, 30, 9, group, 700)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_bytes(rows, 30)


def test_empty(spark):
    docs = keyed(frame(spark, []))
    assert B.without_bytes(docs, B.duplicate_bytes(docs)).collect() == []
    assert W.without_words(docs, W.copies(docs)).collect() == []


def test_null_and_repeated_ids(spark):
    """Rows of one doc_id with other texts are documents of their own to op8, and never each other's sources to op9."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = [(None, "n " + long), (1, long), (1, long), (2, "b " + long + " e"), (2, long + " f"), (None, None), (3, "short")]
    docs = keyed(frame(spark, rows))
    out = {(r.doc_id, r.n_words, r.n_removed) for r in W.without_words(docs, W.copies(docs)).collect()}
    assert out == {(None, 81, 0), (1, 80, 80), (2, 82, 80), (2, 81, 80), (None, 0, 0), (3, 1, 0)}
    order = sorted({(r.id, r.sub, r.text) for r in docs.collect()}, key=lambda x: x[:2])
    brute = brute_bytes([(k, text) for k, (_, _, text) in enumerate(order)], 100)
    out = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in B.without_bytes(docs, B.duplicate_bytes(docs)).collect()}
    assert out == {(i if i > 0 else None, *brute[k]) for k, (i, _, _) in enumerate(order)} and len(order) == 6
    alone = keyed(frame(spark, [(5, long), (5, long)]))
    assert {r.n_removed for r in B.without_bytes(alone, B.duplicate_bytes(alone)).collect()} == {0}


def test_many_rivals_are_joined_with_documents(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAPPED", 3)
    rows = corpus(4)
    docs = keyed(frame(spark, rows))
    out = B.without_bytes(docs, B.duplicate_bytes(docs, 20, 7)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_bytes(rows, 20)
    out = W.without_words(docs, W.copies(docs, 10, 4), 10).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_words(rows, 10)


@pytest.mark.parametrize("near", [False, True])
def test_windows_around_a_common_passage_stay_in_tasks(spark, monkeypatch, near):
    """Many texts hold one passage that is shorter than a window: their other words tell them apart run by run. Near copies come out window by window only where many agree."""
    monkeypatch.setattr(phrases, "WIDE", 8)
    monkeypatch.setattr(phrases, "LEAST_HOT", 8)
    rng = random.Random(12)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = own(30), own(70)
    rows = []
    for i in range(120):
        words = own(40) + passage + own(40)
        if near and i % 3 == 0:
            words = base[:30] + passage + base[30:]
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    tables = {}
    monkeypatch.setattr(W, "saved", lambda df, name, saved=W.saved: tables.setdefault(name, saved(df, name)))
    docs = keyed(frame(spark, rows))
    out = W.without_words(docs, W.copies(docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_words(rows, 50)
    windows = tables["compared"].where("window is not null").count()
    assert windows < 400 if near else windows == 0


def test_runs_of_phrases_cover_their_windows():
    """Each window is in one run, and equal windows are in runs with one hash, whatever stands around them."""
    rng = random.Random(13)
    L, k, step = 20, 5, 4
    common = np.array([rng.randrange(1, 2**63) for _ in range(26)], np.uint64)
    texts = [np.concatenate([np.array([rng.randrange(1, 2**63) for _ in range(n)], np.uint64), common, np.array([rng.randrange(1, 2**63) for _ in range(40)], np.uint64)]) for n in (30, 7, 55)]
    seen = {}
    for raw in texts:
        text, start, n, trigger, _, ahead = phrases.phrases(raw, np.array([0, len(raw)]), L, k)
        phrase, first, windows, core = phrases.cores(raw, trigger, start + ahead, ahead, n, L, step)
        assert sorted((p, f + x) for p, f, w in zip(phrase, first, windows) for x in range(w)) == sorted((p, x) for p, w in enumerate(n) for x in range(w))
        for p, f, w, c in zip(phrase, first, windows, core):
            for x in range(w):
                at = int(start[p] + f + x)
                seen.setdefault(raw[at : at + L].tobytes(), []).append(int(c))
    assert sum(len(c) == 3 for c in seen.values()) == 7 and all(len(set(c)) == 1 for c in seen.values())


def test_suffix_ranks():
    rng = random.Random(10)
    strings = ["".join(rng.choices("ab", k=rng.randrange(1, 40))) for _ in range(60)]
    codes = np.zeros((60, 40), np.int16)
    for row, x in zip(codes, strings):
        row[40 - len(x) :] = [ord(c) for c in x]
    ranks = B.suffix_ranks(codes)
    suffixes = {(i, 40 - n): x[len(x) - n :] for i, x in enumerate(strings) for n in range(1, len(x) + 1)}
    order = {x: k + 1 for k, x in enumerate(sorted(set(suffixes.values())))}
    assert all(ranks[place] == order[x] for place, x in suffixes.items()) and (ranks[codes == 0] == 0).all()


def test_corpus_order_is_sorted():
    """Windows of phrases around one trigger come in the order of their bytes, cut at the window's length."""
    rng = random.Random(11)
    L, k = 20, 6
    lefts, rights = (["".join(rng.choices("ab", k=L)) for _ in range(4)] for _ in range(2))
    ahead, raw = [], []
    for _ in range(80):
        before = rng.randrange(0, L - k + 1)
        windows = rng.randrange(1, before + 2)
        ahead.append(before)
        raw.append((rng.choice(lefts)[L - before :] + "!trig~" + rng.choice(rights)).encode()[: L + windows - 1])
    ahead = np.array(ahead)
    phrase, step, same = B.corpus_order(ahead, raw, L, k)
    found = [raw[p][s : s + L] for p, s in zip(phrase, step)]
    assert found == sorted(found) and [False, *(x == y for x, y in zip(found, found[1:]))] == same.tolist() and any(same)


def test_factors_go_left_to_right():
    """Two copies of 80 and 60 words that overlap by 20: the second factor has 40 words and counts by its boundary check."""
    sources = np.array([[1, 0, 0], [1, 0, 20], [2, 0, 500]])
    begins, ends, _ = W.factored(np.array([0, 20, 60]), np.array([70, 80, 120]), sources)
    assert list(zip(begins, ends)) == [(0, 80), (80, 120)]
    assert W.spans([0, 20, 60], [70, 80, 120], [1, 1, 2], [0, 0, 0], [0, 20, 500], 50) == ([0, 60], [80, 120], 2)
    assert W.spans([5], [30], [1], [0], [0], 50) == ([], [], 1)

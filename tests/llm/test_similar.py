import random
from itertools import combinations

import pytest

from textmill.llm import simhash as S
from textmill.llm.similar import similar

COLUMNS = "doc_id long, text string, source string"


def jaccard(x, y, size=5):
    s, t = (set(S.shingles((v or "").encode(), size)) for v in (x, y))
    return len(s & t) / len(s | t) if s | t else 1.0


def brute_kept(rows, least=0.8, size=5):
    """Doc_ids that stay where all pairs are compared."""
    low = {i: i for i, _ in rows}
    pairs = [(i, j) for (i, x), (j, y) in combinations(rows, 2) if i != j and jaccard(x, y, size) >= least]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(low[i], low[j])
            changed |= (low[i], low[j]) != (m, m)
            low[i] = low[j] = m
    return {i for i in low if low[i] == i}


def varied(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def test_near_copies_under_a_shared_fingerprint(spark):
    """A repeated line makes the fingerprint, the tails the set: 1 is unlike 2 and 3, which are near copies."""
    rng = random.Random(1)
    line = [f"line{j}" for j in range(7)] * 400
    tail, other = ([f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "xy")
    rows = [(1, " ".join(line + other)), (2, " ".join(line + tail)), (3, " ".join(line + tail[:-1])), (4, " ".join(line + tail[:-6]))]
    assert len({S.fingerprint(t.encode(), 5) for _, t in rows}) == 1 and jaccard(rows[1][1], rows[2][1]) >= 0.8
    kept = S.kept_documents(spark.createDataFrame([(*r, "s") for r in rows], COLUMNS), 5, 5, 0.8)
    assert kept.columns == ["doc_id", "text", "source"]
    assert {r.doc_id for r in kept.collect()} == brute_kept(rows) == {1, 2}


@pytest.mark.parametrize("rows,chars", [(256, 1 << 22), (7, 1 << 22), (256, 3000), (1, 1 << 22)])
def test_groups_in_blocks(spark, rows, chars):
    """One group of several families that drift, whatever the size of the blocks."""
    rng = random.Random(2)
    texts = []
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(12):
            texts.append(" ".join(words))
            words = varied(rng, words, rng.choice((1, 1, 2, 3)))
    rng.shuffle(texts)
    table = [*enumerate(texts), (500, "a b"), (501, "A  b"), (502, None), (503, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    groups = spark.createDataFrame([(i, 0) for i, _ in table], "doc_id long, group long")
    edges = [(r.a, r.b) for r in similar(docs, groups, 5, 0.8, rows, chars).collect()]
    text = dict(table)
    assert all(a != b and jaccard(text[a], text[b]) >= 0.8 for a, b in edges)
    low = {i: i for i in text}
    for _ in text:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {i for i in low if low[i] == i} == brute_kept(table)


def test_recall_at_the_threshold(spark):
    """Texts of 100 words with one to three changed ones, most of which fingerprints alone miss."""
    rng = random.Random(3)
    rows, far = [], 0
    for i in range(0, 400, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(varied(rng, words, rng.choice((1, 2, 3)))))]
        far += jaccard(rows[-2][1], rows[-1][1]) >= 0.8 and ((S.fingerprint(rows[-2][1].encode(), 5) ^ S.fingerprint(rows[-1][1].encode(), 5)) & (2**64 - 1)).bit_count() > 5
    expected = {i for i, _ in rows[::2]} | {j for (_, x), (j, y) in zip(rows[::2], rows[1::2], strict=True) if jaccard(x, y) < 0.8}
    assert far > 50 and 200 < len(expected) < 350
    kept = S.kept_documents(spark.createDataFrame([(*r, "s") for r in rows], COLUMNS), 5, 5, 0.8)
    assert {r.doc_id for r in kept.collect()} == expected

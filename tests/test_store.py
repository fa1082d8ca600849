"""The stored index is replaced as a whole: a reader sees it as it was or as it is."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.operators import search as S
from textmill.operators import store

DOCS = "doc_id long, text string, source string"
WORDS = S.match_any("alpha beta")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def content(index):
    passages = sorted((r.doc_id, r.segment, r.text) for r in index.table("passages").collect())
    postings = sorted((r.doc_id, r.segment, r.term, tuple(r["at"]), r.tf) for r in index.table("postings").collect())
    states = sorted((r.doc_id, r.passages) for r in index.table("states").collect())
    stats = index.table("stats").agg(F.sum("rows"), F.sum("total")).first()
    return passages, postings, states, tuple(stats)


def expected(rows):
    passages = sorted((i, k, line) for i, text, _ in rows for k, line in enumerate(text.split("\n")) if line.strip())
    places = {}
    for i, k, line in passages:
        for n, t in enumerate(line.split()):
            places.setdefault((i, k, t), []).append(n)
    postings = sorted((*key, tuple(at), len(at)) for key, at in places.items())
    states = sorted((i, sum(p[0] == i for p in passages)) for i, _, _ in rows)
    return passages, postings, states, (len(passages), sum(len(line.split()) for *_, line in passages))


ROWS = [(i, f"alpha {i} beta alpha\n \nbeta w{i}\n" + "alpha beta x " * (80 if i == 3 else 1), "s") for i in range(40)]
CHANGED = [(3, "beta beta", "s"), (100, "alpha", "t"), (7, "", "s")]
GONE = [(5,), (6,)]
AFTER = [r for r in ROWS if r[0] not in (3, 5, 6, 7)] + CHANGED


def replaced(spark, index):
    return store.replace(index, docs(spark, CHANGED), spark.createDataFrame(GONE, "doc_id long"))


def test_build_and_replace(spark, tmp_path):
    first = store.build(docs(spark, ROWS), str(tmp_path / "i"), "source", buckets=5)
    assert content(first) == expected(ROWS) == content(store.opened(spark, str(tmp_path / "i")))
    before = store.hits(first, WORDS).count()
    second = replaced(spark, first)
    assert content(second) == expected(AFTER) == content(store.opened(spark, str(tmp_path / "i")))
    # the reader that had it open before still sees all of what was there
    assert content(first) == expected(ROWS) and store.hits(first, WORDS).count() == before
    assert len(second.parts) == 2 and second.number == 2
    # of two that start from the same state the second fails, and leaves the index as it is
    with pytest.raises(FileExistsError):
        replaced(spark, first)
    third = store.replace(second, docs(spark, AFTER), spark.createDataFrame([], "doc_id long"))
    assert content(store.cleared(third)) == expected(AFTER) and len(third.parts) <= 2
    assert content(store.opened(spark, str(tmp_path / "i"))) == expected(AFTER)


def test_only_changes_are_written(spark, tmp_path, monkeypatch):
    """A replacement holds what has changed, not what stays; scores are those of an index of all that is there."""
    first = store.build(docs(spark, ROWS), str(tmp_path / "i"), "source", buckets=2)
    second = replaced(spark, first)
    written = spark.read.parquet(f"{second.path}/{second.parts[-1][0]}/passages")
    assert {r.doc_id for r in written.select("doc_id").collect()} == {3, 100}
    found = lambda index: sorted((r.doc_id, r.segment, r.dl, round(r.score, 9)) for r in store.hits(index, WORDS).collect())
    whole = lambda rows, name: found(store.build(docs(spark, rows), str(tmp_path / name), "source", buckets=1))
    assert found(second) == whole(AFTER, "second")
    third = store.replace(second, docs(spark, []), spark.createDataFrame([(3,), (8,), (100,), (999,)], "doc_id long"))  # nothing new
    left = [r for r in AFTER if r[0] not in (3, 8, 100)]
    assert content(third) == expected(left) and found(third) == whole(left, "third") and len(third.parts) == 3
    back = store.replace(third, docs(spark, [(3, "alpha gamma", "s")]), spark.createDataFrame([], "doc_id long"))
    left = sorted([*left, (3, "alpha gamma", "s")])
    assert content(back) == expected(left) == content(store.opened(spark, back.path)) and found(back) == whole(left, "back")
    same = store.replace(back, docs(spark, []), spark.createDataFrame([], "doc_id long"))
    assert content(third) != content(back) == content(same)
    monkeypatch.setattr(store, "MOST_PARTS", 4)
    anew = store.replace(same, docs(spark, [(i, "beta", "s") for i in range(10, 16)]), spark.createDataFrame([(3,)], "doc_id long"))
    left = [(i, "beta" if 10 <= i < 16 else text, s) for i, text, s in left if i != 3]
    assert content(store.cleared(anew)) == expected(left) and found(anew) == whole(left, "anew") and not anew.parts[-1][0].endswith(store.CHANGES)


@pytest.mark.parametrize("writes", range(5))
def test_failure_between_writes(spark, tmp_path, monkeypatch, writes):
    path = str(tmp_path / "i")
    index = store.build(docs(spark, ROWS), path, "source", buckets=3)
    done = []

    def failing(function):
        def call(*args):
            if len(done) == writes:
                raise RuntimeError("broken off")
            done.append(1)
            return function(*args)

        return call

    monkeypatch.setattr(store, "_put", failing(store._put))
    monkeypatch.setattr(store, "_point", failing(store._point))
    with pytest.raises(RuntimeError):
        replaced(spark, index)
    monkeypatch.undo()
    assert content(store.opened(spark, path)) == expected(ROWS)
    assert content(replaced(spark, store.opened(spark, path))) == expected(AFTER)


def test_postings_of_short_and_long_passages(spark, tmp_path):
    lines = ["b a b", "a", "  ", " ".join(["x", "y"] * 64), " ".join(["x", "y"] * 64 + ["z"]), "--"]
    docs = spark.createDataFrame([(1, "\n".join(lines), "s"), (2, None, "t"), (3, "a", None)], "doc_id long, text string, source string")
    index = store.build(docs, str(tmp_path / "places"), "source", buckets=2)
    wanted = {(1, i, t, "s"): [j for j, w in enumerate(line.split()) if w == t] for i, line in enumerate(lines[:5]) for t in set(line.split())} | {(3, 0, "a", None): [0]}
    found = index.table("postings").collect()
    assert {(r.doc_id, r.segment, r.term, r.source): r["at"] for r in found} == wanted and all(r.tf == len(r["at"]) for r in found) and len(found) == len(wanted)


def test_postings_are_not_shuffled(spark):
    lines = ["b a b", " ".join(["x", "y"] * 200), "a"]
    passages = store._passages(spark.createDataFrame([(1, "\n".join(lines), "s")], DOCS), 2, ("source",)).localCheckpoint()
    postings = store._postings(passages, ("source",))
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    assert {(r.segment, r.term): r.tf for r in postings.collect()} == {(0, "a"): 1, (0, "b"): 2, (1, "x"): 200, (1, "y"): 200, (2, "a"): 1}


@pytest.mark.parametrize("at_once", [1, 3, 4, 7, 100])
def test_postings_taken_some_tokens_at_once(monkeypatch, at_once):
    monkeypatch.setattr(store, "AT_ONCE", at_once)
    texts = [["b", "a", "b"], ["a"], list("vwxyz"), ["a", "a"], ["z"]]
    table = pa.table({"dl": pa.array([len(t) for t in texts], pa.int32()), "tokens": texts, "doc_id": range(5)})
    out = pa.Table.from_batches(store._places(iter(table.to_batches(max_chunksize=2)), ["doc_id"])).to_pylist()
    assert sorted((r["doc_id"], r["term"], r["at"]) for r in out) == sorted((i, w, [j for j, x in enumerate(t) if x == w]) for i, t in enumerate(texts) for w in set(t))


def test_windows_work_their_lines_out_once(spark):
    from textmill.plans import retrieval

    plan = retrieval.expanded_windows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "term#" not in plan and "Generate" not in plan  # hits and the lines of their documents are written, and read

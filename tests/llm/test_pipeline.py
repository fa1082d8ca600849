import os
import random
from collections import Counter

import corpus_pipeline as C
from textmill.llm import packing
from textmill.llm.shared import table


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(6)
    kinds = {"en": ["the", "tion", "ing", "wh", "st"], "de": ["der", "keit", "ung", "sch", "ü"]}
    text = lambda lang, n: " ".join("".join(rng.choices(kinds[lang], k=rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(30, 300)), lang, "s", 0) for i in range(200) for lang in [rng.choice(list(kinds))]]
    item = text("en", 30)
    base = text("de", 1500)
    words = base.split()
    words[700] = "changed"  # a few bits of the fingerprint
    rows += [(300, None, "en", "s", 0), (301, "### 12", "en", "s", 0), (302, rows[7][1].replace(" ", "\n "), None, "s", 0), (303, text("en", 40) + " " + item, "en", "s", 0), (304, base, "de", "s", 0), (305, " ".join(words), "de", "s", 0)]
    # null and repeated ids: rows are decided on one by one
    rows += [(None, "### 7", "en", "s", 0), (None, text("en", 50), None, "s", 0), (7, "%%% 8", "en", "s", 0), (304, rows[9][1], "de", "s", 0), (None, item + " x", "en", "s", 0), (400, base, "de", "t", 0), (400, base, "de", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    gone, now = [], table(spark, str(tmp_path), "documents")
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns
        path = str(tmp_path / f"stage{k}")
        after.write.parquet(path)
        after = spark.read.parquet(path)
        left = Counter((r.doc_id, r.text) for r in now.collect())
        left.subtract((r.doc_id, r.text) for r in after.collect())
        assert all(r.lang for r in after.collect())
        gone.append(sorted((i or -1, (t or "")[:5]) for (i, t), n in left.items() for _ in range(n)))
        now = after
    start = lambda i: (i, dict((r[0], r[1]) for r in rows[:206])[i][:5])
    assert gone[0] == [(-1, "### 7"), (7, "%%% 8"), (300, ""), (301, "### 1")]
    assert gone[1] == sorted([start(302), (304, rows[9][1][:5]), (400, base[:5]), (400, base[:5])])
    assert gone[2] == [start(305)] and gone[3] == sorted([(-1, item[:5]), start(303)])
    pieces = {(r.doc_id, r.piece) for r in C.STAGES[-1][1](spark, now, str(tmp_path)).collect()}
    assert {i for i, _ in pieces} == set(range(200)) | {304, None}
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    there = set(os.listdir(folder))
    assert {(r.doc_id, r.piece) for r in C.run(spark, str(tmp_path)).collect()} == pieces
    assert [x.partition("-")[0] for x in set(os.listdir(folder)) - there] == ["pack"]  # nothing else is left
    assert packing.CAPACITY == 2048


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []

"""Words that a plain polynomial can't tell apart, and columns of a caller's that are named like those used inside."""

import random

import numpy as np
import pytest
from test_substring_dedup import brute_words

from textmill.llm import chat, decontaminate, exact_dedup, hashing, importance, language, maxent, simhash, word_dedup
from textmill.llm.shared import keyed


def forged():
    """A Thue-Morse word and its complement: equal under every polynomial in an odd base modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("lower", [False, True])
def test_words_are_told_apart(lower):
    one, two = forged()
    data = np.frombuffer(f"{one} {two} {one.upper()} {two}".encode(), np.uint8)
    h = hashing.words(data, np.array([0, len(data)]), lower)[2]
    assert h[0] != h[1] and h[1] == h[3] and (h[0] == h[2]) == lower


def test_word_dedup_of_forged_words(spark):
    words = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{words} {forged()[0]}"), (2, "other"), (3, f"{words} {forged()[1]}"), (4, f"{words} {forged()[1]}")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in word_dedup.without_words(docs, word_dedup.copies(docs)).collect()}
    assert out == brute_words(rows, 50) and out[3][1] == 0 and out[4][1] == 50


def test_null_ids(spark):
    """Rows without doc_id get results of their own, those that their texts get elsewhere."""
    schema = "doc_id long, text string, lang string"
    rng = random.Random(3)
    kinds = {"en": ["the", "tion", "ing"], "de": ["der", "keit", "ung"]}
    text = lambda k: " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(40))
    rows = [(i, text(k), k) for i in range(40) for k in [rng.choice(list(kinds))]]
    rows += [(None, rows[3][1], None), (None, rows[3][1], None), (None, text("de"), "de"), (None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    linked = simhash.near_dedup(docs).collect()
    same = [r for r in linked if r.component_id == 3]
    assert len(linked) == 44 and sorted((r.doc_id is None for r in same)) == [False, True, True] and len({r.fp for r in same}) == 1
    alone = [r for r in linked if r.doc_id is None and r.component_id is None]
    assert len(alone) == 2
    labels = spark.createDataFrame([(i, int(k == "en"), 0) for i, _, k in rows[:20]], "doc_id long, quality int, toxic int")
    weights = importance.resample(docs, labels).collect()
    at = {r.doc_id: r for r in weights if r.doc_id is not None}
    null = sorted((r.n_grams, r.log_weight) for r in weights if r.doc_id is None)
    assert len(weights) == 44 and null[0] == (0, 0.0) and null.count((at[3].n_grams, at[3].log_weight)) == 2
    assert len({round(r.gumbel_key - r.log_weight, 9) for r in weights if r.doc_id is None}) == 1
    net = language.fit(docs)
    told = language.predict(docs, net).collect()
    by = {r.doc_id: r for r in told}
    assert sorted((r.lang_pred, round(r.score, 9)) for r in told if r.doc_id is None)[-1] == ("und", 0.0)
    assert sum(r.doc_id is None and (r.lang_pred, r.score) == (by[3].lang_pred, by[3].score) for r in told) == 2
    scored = maxent.score(docs.select("doc_id", "text"), ~maxent.held_out()).collect()
    own = next(r for r in scored if r.doc_id == 3)
    null = [r for r in scored if r.doc_id is None]
    assert len(scored) == 44 and len(null) == 4 and sum(abs(r.score - own.score) < 1e-6 and r.n_tokens == own.n_tokens for r in null) == 2


def test_null_turns(spark):
    """They come first; the SQL beside it says the same of null roles, too."""
    import duckdb

    rows = [(1, 2, "assistant", "c"), (1, None, None, "a"), (1, 1, None, "b"), (2, None, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    out = {tuple(r) for r in chat.read_back(chat.expand(frame.unionByName(spark.createDataFrame(extra, frame.schema)))).collect()}
    duck = duckdb.connect()
    duck.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = [f.split()[0] for f in chat.DIGEST.split(", ")]
    assert out == set(duck.sql(f"SELECT {', '.join(names)} FROM ({chat.SQL})").fetchall())
    first = chat.expand(frame.where("conv_id = 1")).first().text
    assert [t for _, t in chat.turns(first)] == ["a", "b", "c"]


def test_names_in_other_case(spark):
    schema = "doc_id long, text string, lang string, ROW0 string, LOWERED0 string, FILE0 string, Letters0 string, Row1 string"
    rows = [(i, f"the stone wall number {i} of the river", "en", *(f"{c}{i}" for c in "abcde")) for i in range(30)]
    docs = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([(1, "something else that nobody here says at all")], "item_id long, text string")
    kept = [
        simhash.kept_documents(docs, 5, 2, 1.0), decontaminate.clean_documents(docs, benchmark), exact_dedup.kept_documents(docs),
        language.kept_documents(docs, language.fit(docs.select("doc_id", "text", "lang")), 0.0),
    ]
    for out in kept:
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows

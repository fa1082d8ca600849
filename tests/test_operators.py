import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import sampling as R
from textmill.operators import chunking as C
from textmill.operators import dense as D
from textmill.operators import folds as E
from textmill.operators import matching as X
from textmill.operators import metrics as M
from textmill.operators import search as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_match_all():
    words = lambda raw: [(t.words, t.prefix) for t in S.match_all(raw) or []]
    assert words("contratti causa") == [(("contratt",), True), (("caus",), True)]
    assert words("PERCHÉ") == [(("perch",), True)] and words('"causa illecita" x') == [(("causa", "illecita"), False)]
    assert S.match_all("-x") is None and S.match_all("aiuoe") is None and len(S.match_all("di " * 12)) == 10


def test_accents_and_phrases(spark):
    rows = spark.createDataFrame([(1, "Perché no"), (2, "a b a b a"), (3, "altro"), (4, "resto")], "doc_id long, text string")
    passages = S.passages(rows)
    assert [r.doc_id for r in S.scored(passages, S.match_any("perche")).collect()] == [1]
    assert passages.where("doc_id = 2").select(S.Term(("a", "b"), False).count(F.col("tokens")), S.Term(("a", "b", "a"), False).count(F.col("tokens"))).first()[:] == (2, 2)
    assert S.scored(passages, []).collect() == []


def test_repeated_term_counts_twice(spark):
    rows = S.passages(spark.createDataFrame([(i, "stone" if i == 0 else "wall") for i in range(5)], "doc_id long, text string"))
    once, twice = (S.scored(rows, S.match_any(q)).first().score for q in ("stone", "stone stone"))
    assert once < 0 and abs(twice - 2 * once) < 1e-9


def test_page_chunks(spark):
    for n, expected in ((400, [(0, 400)]), (401, [(0, 300), (250, 401)]), (0, [(0, 0)]), (900, [(0, 300), (250, 550), (500, 800), (750, 900)])):
        out = value(spark, C.page_chunks(F.lit(" ".join(["w"] * n))))
        assert [(c.start, c.stop) for c in out] == expected


def test_spans(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, C.greedy_spans(a(100, 160, 10, 250, 5), 250)) == [0, 0, 1, 1, 2]
    assert value(spark, C.fitting_chunks(a(30, 40, 70, 10, 100), 60)) == [0, 1, 2, 3, 4]
    assert value(spark, C.timed_paragraphs(a(0.0, 1.0, 3.0, 4.0, 125.0), 2.0, 120.0)) == [0, 0, 1, 1, 2]
    assert tuple(value(spark, C.grown_window(a(10, 10, 10, 10), F.lit(1), 25))) == (0, 2)


def test_merged_intervals_bridge(spark):
    rows = spark.createDataFrame([(1, 0, 2, 3), (1, 5, 7, 1), (1, 2, 5, 2), (1, 9, 9, 0)], "j int, first int, last int, rank int")
    assert sorted(r[:] for r in C.merged_intervals(rows, ["j"]).collect()) == [(1, 0, 7, 1), (1, 9, 9, 0)]


def test_dense_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, vector array<float>")
    out = D.top_k(frame, frame.where("id % 20 = 0"), 4, query_block=6, vector_block=50).collect()
    vectors = {r.id: r.vector for r in frame.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    for q in range(0, 300, 20):
        expected = sorted((i for i in vectors if i != q), key=lambda i: (-dot(q, i), i))[:4]
        assert [r.id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == expected


def test_fold(spark):
    events = [("a", 1, "created", 1.0), ("a", 2, "edited", 2.0), ("a", 3, "suspended", 0.0), ("b", 1, "created", 1.0), ("b", 2, "deleted", 0.0), ("b", 3, "edited", 9.0), ("c", 1, "deleted", 0.0), ("c", 2, "created", 5.0), ("d", 1, "edited", 1.0)]
    reviews = spark.createDataFrame([("a", 0, 7.0), ("b", 9, 1.0)], "card string, n int, value double")
    out = E.folded_cards(spark.createDataFrame(events, "card string, n int, kind string, value double"), "card", ["n"], reviews).collect()
    assert sorted((r.card, r.value, r.suspended, r.review) for r in out) == [("a", 2.0, True, 7.0), ("c", 5.0, False, None)]


def test_due_queue(spark):
    cards = [(f"o{i}", 10 - i, False) for i in range(3)] + [(f"n{i:02}", None, False) for i in range(30)] + [("later", 99, False), ("off", 1, True)]
    out = E.due_queue(spark.createDataFrame(cards, "card string, due int, suspended boolean"), F.lit(20), 20).collect()
    assert len(out) == 23 and sorted(r.card for r in out if r.part == 0) == ["o0", "o1", "o2"]


def test_cues(spark):
    level = lambda s: value(spark, X.cue_level(F.lit(s)))
    assert level("L'importante è che capiate") is None and level("l'importante è che lo chiedo all'esame") == "strong"
    assert level("disattenzione") is None and level("glielo chiedo") is None and level("Questo è importante.") == "weak"


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "x The stone, wall of Río"), (2, "stone of wall")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "stone wall of rio"), (8, "of wall"), (9, None)], "item_id long, text string")
    assert [r[:] for r in X.quotes_in(docs, items).collect()] == [(1, 7)]


def brute_errors(r, h):
    """(errors, substitutions) of the best alignment, cell by cell."""
    row = [(j, 0) for j in range(len(h) + 1)]
    for i, w in enumerate(r):
        new = [(i + 1, 0)]
        for j, v in enumerate(h):
            e, s = row[j]
            new.append(min((row[j + 1][0] + 1, row[j + 1][1]), (new[j][0] + 1, new[j][1]), (e + (v != w), s + (v != w))))
        row = new
    return row[-1]


def test_word_errors(spark):
    rows = [(1, "a b c d", "a x c"), (2, "", "a"), (3, "uno due", ""), (4, "[00:01:02] È l'ora!", "è l ora")]
    rng = random.Random(1)
    rows += [(i, " ".join(rng.choices("abc", k=rng.randrange(1, 12))), " ".join(rng.choices("abc", k=rng.randrange(0, 12)))) for i in range(10, 60)]
    out = {r.id: r[1:] for r in M.word_errors(spark.createDataFrame(rows, "id long, reference string, hypothesis string")).collect()}
    assert [out[i] for i in (1, 2, 3, 4)] == [(4, 1, 1, 0), (0, None, None, None), (2, 0, 2, 0), (3, 0, 0, 0)]
    for i, r, h in rows[4:]:
        n, s, d, ins = out[i]
        assert (s + d + ins, s) == brute_errors(r.split(), h.split()) and n + ins - d == len(h.split())


def test_word_errors_of_many_lengths(spark):
    rng = random.Random(2)
    texts = lambda most: " ".join(rng.choices("abcd", k=rng.randrange(0, most)))
    rows = [(i, texts(3 + i % 60), texts(3 + i % 45)) for i in range(200)] + [(200, None, "a"), (201, "a", None), (202, "a " * 17_000, "a b"), (203, "b", "a " * 17_000)]
    out = {r.id: r[1:] for r in M.word_errors(spark.createDataFrame(rows, "id long, reference string, hypothesis string").coalesce(1)).collect()}
    assert out[200] == (0, None, None, None) and out[201] == (1, 0, 1, 0) and out[202] == (17_000, 1, 16_998, 0) and out[203] == (1, 1, 0, 16_999)
    for i, r, h in rows[:200]:
        n, s, d, ins = out[i]
        assert n == len(r.split()) and (n == 0 or (s + d + ins, s) == brute_errors(r.split(), h.split()))


def test_quotes_cut_documents_once(spark):
    docs = spark.createDataFrame([(1, "x The stone, wall of Río stone wall of"), (2, "stone of wall")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "stone wall of rio"), (8, "stone of wall")], "item_id long, text string")
    out = X.quotes_in(docs, items)
    assert sorted(r[:] for r in out.collect()) == [(1, 7), (2, 8)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [doc_id") == 1  # the few that are checked; runs of all documents were written once and are read


def test_short_quotes(spark, tmp_path):
    """Quotes of any length, none of their tokens left out, as the SQL of the queries has it."""
    import duckdb

    from textmill.plans import checks, text

    docs = [(1, "x The stone, wall of Río"), (2, "stone of\n\n...\nwall Río"), (3, "... --\n !"), (4, None), (5, ""), (6, "stonewall")]
    items = [(7, "stone wall of rio"), (8, "of wall"), (9, None), (10, "Stone!"), (11, "wall rio"), (12, "?"), (13, "absent"), (14, "of")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for module, name in ((text, "quote_locate"), (checks, "quote_segments")):
        out = module.QUERIES[name](spark, str(tmp_path))
        wanted = duck.sql(f"SELECT {', '.join(out.columns)} FROM ({module.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, out.collect())) == sorted(wanted) and len(wanted) >= 7


def visit_order(n):
    """Both ends, then middles level by level."""
    out, spans = list(dict.fromkeys([0, n - 1])) if n else [], [(0, n - 1)]
    for low, high in spans:
        if high - low > 1:
            middle = (low + high) // 2
            out.append(middle)
            spans += [(low, middle), (middle, high)]
    return out


def brute_sample(groups, budget):
    queues = {g: [rows[i] for i in visit_order(len(rows))] for g, rows in sorted(groups.items())}
    out, going = set(), True
    while going:
        going = False
        for g, queue in queues.items():
            while queue:
                i, w = queue.pop(0)
                if w <= budget:
                    budget -= w
                    out.add((g, i))
                    going = True
                    break
    return out


def test_sample_in_turns(spark):
    rows = spark.createDataFrame([("a", i) for i in range(23)] + [("b", 0), ("c", 0), ("c", 1)], "g string, i int")
    out = {}
    for r in R.turns(rows, "g", "i").orderBy("g", "turn").collect():
        out.setdefault(r.g, []).append(r.i)
    assert out == {"a": visit_order(23), "b": [0], "c": [0, 1]}
    rng = random.Random(2)
    for budget, most in ((45, 12), (400, 60), (10**6, 50), (7, 9), (150, 151)):
        groups = {f"g{k:02d}": [(i, rng.randrange(1, most)) for i in range(rng.randrange(1, 30))] for k in range(12)}
        rows = spark.createDataFrame([(g, i, w) for g, own in groups.items() for i, w in own], "g string, i int, w int")
        assert {(r.g, r.i) for r in R.sampled(rows, "g", "i", "w", budget).collect()} == brute_sample(groups, budget)


def test_sample_of_many_sources(spark):
    """A hundred thousand sources of a row each, one of a hundred thousand rows, and sizes that leave little room."""
    n = 100_000
    rows = spark.range(n).select(F.format_string("g%06d", "id").alias("g"), F.lit(0).alias("i"), (F.col("id") % 7 + 1).cast("int").alias("w")).unionByName(spark.range(n).select(F.lit("a").alias("g"), F.col("id").cast("int").alias("i"), F.lit(3).alias("w")))
    groups = {"a": [(i, 3) for i in range(n)]} | {f"g{k:06d}": [(0, k % 7 + 1)] for k in range(n)}
    assert {(r.g, r.i) for r in R.sampled(rows, "g", "i", "w", 1003).collect()} == brute_sample(groups, 1003)
    groups = {"a": [(i, 4) for i in range(5)] + [(5, 1)], "b": [(0, 9), (1, 1)]}
    rows = spark.createDataFrame([(g, i, w) for g, own in groups.items() for i, w in own], "g string, i int, w int")
    for budget in range(1, 32):
        assert {(r.g, r.i) for r in R.sampled(rows, "g", "i", "w", budget).collect()} == brute_sample(groups, budget) if budget in (4, 5, 6, 13, 14, 15, 31) else True


def test_positions(spark):
    from textmill.operators.ranks import positions

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, F.col("id").cast("string")).alias("k"), F.col("id"), (F.col("id") % 5).alias("w"))
    out = positions(rows, ["k"], "id", total="w").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out[0].asDict().keys() == {"k", "id", "w", "place", "count", "upto"} and len(out) == 1000
    hot, null = (sorted((r["id"], r["place"], r["count"], r["upto"]) for r in out if r.k == key) for key in ("hot", None))
    assert hot == [(i, i + 1, 700, sum(j % 5 for j in range(i + 1))) for i in range(700)]
    assert null == [(i, i - 899, 100, sum(j % 5 for j in range(900, i + 1))) for i in range(900, 1000)]
    assert all(r["place"] == r["count"] == 1 for r in out if 700 <= r.id < 900)


def test_folds_as_a_keyword_index_does(spark):
    """Every letter against a keyword index with the tokenizer that the rule comes from."""
    import sqlite3
    import unicodedata

    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this SQLite")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    known = lambda c: unicodedata.ucd_3_2_0.category(c)[0] in "LN" and unicodedata.category(c)[0] in "LN" or c in T.MARKS  # noqa: E731 letters to tables of any age
    chars = [c for c in map(chr, range(0x80, 0x3000)) if known(c) and not 0x13A0 <= ord(c) < 0x1400] + ["\ue123"]
    texts = [f"a{c}b" for c in chars] + ["Erdős Žižek ŞIŞLİ Việt Nam cafe\u0301 Straße Ⅷ x\u0301y ΟΔΟΣ", "a\u0903b"]
    expected = {}
    for i, text in enumerate(texts):
        db.execute("INSERT INTO t(rowid, x) VALUES (?, ?)", (i, text))
    for term, row, _, offset in db.execute("SELECT * FROM v"):
        expected.setdefault(row, []).append((offset, term))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.tokens(F.col("text")).alias("t")).collect()
    wrong = {texts[r.i]: (r.t, e) for r in rows if r.t != (e := [t for _, t in sorted(expected.get(r.i, []))])}
    # a letter with two marks that the tokenizer leaves alone
    assert set(wrong) <= {"aǠb", "aǡb"}, wrong
    from textmill.operators.search import match_all

    assert [t.words for t in match_all("Erdős cafe\u0301")] == [("erdos",), ("cafe",)]


def test_white_space_cues_and_edges(spark):
    odd = "a\u00a0b\u2003c\x1cd\x85e\x0bf\u3000 g"
    assert value(spark, T.words(F.lit(odd))) == odd.split() and value(spark, T.label(F.lit("\u00a0a \u2003b\n"))) == "a b"
    assert value(spark, X.cue_level(F.lit("Questo sarà all’esame"))) == "strong" and value(spark, X.cue_level(F.lit("L’importante è che")), ) is None
    pages = {"f": [["H", "a", "E"], ["H", "b"], ["H"], ["x", "E"], ["H", "c", "E"], ["", "E"]], "g": [["H", "E"]], "h": [["", "x"], ["", "y"]]}
    frame = spark.createDataFrame([(f, i, p) for f, own in pages.items() for i, p in enumerate(own)], "file string, page int, lines array<string>")
    out = {(r.file, r.page): r.lines for r in X.without_edges(frame, "file").collect()}
    assert [out["f", i] for i in range(6)] == [["a"], ["b"], ["H"], ["x"], ["c"], [""]] and out["g", 0] == ["H", "E"] and [out["h", i] for i in range(2)] == [["x"], ["y"]]


def test_text(spark):
    assert value(spark, T.timestamp(F.lit(3725.9))) == "01:02:05" and value(spark, T.estimate_tokens(F.lit("a b"))) == 5
    assert value(spark, T.redact(F.lit("x sk-proj-abcdefghijklmnop1 y top"), secrets=("top",))) == "x *** y ***"
    assert value(spark, T.sentences(F.lit("art.1140 dice. Ok? sì"))) == ["art.1140 dice", "Ok", "sì"]
    assert [(p.text, p.match) for p in value(spark, T.marked_parts(T.marked(F.lit("a perché b"), "perch.")))] == [("a ", False), ("perché", True), (" b", False)]
    assert value(spark, T.clean_name(F.lit("a/b\u0000" + "x" * 200 + ".pdf"))).endswith(".pdf") and value(spark, T.joined_hyphens(F.lit("con-\ntratto"))) == "contratto"

"""Keyword search, fusion and budgets over the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import fusion, store
from ..operators import search as S
from ..sources.tables import scratch, table, version

ANY = S.match_any("tion hered queau")
ALL = S.match_all("the tion")
PHRASE = S.match_all('"of the"')
SCOPE = ("src1", "src3", "src5")


_open: dict[tuple, store.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> store.Index:
    """The index of the table's documents as they are: built once, and again when a file of it has changed."""
    key = spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir, "documents")
    if key not in _open:
        _open[key] = store.build(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), scratch(spark, "index"), "source")
    return _open[key]


def fts_index_build(spark, sf_dir):
    """The index written from empty; how many passages and tokens each source has."""
    index = store.build(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), scratch(spark, "index"), "source")
    return index.table("passages").groupBy("source").agg(F.count("*").alias("passages"), F.sum("dl").alias("tokens"))


def fts_index_states(spark, sf_dir):
    """What the index knows of each document."""
    return _index(spark, sf_dir).table("states").select("doc_id", "version", "passages")


def _changed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of an index's documents, those that a later import changes (a fifth) and those that it no longer has (a seventh)."""
    gone = docs.where("doc_id % 7 = 0").select("doc_id")
    return docs.where("doc_id % 5 = 1 and doc_id % 7 <> 0").withColumn("text", F.concat("text", F.lit("\nqueau queau tion"))), gone


def fts_index_plan(spark, sf_dir):
    """What a later import means for the index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    changed, gone = _changed(docs)
    now = docs.join(gone, "doc_id", "left_anti").join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed)
    return store.reconciled(_index(spark, sf_dir), now)


def fts_index_replace(spark, sf_dir):
    """The same import carried out: scores of the index after it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = store.build(docs, scratch(spark, "index"), "source", buckets=8)
    return _out(store.hits(store.replace(index, *_changed(docs)), ANY), "doc_id", "segment")


_P = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
p AS (SELECT doc_id, source, segment, text, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS tokens FROM l WHERE trim(text) <> '')
"""


def _count_sql(term: S.Term) -> str:
    if len(term.words) == 1:
        test = f"starts_with(t, '{term.words[0]}')" if term.prefix else f"t = '{term.words[0]}'"
        return f"len(list_filter(tokens, lambda t: {test}))"
    phrase, n = str(list(term.words)), len(term.words)
    return f"len(list_filter(range(1, len(tokens) - {n} + 2), lambda i: tokens[i:i + {n - 1}] = {phrase}))"


def _scored_sql(terms: list[S.Term], every: bool = False) -> str:
    tf = [f"tf{i}" for i in range(len(terms))]
    score = " + ".join(
        f"(CASE WHEN ln((n - n_{t} + 0.5) / (n_{t} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n_{t} + 0.5) / (n_{t} + 0.5)) END) * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for t in tf
    )
    return (
        _P
        + f""", c AS (SELECT *, len(tokens) AS dl, {", ".join(f"{_count_sql(term)} AS {t}" for term, t in zip(terms, tf))} FROM p),
g AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER ({t} > 0) AS n_{t}" for t in tf)} FROM c),
s AS (SELECT doc_id, source, segment, text, tokens, -({score}) AS score FROM c, g WHERE {(" AND " if every else " OR ").join(f"{t} > 0" for t in tf)})
"""
    )


def _out(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(*columns, F.round("score", 6).alias("score"))


def fts_bm25_topk(spark, sf_dir):
    rows = store.hits(_index(spark, sf_dir), ANY).withColumn("score", F.round("score", 6))
    return _out(store.with_text(_index(spark, sf_dir), S.top(rows, 50, "doc_id", "segment")), "doc_id", "segment", "text")


def fts_and_page(spark, sf_dir):
    rows = store.hits(_index(spark, sf_dir), ALL, every=True).withColumn("score", F.round("score", 6))
    total = rows.agg(F.count("*").alias("total"))
    return _out(S.top(rows, 10, "doc_id", "segment", offset=10).join(F.broadcast(total), how="cross"), "doc_id", "segment", "total")


def fts_best_per_course(spark, sf_dir):
    rows = S.by_group(store.hits(_index(spark, sf_dir), ANY), "source")
    return rows.select("source", "hits", F.round("best", 6).alias("best"))


def fts_top3_per_course(spark, sf_dir):
    rows = store.hits(_index(spark, sf_dir), ANY).withColumn("score", F.round("score", 6))
    return _out(S.best_of_each(rows, "source", 3, "doc_id", "segment"), "source", "doc_id", "segment", "rank")


def fts_scope_filter(spark, sf_dir):
    rows = store.hits(_index(spark, sf_dir), ANY, where=F.col("source").isin(*SCOPE)).withColumn("score", F.round("score", 6))
    return _out(S.top(rows, 20, "doc_id", "segment"), "doc_id", "segment", "source")


def fts_phrase(spark, sf_dir):
    return _out(store.hits(_index(spark, sf_dir), PHRASE), "doc_id", "segment")


def fts_counts(spark, sf_dir):
    rows = store.hits(_index(spark, sf_dir), ANY)
    return rows.agg(F.count("*").alias("passages"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("source").alias("sources"))


def fts_snippets(spark, sf_dir):
    rows = store.hits(_index(spark, sf_dir), ANY).withColumn("score", F.round("score", 6))
    page = store.with_text(_index(spark, sf_dir), S.top(rows, 20, "doc_id", "segment"))
    return page.select("doc_id", "segment", S.snippet(tokens(F.col("text")), ANY, 8).alias("snippet"))


def _lists(spark, sf_dir) -> DataFrame:
    """Two ranked lists of documents: by their best passage for each of two questions."""
    out = None
    for number, question in enumerate(("tion hered", "queau menting")):
        hits = S.by_group(store.hits(_index(spark, sf_dir), S.match_any(question)), "doc_id").withColumn("score", F.round("best", 6)).withColumn("list_no", F.lit(number))
        one = hits.orderBy("score", "doc_id").limit(50).select("list_no", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return fusion.ranked(out, ["list_no"], "score", "doc_id")


def _list_sql(number: int, question: str) -> str:
    return f"""SELECT {number} AS list_no, doc_id, score, row_number() OVER (ORDER BY score, doc_id) AS rank
FROM (SELECT doc_id, round(min(score), 6) AS score FROM ({_scored_sql(S.match_any(question))} SELECT * FROM s) GROUP BY doc_id) ORDER BY score, doc_id LIMIT 50"""


_LISTS = f"WITH lists AS (({_list_sql(0, 'tion hered')}) UNION ALL ({_list_sql(1, 'queau menting')}))"


def rrf_two_lists(spark, sf_dir):
    return fusion.fuse(_lists(spark, sf_dir), "doc_id").select("doc_id", F.round("fused", 9).alias("fused"))


def rrf_weighted(spark, sf_dir):
    weight = F.when(F.col("list_no") == 0, 2.0).otherwise(1.0)
    return fusion.fuse(_lists(spark, sf_dir), "doc_id", weight=weight).select("doc_id", F.round("fused", 9).alias("fused")).orderBy(F.desc("fused"), "doc_id").limit(8)


def rrf_native_score(spark, sf_dir):
    return fusion.native_score(_lists(spark, sf_dir), "doc_id")


def pool_top_n(spark, sf_dir):
    return fusion.pool(_lists(spark, sf_dir), "doc_id", 10, []).select("doc_id", "place")


def budget_cut(spark, sf_dir):
    rows = store.hits(_index(spark, sf_dir), ANY).withColumns({"score": F.round("score", 6), "n_words": F.col("dl")})
    return fusion.cut_to_budget(rows, 300, "n_words", ["source"], "score", "doc_id", "segment").select("source", "doc_id", "segment", "used")


QUERIES = {f.__name__: f for f in (fts_index_build, fts_index_states, fts_index_plan, fts_index_replace, fts_bm25_topk, fts_and_page, fts_best_per_course, fts_top3_per_course, fts_scope_filter, fts_phrase, fts_counts, fts_snippets, rrf_two_lists, rrf_weighted, rrf_native_score, pool_top_n, budget_cut)}
_R = "(SELECT * REPLACE (round(score, 6) AS score) FROM s)"
_NOW = r"""(SELECT doc_id, source, CASE WHEN doc_id % 5 = 1 THEN text || chr(10) || 'queau queau tion' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"""
ORACLES = {
    "fts_index_build": _P + "SELECT source, count(*) AS passages, sum(len(tokens))::BIGINT AS tokens FROM p GROUP BY source",
    "fts_index_states": _P + "SELECT d.doc_id, substr(sha256(coalesce(d.text, '')), 1, 16) AS version, count(p.doc_id) AS passages FROM documents d LEFT JOIN p USING (doc_id) GROUP BY ALL",
    "fts_index_plan": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'delete' WHEN doc_id % 5 = 1 THEN 'replace' ELSE 'keep' END AS action FROM documents",
    "fts_index_replace": _scored_sql(ANY).replace("FROM documents", f"FROM {_NOW}") + "SELECT doc_id, segment, round(score, 6) AS score FROM s",
    "fts_bm25_topk": _scored_sql(ANY) + f"SELECT doc_id, segment, text, score FROM {_R} ORDER BY score, doc_id, segment LIMIT 50",
    "fts_and_page": _scored_sql(ALL, True) + f"SELECT doc_id, segment, (SELECT count(*) FROM s) AS total, score FROM {_R} ORDER BY score, doc_id, segment LIMIT 10 OFFSET 10",
    "fts_best_per_course": _scored_sql(ANY) + "SELECT source, count(*) AS hits, round(min(score), 6) AS best FROM s GROUP BY source",
    "fts_top3_per_course": _scored_sql(ANY) + f"SELECT * FROM (SELECT source, doc_id, segment, row_number() OVER (PARTITION BY source ORDER BY score, doc_id, segment) AS rank, score FROM {_R}) WHERE rank <= 3",
    "fts_scope_filter": _scored_sql(ANY) + f"SELECT doc_id, segment, source, score FROM {_R} WHERE source IN {SCOPE} ORDER BY score, doc_id, segment LIMIT 20",
    "fts_phrase": _scored_sql(PHRASE) + "SELECT doc_id, segment, round(score, 6) AS score FROM s",
    "fts_counts": _scored_sql(ANY) + "SELECT count(*) AS passages, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources FROM s",
    "fts_snippets": _scored_sql(ANY)
    + f""", h AS (SELECT doc_id, segment, tokens, list_transform(tokens, lambda t: CASE WHEN {" OR ".join(f"starts_with(t, '{t.words[0]}')" for t in ANY)} THEN 1 ELSE 0 END) AS hit FROM {_R} ORDER BY score, doc_id, segment LIMIT 20),
w AS (SELECT doc_id, segment, tokens, i, list_sum(hit[i:i + 7]) AS hits FROM h, unnest(range(1, greatest(1, len(tokens) - 7) + 1)) AS u(i)),
b AS (SELECT doc_id, segment, tokens, i FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, segment ORDER BY hits DESC, i) = 1)
SELECT doc_id, segment, array_to_string(tokens[i:i + 7], ' ') AS snippet FROM b""",
    "rrf_two_lists": _LISTS + " SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS fused FROM lists GROUP BY doc_id",
    "rrf_weighted": _LISTS + " SELECT doc_id, round(sum(CASE WHEN list_no = 0 THEN 2.0 ELSE 1.0 END / (60 + rank)), 9) AS fused FROM lists GROUP BY doc_id ORDER BY fused DESC, doc_id LIMIT 8",
    "rrf_native_score": _LISTS + " SELECT doc_id, arg_min(score, list_no) AS score FROM lists GROUP BY doc_id",
    "pool_top_n": _LISTS + " SELECT DISTINCT doc_id, sha256('0:' || doc_id) AS place FROM lists WHERE rank <= 10",
    "budget_cut": _scored_sql(ANY)
    + f"SELECT source, doc_id, segment, used FROM (SELECT source, doc_id, segment, sum(len(tokens)) OVER (PARTITION BY source ORDER BY score, doc_id, segment ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM {_R}) WHERE used <= 300",
}

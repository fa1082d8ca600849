"""Checks of items, quotes and runs against their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import dense as D
from ..operators import matching as X
from ..operators import metrics as M
from ..operators import validation as V
from ..operators.ranks import written


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote_segments(spark, sf_dir):
    """The line of its document that each contained benchmark item stands in."""
    docs, items = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    found = written(X.quotes_in(docs, items, least=0), "found").join(items, "item_id")
    return V.quote_segments(C.segments(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")), found)


def items_kept(spark, sf_dir):
    """Orders as items and their lines as citations that resolve if returned."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "A").alias("ok"))
    return V.items_kept(rows, "l_orderkey", F.col("ok"))


def violations(spark, sf_dir):
    """Rows that break a rule of their table."""
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("O", "F"), "priority": F.col("o_orderpriority").rlike("^[1-4]-")}
    return V.violations(_t(spark, sf_dir, "orders"), ["o_orderkey"], rules)


def solution_points(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", V.solution_points(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("points"), F.sha2(F.array_join("p", "|"), 256).alias("hash"))


def paired_outcome(spark, sf_dir):
    """Vectors against their first 16 numbers: whose first five hold one of the query's label."""
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    runs = []
    for n in (64, 16):
        cut = rows.select("id", F.slice("vector", 1, n).alias("vector"))
        runs.append(M.first_of_label(D.top_k(cut, cut.where("id % 20 = 0"), 5), rows.select("id", "label"), "query_id", "id"))
    return M.paired(*runs, "query_id", 5)


def study_blocks(spark, sf_dir):
    """Blocks of at most 120 words; a word's pause is its length modulo 17."""
    words = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("segment", "word"))
    rows = words.select("doc_id", "segment", F.lit(1).alias("n_words"), (F.length("word") % 17).cast("double").alias("pause"))
    return V.study_blocks(rows, 120).groupBy("doc_id", "block").agg(F.min("segment").alias("first"), F.count("*").alias("n_words"))


def edits_applied(spark, sf_dir):
    """Of each document every twelfth run of three words with a letter changed, as edits one after the other; some of them drop or add a word."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.array_join(T.words(F.col("text")), " ").alias("text"))
    words = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") >= 3)
    edits = words.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2, F.lit(12))).alias("n"))
    old = F.array_join(F.slice("w", F.col("n"), F.lit(3)), " ")
    new = F.when(F.col("n") % 5 == 0, F.regexp_replace(old, r"^\S+ ", "")).when(F.col("n") % 7 == 0, F.concat(old, F.lit(" tion"))).otherwise(F.regexp_replace(old, "a", "o"))
    edits = edits.select("doc_id", "n", old.alias("original"), new.alias("corrected"))
    out = V.apply_edits(docs, edits)
    count = lambda result: F.size(F.filter("results", lambda r: r == result)).alias(result)
    return out.select("doc_id", *map(count, ("applied", "same", "missing", "ambiguous", "grows", "changes", "different")), F.sha2("text", 256).alias("text"))


def reply_items(spark, sf_dir):
    """Conversations as JSON replies that break off at two thirds; how many whole turns come back."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    reply = F.to_json(F.struct("turns"))
    cut = rows.select(F.col("conv_id").alias("id"), F.substring(reply, F.lit(1), (F.length(reply) * 2 / 3).cast("int")).alias("reply"))
    return V.replies(cut, "turns").select("id", F.size("items").alias("n"))


def course_rename(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.when(T.label_key(F.col("source")) == "src3", "Renamed").otherwise(F.col("source")).alias("course"))
    return rows.groupBy("course").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (quote_segments, items_kept, violations, solution_points, paired_outcome, study_blocks, edits_applied, reply_items, course_rename)}
_TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_PARTS = r"""regexp_split_to_array(regexp_replace(x, '[.!?]+(\s[^a-zà-öø-ÿ\d]|\s*$)', chr(1) || '\1', 'g'), chr(1))"""
ORACLES = {
    "solution_points": rf"""WITH i AS (SELECT doc_id, contains(text, ' | ') AS bars, CASE WHEN contains(text, ' | ') THEN string_split(text, ' | ')
  ELSE flatten(list_transform(regexp_split_to_array(text, '(^|\n)\s*\d{{1,2}}[.)]\s+'), lambda x: {_PARTS})) END AS p FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM i)
SELECT doc_id, len(p) AS points, sha256(array_to_string(p, '|')) AS hash FROM t""",
    "study_blocks": r"""WITH RECURSIVE w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> ''), lambda w: length(w) % 17) AS p FROM documents),
c(doc_id, p, block, first, stop) AS (SELECT doc_id, p, 0, 0, CASE WHEN len(p) <= 120 THEN len(p) ELSE list_max(list_transform(range(96, 121), lambda e: p[e] * 100000000 + e)) % 100000000 END FROM w WHERE len(p) > 0
UNION ALL SELECT doc_id, p, block + 1, stop, CASE WHEN len(p) - stop <= 120 THEN len(p) ELSE list_max(list_transform(range(stop + 96, stop + 121), lambda e: p[e] * 100000000 + e)) % 100000000 END FROM c WHERE stop < len(p))
SELECT doc_id, block, first, stop - first AS n_words FROM c""",
    "quote_segments": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
s AS (SELECT doc_id, segment, ' ' || array_to_string({_TOKENS.format("text")}, ' ') || ' ' AS t FROM l WHERE regexp_matches(text, '\S')),
n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY segment), '') AS nxt FROM s), p AS (SELECT *, t || ltrim(nxt) AS pair FROM n),
q AS (SELECT item_id, ' ' || array_to_string({_TOKENS.format("text")}, ' ') || ' ' AS q FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string({_TOKENS.format("text")}, ' ') || ' ' AS t FROM documents),
f AS (SELECT item_id, p.doc_id, min(segment) AS segment, arg_min(NOT contains(p.t, q), segment) AS spans, arg_min(len(string_split(pair[1:instr(pair, q)], ' ')) - 2, segment) AS first, arg_min(len(string_split(p.t, ' ')) - 2, segment) AS n FROM d JOIN q ON contains(d.t, q) JOIN p ON p.doc_id = d.doc_id AND (contains(p.t, q) OR contains(pair, q) AND NOT contains(nxt, q)) GROUP BY 1, 2)
SELECT item_id, doc_id, segment, spans, first, round(segment * 10 + first * 10.0 / n, 6) AS time FROM f""",
    "items_kept": "SELECT l_orderkey, count(*) AS citations, count(*) FILTER (l_returnflag = 'A') AS resolved, count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) <= 3 AS kept FROM lineitem GROUP BY 1",
    "violations": """SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')""",
    "paired_outcome": """WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
r AS (SELECT q.id AS query_id, q.label = v.label AS same, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.e, v.e) DESC, v.id) AS x, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.e[1:16], v.e[1:16]) DESC, v.id) AS y FROM v q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0),
f AS (SELECT query_id, bool_or(same AND x <= 5) AS x, bool_or(same AND y <= 5) AS y FROM r GROUP BY 1)
SELECT count(*) FILTER (x AND NOT y) AS wins, count(*) FILTER (y AND NOT x) AS losses, count(*) FILTER (x = y) AS ties FROM f""",
    "course_rename": "SELECT CASE WHEN lower(source) = 'src3' THEN 'Renamed' ELSE source END AS course, count(*) AS n FROM documents GROUP BY 1",
}

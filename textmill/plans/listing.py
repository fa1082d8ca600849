"""Listings, groups, joins and measures over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as L
from ..operators import metrics as M


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def course_groups(spark, sf_dir):
    """Nations as courses: orders of each, the newest one's status and time; nations without orders count zero."""
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    groups = o.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return nations.join(groups, "c_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"), F.date_format("last", "yyyy-MM-dd").alias("last"), "status")


def status_facets(spark, sf_dir):
    """Counts by status after the priority filter, before that of the status."""
    return _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def status_page(spark, sf_dir):
    """Third page of twenty, newest first, with the number of pages."""
    rows = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    meta = rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).cast("long").alias("pages"))
    page = rows.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)
    return page.join(F.broadcast(meta), how="cross").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "total", "pages")


def orphans(spark, sf_dir):
    """Documents without labels."""
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def scope_semi(spark, sf_dir):
    """Orders of the customers of one market segment, counted by priority."""
    c = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def attempt_scores(spark, sf_dir):
    """Each order as an attempt: answers, right ones and pending ones."""
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    return rows.agg(F.count("*").alias("answered"), F.count_if(F.col("l_returnflag") == "A").alias("right"), F.count_if(F.col("l_linestatus") == "O").alias("pending"), F.when(F.count_if(F.col("l_linestatus") == "O") > 0, "submitted").otherwise("graded").alias("status"))


def answer_outcomes(spark, sf_dir):
    """Outcome of each answer by precedence: choice, own grade, judge; counted."""
    outcome = F.when(F.col("l_quantity") < 10, F.when(F.col("l_quantity") % 2 == 0, "correct").otherwise("wrong")).when(F.col("l_returnflag") != "N", F.when(F.col("l_returnflag") == "A", "correct").otherwise("wrong")).when(F.col("l_linestatus") == "F", "judged").otherwise("pending")
    return _t(spark, sf_dir, "lineitem").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def chat_turns(spark, sf_dir):
    """Each question with the last answer before the next question; unanswered ones drop out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("q", F.sum((F.col("role") == "user").cast("int")).over(w))
    q = rows.where("role = 'user'").select("conv_id", "q", F.col("text").alias("question"))
    a = rows.where("role = 'assistant'").groupBy("conv_id", "q").agg(F.max_by("text", "turn").alias("answer"))
    return q.join(a, ["conv_id", "q"]).select("conv_id", "q", F.sha2("question", 256).alias("question"), F.sha2("answer", 256).alias("answer"))


def chat_titles(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return rows.select("conv_id", T.title(F.col("first")).alias("title"))


def followup_questions(spark, sf_dir):
    """Questions of six words or fewer get the one before in front."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").where("role = 'user'").withColumn("before", F.lag("text").over(w))
    text = F.when((T.word_count(F.col("text")) <= 6) & F.col("before").isNotNull(), F.concat_ws(" ", "before", "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.sha2(text, 256).alias("question"))


def recent_turns(spark, sf_dir):
    """The last two turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return _t(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 2").select("conv_id", "turn", "n")


def duplicate_documents(spark, sf_dir):
    """Of equal texts of a source, the one with the smallest id."""
    w = Window.partitionBy("source", "hash").orderBy("doc_id")
    return _t(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("hash")).withColumn("n", F.row_number().over(w)).where("n = 1").select("source", "doc_id")


def candidate_lines(spark, sf_dir):
    """Lines that are equal but for case and spaces, once: the first by source number, document and place."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("segment", "line")).withColumn("key", F.lower(T.label(F.col("line")))).where("key is not null")
    return rows.groupBy("key").agg(F.min(F.struct("doc_id", "segment")).alias("at"), F.count("*").alias("n")).where("n > 1").select(F.sha2("key", 256).alias("key"), "at.doc_id", "at.segment", "n")


def duplicate_keys(spark, sf_dir):
    """Keys that occur more than once, for which an import would fail."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 2")


def precision_by_source(spark, sf_dir):
    """A rule (no run of marks) as predictor of quality."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", (~F.col("text").rlike(r"[%#&$*]{3}|!!")).alias("predicted"))
    rows = d.join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    out = M.precision(rows, ["source"], F.col("predicted"), F.col("quality") == 1)
    return out.withColumn("precision", F.round("precision", 6))


def recall_by_source(spark, sf_dir):
    """The same rule's recall, of each source and of all."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", (~F.col("text").rlike(r"[%#&$*]{3}|!!")).alias("predicted"))
    rows = d.join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return M.recall(rows, ["source"], F.col("predicted"), F.col("quality") == 1).withColumn("recall", F.round("recall", 6))


def package_limits(spark, sf_dir):
    """Documents of a source as members of a package: those that expand too much, and those from which on the package is too large."""
    members = _t(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"), (F.col("doc_id") % 40 + 20).alias("packed"))
    return L.limit_faults(members, "source", "doc_id", 60.0, 60_000).select("source", "doc_id", "fault")


def confusion(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"[%#&$*]{3}|!!").cast("int").alias("marks"))
    rows = d.join(_t(spark, sf_dir, "labels"), "doc_id").groupBy("quality").pivot("marks", [0, 1]).agg(F.count(F.lit(1)))
    return rows.select("quality", F.coalesce("0", F.lit(0)).alias("plain"), F.coalesce("1", F.lit(0)).alias("marked"))


def label_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    return rows.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


def jaccard(spark, sf_dir):
    """Of each user turn and the next one of its conversation, the shared part of their words."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").where("role = 'user'").withColumn("a", F.array_distinct(T.tokens(F.col("text"))))
    rows = rows.withColumn("b", F.lead("a").over(w)).where("b is not null")
    return rows.select("conv_id", "turn", F.round(F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))), 6).alias("jaccard"))


def value_percentiles(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("p50"), F.max("value").alias("most"), F.count("*").alias("n"))


def package_check(spark, sf_dir):
    """A manifest against members: missing, extra, and different ones."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").alias("size"))
    manifest = d.where("doc_id % 13 <> 0").select("doc_id", F.col("hash").alias("told"), F.expr("CASE WHEN doc_id % 17 = 0 THEN size + 1 ELSE size END").alias("told_size"))
    members = d.where("doc_id % 19 <> 0")
    state = F.when(F.col("hash").isNull(), "missing").when(F.col("told").isNull(), "extra").when(F.col("size") != F.col("told_size"), "size").when(F.col("hash") != F.col("told"), "hash").otherwise("ok")
    return manifest.join(members, "doc_id", "full").select("doc_id", state.alias("state")).where("state <> 'ok'")


def remapped(spark, sf_dir):
    """Orders with new customer numbers; labels that collide get a number."""
    ids = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") + 1_000_000).alias("new"), "c_mktsegment", "c_nationkey")
    names = ids.withColumn("n", F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("o_custkey")))
    label = F.when(F.col("n") == 1, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ("), F.col("n"), F.lit(")")))
    return _t(spark, sf_dir, "orders").join(names, "o_custkey", "left").select("o_orderkey", "new", label.alias("label"), F.col("new").isNull().alias("dangling"))


def distinct_sources(spark, sf_dir):
    """Sources among the documents, with the newest document of each."""
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("revision"), F.count("*").alias("n"))


def nearest_event(spark, sf_dir):
    """For each error the purchase of the same user that is nearest in time, within two days; earlier ones first."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t")
    purchase = lambda sign: F.when(F.col("event_type") == "purchase", F.struct(F.col("t").alias("u"), (F.col("event_id") * sign).alias("id")))
    rows = rows.withColumn("before", F.max(purchase(-1)).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.min(purchase(1)).over(w.rangeBetween(0, Window.unboundedFollowing)))
    earlier, later = F.col("t") - F.col("before.u"), F.col("after.u") - F.col("t")
    nearest = F.when(later.isNull() | (earlier <= later), F.struct(earlier.alias("gap"), (-F.col("before.id")).alias("id"))).otherwise(F.struct(later.alias("gap"), F.col("after.id").alias("id")))
    return rows.where("event_type = 'error'").select("event_id", nearest.alias("n")).where("n.gap <= 172800000000").select("event_id", F.col("n.id").alias("nearest"))


def sources_used(spark, sf_dir):
    """The sources of the best passages, with the revision that their texts have now; those that have none any more drop out."""
    best = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    now = _t(spark, sf_dir, "documents").where("doc_id % 9 <> 4").select("doc_id", "source", F.substring(F.sha2("text", 256), 1, 16).alias("revision"))
    return best.join(now, "doc_id").groupBy("source").agg(F.count("*").alias("passages"), F.min("revision").alias("first"), F.max("revision").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        course_groups, status_facets, status_page, orphans, scope_semi, attempt_scores, answer_outcomes, chat_turns, chat_titles, followup_questions, recent_turns, duplicate_documents, candidate_lines, duplicate_keys,
        precision_by_source, recall_by_source, package_limits, confusion, label_rollup, jaccard, value_percentiles, package_check, remapped, distinct_sources, sources_used, nearest_event,
    )
}
ORACLES = {
    "sources_used": """WITH b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), n AS (SELECT doc_id, source, sha256(text)[1:16] AS revision FROM documents WHERE doc_id % 9 <> 4)
SELECT source, count(*) AS passages, min(revision) AS first, max(revision) AS last FROM b JOIN n USING (doc_id) GROUP BY 1""",
    "course_groups": """WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT c_nationkey, count(*) AS n, max(o_orderdate) AS last, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM o GROUP BY c_nationkey)
SELECT n_name, coalesce(n, 0) AS n, strftime(last, '%Y-%m-%d') AS last, status FROM nation LEFT JOIN g ON c_nationkey = n_nationkey""",
    "status_facets": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
    "status_page": """WITH r AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (SELECT count(*) FROM r) AS total, (SELECT ceil(count(*) / 20)::BIGINT FROM r) AS pages FROM r ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""",
    "orphans": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "scope_semi": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "attempt_scores": "SELECT l_orderkey, count(*) AS answered, count(*) FILTER (l_returnflag = 'A') AS \"right\", count(*) FILTER (l_linestatus = 'O') AS pending, CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'submitted' ELSE 'graded' END AS status FROM lineitem GROUP BY 1",
    "answer_outcomes": "SELECT CASE WHEN l_quantity < 10 THEN CASE WHEN l_quantity % 2 = 0 THEN 'correct' ELSE 'wrong' END WHEN l_returnflag <> 'N' THEN CASE WHEN l_returnflag = 'A' THEN 'correct' ELSE 'wrong' END WHEN l_linestatus = 'F' THEN 'judged' ELSE 'pending' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1",
    "chat_turns": """WITH r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS q FROM conversations WHERE role <> 'system'),
a AS (SELECT conv_id, q, arg_max(text, turn) AS answer FROM r WHERE role = 'assistant' GROUP BY 1, 2)
SELECT r.conv_id, r.q, sha256(r.text) AS question, sha256(answer) AS answer FROM r JOIN a ON r.conv_id = a.conv_id AND r.q = a.q WHERE role = 'user'""",
    "chat_titles": "SELECT conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)",
    "followup_questions": r"""SELECT conv_id, turn, sha256(CASE WHEN len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')) <= 6 AND b IS NOT NULL THEN b || ' ' || text ELSE text END) AS question
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role = 'user')""",
    "recent_turns": "SELECT conv_id, turn, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2",
    "duplicate_documents": "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, text",
    "candidate_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
k AS (SELECT doc_id, segment, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS key FROM l)
SELECT sha256(key) AS key, min(r).doc_id AS doc_id, min(r).segment AS segment, count(*) AS n FROM (SELECT key, {'doc_id': doc_id, 'segment': segment} AS r FROM k WHERE key <> '') GROUP BY key HAVING count(*) > 1""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2",
    "precision_by_source": """WITH r AS (SELECT source, NOT regexp_matches(text, '[%#&$*]{3}|!!') AS p, quality = 1 AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (p AND c IS NOT NULL) AS labelled, count(*) FILTER (p AND c) AS "right", round(count(*) FILTER (p AND c) / nullif(count(*) FILTER (p AND c IS NOT NULL), 0), 6) AS precision, count(*) FILTER (p AND c IS NULL) AS unlabelled FROM r GROUP BY source""",
    "recall_by_source": """WITH r AS (SELECT source, NOT regexp_matches(text, '[%#&$*]{3}|!!') AS p, quality = 1 AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (c) AS correct, count(*) FILTER (p AND c) AS found, round(count(*) FILTER (p AND c) / nullif(count(*) FILTER (c), 0), 6) AS recall FROM r GROUP BY ROLLUP (source)""",
    "package_limits": """WITH m AS (SELECT source, doc_id, octet_length(encode(text)) AS size, doc_id % 40 + 20 AS packed FROM documents),
f AS (SELECT source, doc_id, CASE WHEN size / packed > 60 THEN 'ratio' WHEN sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) > 60000 THEN 'total' END AS fault FROM m) SELECT * FROM f WHERE fault IS NOT NULL""",
    "confusion": "SELECT quality, count(*) FILTER (NOT m) AS plain, count(*) FILTER (m) AS marked FROM (SELECT quality, regexp_matches(text, '[%#&$*]{3}|!!') AS m FROM documents JOIN labels USING (doc_id)) GROUP BY 1",
    "label_rollup": "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "jaccard": r"""WITH u AS (SELECT conv_id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS ws, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user')
SELECT a.conv_id, a.turn, round(len(list_intersect(a.ws, b.ws)) / nullif(len(list_distinct(list_concat(a.ws, b.ws))), 0), 6) AS jaccard FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.n = a.n + 1""",
    "value_percentiles": "SELECT event_type, round(median(value), 6) AS p50, max(value) AS most, count(*) AS n FROM events GROUP BY 1",
    "package_check": """WITH d AS (SELECT doc_id, sha256(text) AS hash, length(text) AS size FROM documents), m AS (SELECT doc_id, hash AS told, CASE WHEN doc_id % 17 = 0 THEN size + 1 ELSE size END AS told_size FROM d WHERE doc_id % 13 <> 0)
SELECT * FROM (SELECT doc_id, CASE WHEN hash IS NULL THEN 'missing' WHEN told IS NULL THEN 'extra' WHEN size <> told_size THEN 'size' WHEN hash <> told THEN 'hash' ELSE 'ok' END AS state FROM m FULL JOIN (SELECT * FROM d WHERE doc_id % 19 <> 0) USING (doc_id)) WHERE state <> 'ok'""",
    "remapped": """WITH c AS (SELECT c_custkey, c_custkey + 1000000 AS new, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT o_orderkey, new, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || n || ')' END AS label, new IS NULL AS dangling FROM orders LEFT JOIN c ON c_custkey = o_custkey""",
    "distinct_sources": "SELECT source, max(doc_id) AS revision, count(*) AS n FROM documents GROUP BY 1",
    "nearest_event": """WITH r AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events)
SELECT e.event_id, arg_min(p.event_id, (abs(e.t - p.t), p.t, p.event_id)) AS nearest FROM r e JOIN r p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND abs(e.t - p.t) <= 172800000000 WHERE e.event_type = 'error' GROUP BY 1""",
}

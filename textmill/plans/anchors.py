"""Anchors into changing sources, resubmissions, backfills and gold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds as E


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("segment", "line"))
    return rows.select("doc_id", "segment", T.label(F.lower("line")).alias("line")).where("line is not null")


_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
s AS (SELECT doc_id, segment, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS line FROM l WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> '')
"""


def anchor_states(spark, sf_dir):
    """Anchors at all lines, taken one line too late in some documents: ok, moved, changed source, or source gone."""
    lines = _lines(spark, sf_dir)
    anchors = lines.select("doc_id", "segment", "line", F.expr("CASE WHEN doc_id % 3 = 0 THEN segment + 1 ELSE segment END").alias("at"))
    now = lines.where("doc_id % 10 <> 0").withColumn("line", F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(line, 'x') ELSE line END"))
    here, first = now.select("doc_id", "line", F.col("segment").alias("at"), F.lit(True).alias("here")), now.groupBy("doc_id", "line").agg(F.min("segment").alias("to"))
    rows = anchors.join(now.select("doc_id").distinct().withColumn("there", F.lit(True)), "doc_id", "left").join(first, ["doc_id", "line"], "left").join(here, ["doc_id", "line", "at"], "left")
    state = F.when(F.col("there").isNull(), "source_removed").when(F.col("to").isNull(), "source_modified").when(F.col("here"), "ok").otherwise("moved")
    return rows.select("doc_id", "segment", state.alias("state"), F.when(state == "moved", F.col("to")).alias("to"))


def gold_first_fresh(spark, sf_dir):
    """Every gold row takes the first fresh row of its key; fresh rows beyond the gold rows of a key are surplus.

    Gold: lines of documents that are divisible by 3, by source and text; fresh: those of the others.
    """
    rows = _lines(spark, sf_dir).join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    gold = rows.where("doc_id % 3 = 0").groupBy("source", "line").agg(F.count("*").alias("gold"))
    w = Window.partitionBy("source", "line").orderBy("doc_id", "segment")
    fresh = rows.where("doc_id % 3 <> 0").withColumn("n", F.row_number().over(w)).join(gold, ["source", "line"], "left")
    return fresh.where("gold is not null").select("doc_id", "segment", (F.col("n") > F.col("gold")).alias("surplus"), (F.col("n") == 1).alias("first"))


def sources_changed(spark, sf_dir):
    """Of each source, whether some cited document's revision isn't the current one."""
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id", T.revision(F.col("text")).alias("now"))
    cited = docs.where("doc_id % 4 = 0").select("doc_id", F.expr("CASE WHEN doc_id % 32 = 0 THEN 'old' ELSE now END").alias("then"))
    rows = cited.join(docs.where("doc_id % 36 <> 0"), "doc_id", "left").join(docs.select("doc_id", F.col("source").alias("of")), "doc_id")
    return rows.groupBy("of").agg(F.max(F.col("now").isNull() | (F.col("now") != F.col("then"))).alias("changed"))


def observed_due(spark, sf_dir):
    """Reviews that saw the state before the last one: each purchase with the user's purchase before it, as seen two events ago."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _t(spark, sf_dir, "events").withColumn("bought", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("seen", F.lag("bought", 1).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", F.coalesce(F.col("bought") == F.col("seen"), F.col("bought").isNull()).alias("accepted"))


def submissions(spark, sf_dir):
    """Answers of an order's lines in order of time: the first counts, an equal one later is nothing new, another one conflicts."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)
    rows = _t(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).withColumn("given", F.first("l_returnflag").over(w))
    state = F.when(F.col("n") == 1, "accepted").when(F.col("l_returnflag") == F.col("given"), "same").otherwise("conflict")
    return rows.groupBy("l_orderkey").agg(*[F.count_if(state == s).alias(s) for s in ("accepted", "same", "conflict")])


def page_backfill(spark, sf_dir):
    """Pages without text take it from a second reading, if that isn't blank."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END").alias("text"))
    second = _t(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.expr("CASE WHEN doc_id % 12 = 0 THEN '  ' ELSE text END").alias("ocr"))
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    rows = docs.join(second, "doc_id", "left").withColumn("taken", empty & (F.trim(F.coalesce("ocr", F.lit(""))) != ""))
    return rows.select("doc_id", "taken", F.sha2(F.when(F.col("taken"), F.col("ocr")).otherwise(F.col("text")), 256).alias("text"))


def latest_prices(spark, sf_dir):
    """The last row of each part, by the operator that the folds share."""
    rows = E.latest(_t(spark, sf_dir, "lineitem"), ["l_partkey"], F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_suppkey"), F.desc("l_extendedprice"))
    return rows.select("l_partkey", "l_orderkey", "l_extendedprice")


QUERIES = {f.__name__: f for f in (anchor_states, gold_first_fresh, sources_changed, observed_due, submissions, page_backfill, latest_prices)}
ORACLES = {
    "anchor_states": _LINES + """, a AS (SELECT doc_id, segment, line, CASE WHEN doc_id % 3 = 0 THEN segment + 1 ELSE segment END AS pos FROM s),
n AS (SELECT doc_id, segment, CASE WHEN doc_id % 7 = 0 THEN line || 'x' ELSE line END AS line FROM s WHERE doc_id % 10 <> 0), f AS (SELECT doc_id, line, min(segment) AS goes FROM n GROUP BY 1, 2)
SELECT a.doc_id, a.segment, CASE WHEN a.doc_id NOT IN (SELECT doc_id FROM n) THEN 'source_removed' WHEN goes IS NULL THEN 'source_modified' WHEN h.segment IS NOT NULL THEN 'ok' ELSE 'moved' END AS state,
CASE WHEN h.segment IS NULL THEN goes END AS "to" FROM a LEFT JOIN f ON f.doc_id = a.doc_id AND f.line = a.line LEFT JOIN n h ON h.doc_id = a.doc_id AND h.line = a.line AND h.segment = a.pos""",
    "gold_first_fresh": _LINES + """, r AS (SELECT s.*, source FROM s JOIN documents USING (doc_id)), g AS (SELECT source, line, count(*) AS gold FROM r WHERE doc_id % 3 = 0 GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, segment) AS n FROM r WHERE doc_id % 3 <> 0)
SELECT doc_id, segment, n > gold AS surplus, n = 1 AS first FROM f JOIN g USING (source, line)""",
    "sources_changed": """WITH d AS (SELECT source, doc_id, sha256(text)[1:16] AS now FROM documents), c AS (SELECT source, doc_id, CASE WHEN doc_id % 32 = 0 THEN 'old' ELSE now END AS seen FROM d WHERE doc_id % 4 = 0)
SELECT c.source AS "of", bool_or(now IS NULL OR now <> seen) AS changed FROM c LEFT JOIN (SELECT * FROM d WHERE doc_id % 36 <> 0) d USING (doc_id) GROUP BY 1""",
    "observed_due": """WITH b AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought FROM events),
s AS (SELECT *, lag(bought) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM b) SELECT event_id, coalesce(bought = seen, bought IS NULL) AS accepted FROM s WHERE event_type = 'purchase'""",
    "submissions": """WITH r AS (SELECT *, row_number() OVER w AS n, first_value(l_returnflag) OVER w AS given FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus))
SELECT l_orderkey, count(*) FILTER (n = 1) AS accepted, count(*) FILTER (n > 1 AND l_returnflag = given) AS same, count(*) FILTER (n > 1 AND l_returnflag <> given) AS conflict FROM r GROUP BY 1""",
    "page_backfill": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 12 = 0 THEN '  ' ELSE text END END AS ocr FROM documents),
t AS (SELECT *, trim(text) = '' AND trim(coalesce(ocr, '')) <> '' AS taken FROM d) SELECT doc_id, taken, sha256(CASE WHEN taken THEN ocr ELSE text END) AS text FROM t""",
    "latest_prices": "SELECT l_partkey, l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1",
}

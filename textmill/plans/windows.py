"""Passages, windows, spans and runs of ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..sources.tables import spread, table

SPAN, CHUNK, GAP, LONGEST, LOW = 40, 60, 6 * 3600.0, 24 * 3600.0, 150.0


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with seconds since 2024 began."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0)


_T = "(epoch_us(ts) / 1e6 - 1704067200.0)"


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, sizes and segments (arrays in order)."""
    rows = C.segments(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "segment", "n_words"))).alias("s"))
    return rows.select("doc_id", F.col("s.n_words").alias("sizes"), F.col("s.segment").alias("segments"))


_SEGMENTS = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
g AS (SELECT doc_id, segment, text, len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')) AS n_words FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment) - 1 AS place FROM g WHERE n_words > 0)
"""


def chunk_pages(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(C.page_chunks(F.col("text"))).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.col("c.start"), F.col("c.stop"), F.sha2("c.text", 256).alias("hash"))


def _spans(spark, sf_dir, numbers) -> DataFrame:
    rows = _in_order(_docs(spark, sf_dir)).select("doc_id", F.explode(F.arrays_zip("segments", "sizes", numbers(F.col("sizes")).alias("span"))).alias("x"))
    return rows.select("doc_id", "x.*").groupBy("doc_id", "span").agg(F.min("segments").alias("first"), F.max("segments").alias("last"), F.sum("sizes").alias("n_words"))


def partition_windows(spark, sf_dir):
    return _spans(spark, sf_dir, lambda sizes: C.greedy_spans(sizes, SPAN))


def fitting_chunks(spark, sf_dir):
    return _spans(spark, sf_dir, lambda sizes: C.fitting_chunks(sizes, CHUNK))


_PARTITION = f"""WITH RECURSIVE {_SEGMENTS},
r AS (SELECT doc_id, place, segment, n_words, 0 AS span, n_words AS sum FROM s WHERE place = 0
UNION ALL SELECT s.doc_id, s.place, s.segment, s.n_words, CASE WHEN r.sum >= {SPAN} THEN r.span + 1 ELSE r.span END, CASE WHEN r.sum >= {SPAN} THEN s.n_words ELSE r.sum + s.n_words END
FROM r JOIN s ON s.doc_id = r.doc_id AND s.place = r.place + 1)
SELECT doc_id, span, min(segment) AS first, max(segment) AS last, sum(n_words)::BIGINT AS n_words FROM r GROUP BY doc_id, span"""
_FITTING = _PARTITION.replace(f"r.sum >= {SPAN}", f"r.sum + s.n_words > {CHUNK}")


def lecture_units(spark, sf_dir):
    """Spans as units with their bounds: the place of the first word and after the last."""
    rows = C.segments(_docs(spark, sf_dir)).withColumn("after", F.sum("n_words").over(Window.partitionBy("doc_id").orderBy("place")))
    spans = partition_windows(spark, sf_dir).select("doc_id", "span", "first", "last")
    joined = rows.join(spans, "doc_id").where("segment between first and last")
    return joined.groupBy("doc_id", "span").agg(F.min(F.col("after") - F.col("n_words")).alias("begins"), F.max_by("after", "place").alias("ends"))


def grown_windows(spark, sf_dir):
    """A window around each document's longest line, until it has 80 words."""
    rows = _in_order(_docs(spark, sf_dir)).withColumn("center", (F.array_position("sizes", F.array_max("sizes")) - 1).cast("int"))
    return rows.withColumn("w", C.grown_window(F.col("sizes"), F.col("center"), 80)).select("doc_id", "center", F.col("w.first"), F.col("w.last"))


_GROWN = f"""WITH RECURSIVE {_SEGMENTS},
a AS (SELECT doc_id, array_agg(n_words ORDER BY place) AS sizes FROM s GROUP BY doc_id),
b AS (SELECT doc_id, sizes, len(sizes) AS n, (list_position(sizes, list_max(sizes)) - 1)::INT AS center FROM a),
r AS (SELECT doc_id, sizes, n, center, center AS first, center AS last, sizes[center + 1] AS sum, 0 AS turn FROM b
UNION ALL SELECT doc_id, sizes, n, center,
  CASE WHEN turn % 2 = 1 AND first > 0 THEN first - 1 ELSE first END, CASE WHEN turn % 2 = 0 AND last + 1 < n THEN last + 1 ELSE last END,
  sum + CASE WHEN turn % 2 = 0 AND last + 1 < n THEN sizes[last + 2] WHEN turn % 2 = 1 AND first > 0 THEN sizes[first] ELSE 0 END, turn + 1
FROM r WHERE sum < 80 AND (first > 0 OR last + 1 < n))
SELECT doc_id, center, arg_max(first, turn) AS first, arg_max(last, turn) AS last FROM r GROUP BY doc_id, center"""


def merge_windows(spark, sf_dir):
    """Windows of two lines around lines with many words, merged where they touch."""
    rows = C.segments(_docs(spark, sf_dir)).where("n_words > 30").select("doc_id", (F.col("segment") - 1).alias("first"), (F.col("segment") + 1).alias("last"), F.col("place").alias("rank"))
    return C.merged_intervals(rows, ["doc_id"])


def point_in_window_min(spark, sf_dir):
    """Hits at lines, to the span that holds them, with the smallest score of each span."""
    hits = C.segments(_docs(spark, sf_dir)).where("n_words % 7 = 0").select("doc_id", "segment", (-F.col("n_words")).alias("score"))
    spans = partition_windows(spark, sf_dir).select("doc_id", "span", "first", "last")
    return hits.join(spans, "doc_id").where("segment between first and last").groupBy("doc_id", "span").agg(F.min("score").alias("score"))


def gap_paragraphs(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("e"))
    rows = rows.select("user_id", F.explode(F.arrays_zip(F.col("e.event_id").alias("event_id"), F.col("e.t").alias("t"), C.timed_paragraphs(F.col("e.t"), GAP, LONGEST).alias("paragraph"))).alias("x"))
    return rows.select("user_id", "x.event_id", "x.paragraph")


_PARAGRAPHS = f"""WITH RECURSIVE o AS (SELECT user_id, event_id, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, t, i, t AS began, 0 AS paragraph FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.event_id, o.t, o.i, CASE WHEN o.t - r.t >= {GAP} OR o.t - r.began >= {LONGEST} THEN o.t ELSE r.began END,
r.paragraph + CASE WHEN o.t - r.t >= {GAP} OR o.t - r.began >= {LONGEST} THEN 1 ELSE 0 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, event_id, paragraph FROM r"""


def uncertain_spans(spark, sf_dir):
    """Runs of low values in a user's events, with the four events before and after."""
    rows = C.low_runs(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("value") < LOW)
    return rows.groupBy("user_id", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"), F.round(F.min("value"), 6).alias("lowest"))


def span_context(spark, sf_dir):
    """For each event the types of up to four before and after it."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    around = lambda a, z: F.array_join(F.collect_list("event_type").over(w.rowsBetween(a, z)), " ")
    return _events(spark, sf_dir).select("event_id", around(-4, -1).alias("before"), around(1, 4).alias("after"))


def filler_removal(spark, sf_dir):
    """Without clicks that stand alone: six hours or more on the longer side; the edges count as endless."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    gap = F.greatest(F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(1e18)), F.coalesce(F.lead("t").over(w) - F.col("t"), F.lit(1e18)))
    return _events(spark, sf_dir).withColumn("gap", gap).where(~((F.col("event_type") == "click") & (F.col("gap") >= GAP))).select("event_id", "user_id")


def followups(spark, sf_dir):
    """For each line's first sentence the thirty words that follow: the rest of the line, then the next lines."""
    w = Window.partitionBy("doc_id").orderBy("segment").rowsBetween(1, 30)
    rest = T.words(F.when(F.col("text").rlike(T.SENTENCE_END), F.regexp_replace("text", r"^.*?[.!?]+(?=\s|$)", "")).otherwise(F.lit("")))
    rows = C.segments(_docs(spark, sf_dir)).withColumn("next", F.slice(F.concat(rest, F.flatten(F.collect_list(F.slice(T.words(F.col("text")), 1, 30)).over(w))), 1, 30))
    return rows.select("doc_id", "segment", F.array_join("next", " ").alias("followup"))


def interval_overlap(spark, sf_dir):
    """Pairs of paragraphs of the same user's purchases and errors that overlap, ends included."""
    p = gap_paragraphs(spark, sf_dir).join(_events(spark, sf_dir).select("event_id", "event_type", "t"), "event_id")
    p = p.groupBy("user_id", "event_type", "paragraph").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    left = p.where("event_type = 'purchase'").select("user_id", F.col("paragraph").alias("left"), "a", "z")
    right = p.where("event_type = 'error'").select("user_id", F.col("paragraph").alias("right"), F.col("a").alias("b"), F.col("z").alias("y"))
    return left.join(right, "user_id").where("a <= y and b <= z").select("user_id", "left", "right")


def respread(spark, sf_dir):
    """Even start times over each line's words, ten seconds a line."""
    rows = C.segments(_docs(spark, sf_dir)).select("doc_id", "segment", "n_words", F.posexplode(T.words(F.col("text"))).alias("i", "word"))
    return rows.select("doc_id", "segment", "i", "word", F.round(F.col("segment") * 10 + F.col("i") * 10.0 / F.col("n_words"), 6).alias("start"))


QUERIES = {
    f.__name__: f
    for f in (chunk_pages, partition_windows, fitting_chunks, lecture_units, grown_windows, merge_windows, point_in_window_min, gap_paragraphs, uncertain_spans, span_context, filler_removal, followups, interval_overlap, respread)
}
_ORDER = f"OVER (PARTITION BY user_id ORDER BY {_T}, event_id)"
ORACLES = {
    "chunk_pages": r"""
WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM d),
c AS (SELECT doc_id, 0 AS chunk, 0 AS start, n AS stop, text FROM n WHERE n <= 400
UNION ALL SELECT doc_id, i AS chunk, i * 250 AS start, least(i * 250 + 300, n) AS stop, array_to_string(w[i * 250 + 1:i * 250 + 300], ' ') FROM n, unnest(range(0, ceil((n - 300) / 250)::BIGINT + 1)) AS r(i) WHERE n > 400)
SELECT doc_id, chunk, start, stop, sha256(text) AS hash FROM c""",
    "partition_windows": _PARTITION,
    "fitting_chunks": _FITTING,
    "lecture_units": _PARTITION.replace("SELECT doc_id, span, min(segment)", ", q AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM r) SELECT doc_id, span, min(after - n_words)::BIGINT AS begins, max(after)::BIGINT AS ends FROM q GROUP BY doc_id, span --"),
    "grown_windows": _GROWN,
    "merge_windows": f"""WITH {_SEGMENTS}, i AS (SELECT doc_id, segment - 1 AS first, segment + 1 AS last, place AS rank FROM s WHERE n_words > 30),
m AS (SELECT *, first > coalesce(max(last) OVER (PARTITION BY doc_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -10) + 1 AS opens FROM i),
k AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(first) AS first, max(last) AS last, min(rank) AS rank FROM k GROUP BY doc_id, island""",
    "point_in_window_min": _PARTITION.replace("SELECT doc_id, span, min(segment)", "SELECT doc_id, span, min(-n_words) AS score FROM r WHERE n_words % 7 = 0 GROUP BY doc_id, span --"),
    "gap_paragraphs": _PARAGRAPHS,
    "uncertain_spans": f"""WITH p AS (SELECT user_id, value, value < {LOW} AS low, row_number() {_ORDER} AS place FROM events WHERE true),
r AS (SELECT *, place - row_number() OVER (PARTITION BY user_id, low ORDER BY place) AS run FROM p)
SELECT user_id, run, min(place) AS first, max(place) AS last, count(*) AS n, round(min(value), 6) AS lowest FROM r WHERE low GROUP BY user_id, run""",
    "span_context": f"""SELECT event_id, coalesce(array_to_string(array_agg(event_type) {_ORDER[:-1]} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ' '), '') AS before,
coalesce(array_to_string(array_agg(event_type) {_ORDER[:-1]} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), ' '), '') AS after FROM events""",
    "filler_removal": f"""WITH g AS (SELECT event_id, user_id, event_type, greatest(coalesce({_T} - lag({_T}) {_ORDER}, 1e18), coalesce(lead({_T}) {_ORDER} - {_T}, 1e18)) AS gap FROM events)
SELECT event_id, user_id FROM g WHERE NOT (event_type = 'click' AND gap >= {GAP})""",
    "followups": rf"""WITH {_SEGMENTS}, w AS (SELECT doc_id, segment, CASE WHEN regexp_matches(text, '[.!?]+(\s|$)') THEN regexp_replace(text, '^.*?[.!?]+(\s|$)', '\1') ELSE '' END AS rest,
  flatten(array_agg(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')[1:30]) OVER (PARTITION BY doc_id ORDER BY segment ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)) AS nxt FROM s)
SELECT doc_id, segment, coalesce(array_to_string((list_filter(regexp_split_to_array(rest, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '') || coalesce(nxt, []))[1:30], ' '), '') AS followup FROM w""",
    "interval_overlap": _PARAGRAPHS.replace(
        "SELECT user_id, event_id, paragraph FROM r",
        """, p AS (SELECT r.user_id, event_type, paragraph, min(t) AS a, max(t) AS z FROM r JOIN events USING (event_id) GROUP BY ALL)
SELECT l.user_id, l.paragraph AS "left", o.paragraph AS "right" FROM p l JOIN p o ON l.user_id = o.user_id AND l.a <= o.z AND o.a <= l.z WHERE l.event_type = 'purchase' AND o.event_type = 'error'""",
    ),
    "respread": f"""WITH {_SEGMENTS}, w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+'), lambda w: w <> '') AS ws FROM s)
SELECT doc_id, segment, i - 1 AS i, ws[i] AS word, round(segment * 10 + (i - 1) * 10.0 / n_words, 6) AS start FROM w, unnest(range(1, n_words + 1)) AS r(i)""",
}

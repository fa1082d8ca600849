"""Retrieval end to end: odd documents are lectures, whose lines are their segments; even ones are documents, whose lines are passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import dense as D
from ..operators import fusion, store
from ..operators import retrieval as R
from ..operators import search as S
from ..operators.ranks import positions, written
from ..sources.tables import table
from .search import ANY, _index, _scored_sql

QUESTION = S.match_any("Che cosa è la tion del queau, e quale tion?")
LECTURE = "doc_id % 2 = 1"
MOST, WINDOW = 50, 60


def _hits(spark, sf_dir, terms=ANY):
    return store.hits(_index(spark, sf_dir), terms).withColumn("score", F.round("score", 6))


def question_search(spark, sf_dir):
    """A question's words but stop words; a repeated one counts twice."""
    return S.top(_hits(spark, sf_dir, QUESTION), 50, "doc_id", "segment").select("doc_id", "segment", "score")


def course_reading(spark, sf_dir):
    """All passages of a course in reading order, with their place."""
    rows = _index(spark, sf_dir).table("passages").where("source = 'src3'")
    # a course may have any number of passages
    placed = positions(rows.select("source", "doc_id", "segment", F.sha2("text", 256).alias("text")), ["source"], "doc_id", "segment")
    return placed.select("doc_id", "segment", "text", "place")


def search_mixed(spark, sf_dir):
    """Two pages of ten lectures; the first one also has the ten best documents, beside them."""
    hits = _hits(spark, sf_dir)
    best = S.by_group(hits, "doc_id").orderBy("best", "doc_id")
    lectures, documents = best.where(LECTURE), best.where(f"not ({LECTURE})")
    out = documents.limit(10).select(F.lit(1).alias("page"), F.lit("document").alias("kind"), "doc_id", "hits", F.lit(None).cast("double").alias("best"))
    for page in (1, 2):
        out = out.unionByName(lectures.offset(10 * (page - 1)).limit(10).select(F.lit(page).alias("page"), F.lit("lecture").alias("kind"), "doc_id", "hits", "best"))
    return out


def _candidates(spark, sf_dir):
    """The best passages of each kind, fused by rank."""
    hits = _hits(spark, sf_dir).withColumn("kind", F.when(F.expr(LECTURE), "lecture").otherwise("document"))
    lists = S.best_of_each(hits, "kind", MOST, "doc_id", "segment")
    fused = fusion.fuse(lists.withColumn("id", F.struct("doc_id", "segment")), "id", ["kind"])
    return fused.select("kind", "id.*", F.round("fused", 9).alias("fused"))


def retrieve_passages(spark, sf_dir):
    """Candidates in order, up to 500 words."""
    rows = store.with_text(_index(spark, sf_dir), _candidates(spark, sf_dir)).withColumn("n_words", T.word_count(F.col("text")))
    out = fusion.cut_to_budget(rows.withColumn("all", F.lit(0)), 500, "n_words", ["all"], F.desc("fused"), "doc_id", "segment")  # 2 * MOST rows
    return out.select("kind", "doc_id", "segment", "used")


def expanded_windows(spark, sf_dir):
    """Windows of 60 words around the best lines of lectures, merged where they touch: their best line and text."""
    # MOST lines, and the lines of their documents, are worked out once
    hits = written(S.top(_hits(spark, sf_dir).where(LECTURE), MOST, "doc_id", "segment"), "hits")
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("score", "doc_id", "segment"))).select("doc_id", "segment", "rank")
    rows = written(C.segments(table(spark, sf_dir, "documents").join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")), "lines")
    hits = hits.join(rows.select("doc_id", "segment", "place"), ["doc_id", "segment"])
    sizes = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "n_words"))).alias("s")).select("doc_id", F.col("s.n_words").alias("sizes"))
    grown = hits.join(sizes, "doc_id").withColumn("w", C.grown_window(F.col("sizes"), F.col("place"), WINDOW)).select("doc_id", "place", "rank", "w.first", "w.last")
    merged = C.merged_intervals(grown, ["doc_id"]).join(grown.select("doc_id", "rank", F.col("place").alias("anchor")), ["doc_id", "rank"])
    inside = rows.join(merged, "doc_id").where("place between first and last")
    text = inside.groupBy("doc_id", "first", "last", "rank", "anchor").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"), F.sum("n_words").alias("n_words"))
    return text.select("doc_id", "first", "last", "rank", "anchor", "n_words", F.sha2(F.array_join("t.text", " "), 256).alias("text"))


def _covered(spark, sf_dir):
    """Documents as units of eight courses with kinds, and the vectors that there are: of c3 some are missing, of c5 all; texts of c6 have changed since."""
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.col("doc_id") % 48 == 6, F.lit("x")).otherwise("")
    units = docs.select("doc_id", F.concat(F.lit("c"), F.col("doc_id") % 8).alias("course"), F.when(F.floor(F.col("doc_id") / 8) % 2 == 1, "lecture").otherwise("document").alias("kind"), T.word_count(F.col("text")).alias("n_words"), F.sha2(F.col("doc_id").cast("string"), 256).alias("indexed"), F.sha2(F.concat(F.col("doc_id").cast("string"), changed), 256).alias("text_sha256"))
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 200").select((F.col("vec_id")).alias("number"), F.col("embedding").alias("vector"))
    vectors = units.where("course <> 'c5' and doc_id % 24 <> 3").withColumn("number", F.col("doc_id") % 200).join(rows, "number").select("doc_id", F.col("indexed").alias("text_sha256"), "vector")
    return units, vectors, rows.where("number = 1").select(F.col("vector").alias("question"))


def _routes(spark, sf_dir):
    units, vectors, _ = _covered(spark, sf_dir)
    return R.routes(units, vectors, "course", F.col("course") == "c7")


def course_routes(spark, sf_dir):
    """How each course is searched: by vectors, or why not."""
    return _routes(spark, sf_dir)


def retrieve_by_coverage(spark, sf_dir):
    """The passages of every course for a question: whole documents by vectors where these cover the course, else lines by keywords; 1,000 words of each."""
    units, vectors, question = _covered(spark, sf_dir)
    near = units.drop("text_sha256").join(vectors.select("doc_id", "vector"), "doc_id").join(F.broadcast(question), how="cross")  # one row
    near = near.withColumn("cosine", F.round(D.dot(F.col("vector"), F.col("question")), 6)).where("cosine >= 0.0").withColumn("segment", F.lit(None).cast("int"))
    dense = R.best(near, "course", "kind", F.desc("cosine"), "doc_id")
    hits = _hits(spark, sf_dir).drop("source").join(units.select("doc_id", "course", "kind"), "doc_id")
    lines = R.best(hits, "course", "kind", "score", "doc_id", "segment")
    lines = store.with_text(_index(spark, sf_dir), lines).withColumn("n_words", T.word_count(F.col("text")))
    out = R.retrieved(_routes(spark, sf_dir), dense, lines, "course", ["doc_id", "segment"], "n_words", 1000)
    return out.select("course", "mode", F.coalesce("reason", F.lit("none")).alias("reason"), "doc_id", F.coalesce("segment", F.lit(-1)).alias("segment"), "fused", "used")


def retrieve_windows(spark, sf_dir):
    """Windows by the rank of their best line, up to 600 words, of courses that aren't searched by vectors, and why."""
    rows = expanded_windows(spark, sf_dir).withColumn("course", F.concat(F.lit("c"), F.col("doc_id") % 8)).join(_routes(spark, sf_dir).where(F.col("mode") == R.KEYWORDS), "course")
    out = fusion.cut_to_budget(rows, 600, "n_words", ["course"], "rank")  # MOST rows
    return out.select("course", "doc_id", "anchor", "used", "mode", "reason")


def reference_matches(spark, sf_dir):
    """Gold references against the best passages: documents by name and page, lectures by overlapping times; never one kind by the other."""
    hits = _candidates(spark, sf_dir)
    gold = C.segments(table(spark, sf_dir, "documents")).where("place % 4 = 1").select("doc_id", F.when(F.expr(LECTURE), "lecture").otherwise("document").alias("kind"), F.when(F.expr("doc_id % 6 = 0"), "lecture").alias("wrong"), F.col("segment").alias("gold"))
    gold = gold.withColumn("kind", F.coalesce("wrong", "kind"))
    page = (F.col("kind") == "document") & (F.col("segment") == F.col("gold"))
    times = (F.col("kind") == "lecture") & (F.col("segment") * 10 <= F.col("gold") * 10 + 25) & (F.col("gold") * 10 + 5 <= F.col("segment") * 10 + 10)
    return hits.join(gold, ["doc_id", "kind"]).where(page | times).select("kind", "doc_id", "segment", "gold")


def window_texts(spark, sf_dir):
    """What lies in seconds 35 to 70 of each document, ten seconds a line, ends not included."""
    rows = C.segments(table(spark, sf_dir, "documents")).where("segment * 10 < 70 and segment * 10 + 10 > 35")
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("n_words").alias("n_words"))


def exact_times(spark, sf_dir):
    """Anchors by their exact time: the first line that begins then; and the nearest line within 40 words that has the anchor's first word."""
    rows = C.segments(table(spark, sf_dir, "documents")).withColumn("before", F.sum("n_words").over(Window.partitionBy("doc_id").orderBy("segment")) - F.col("n_words"))
    rows = rows.select("doc_id", "segment", (F.floor(F.col("segment") / 2) * 20.0).alias("time"), "before", F.get(T.tokens(F.col("text")), F.lit(0)).alias("word"))
    anchors = rows.where("segment % 3 = 2").select("doc_id", F.col("segment").alias("anchor"), "time", F.col("word").alias("wanted"), F.col("before").alias("at"))
    exact = anchors.join(rows.select("doc_id", "time", "segment"), ["doc_id", "time"]).groupBy("doc_id", "anchor").agg(F.min("segment").alias("exact"))
    near = anchors.join(rows.select("doc_id", "segment", "before", "word"), "doc_id").where("word = wanted and segment <> anchor and abs(before - at) <= 40")
    near = near.groupBy("doc_id", "anchor").agg(F.min_by("segment", F.struct(F.abs(F.col("before") - F.col("at")), F.col("segment"))).alias("nearest"))
    return exact.join(near, ["doc_id", "anchor"], "left")


QUERIES = {f.__name__: f for f in (question_search, course_reading, search_mixed, retrieve_passages, expanded_windows, retrieve_windows, course_routes, retrieve_by_coverage, reference_matches, window_texts, exact_times)}
_WORDS = r"list_filter(regexp_split_to_array({}, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')"
_LINES = rf"""li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
sg AS (SELECT *, len({_WORDS.format("text")}) AS n_words, row_number() OVER (PARTITION BY doc_id ORDER BY segment) - 1 AS place FROM li WHERE len({_WORDS.format("text")}) > 0)"""
_S = _scored_sql(ANY) + ", b AS (SELECT * REPLACE (round(score, 6) AS score), CASE WHEN doc_id % 2 = 1 THEN 'lecture' ELSE 'document' END AS kind FROM s)"
_C = _S + f", q AS (SELECT kind, doc_id, segment, text, round(1.0 / (60 + row_number() OVER (PARTITION BY kind ORDER BY score, doc_id, segment)), 9) AS fused FROM b QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score, doc_id, segment) <= {MOST})"
_W = (
    _S.replace("WITH l AS", "WITH RECURSIVE l AS", 1)
    + f""", {_LINES}, top AS (SELECT doc_id, segment, row_number() OVER (ORDER BY score, doc_id, segment) AS rank FROM b WHERE kind = 'lecture' QUALIFY rank <= {MOST}),
ar AS (SELECT doc_id, array_agg(n_words ORDER BY place) AS sizes FROM sg WHERE doc_id IN (SELECT doc_id FROM top) GROUP BY 1),
g0 AS (SELECT t.doc_id, t.rank, sg.place AS anchor, ar.sizes FROM top t JOIN sg ON sg.doc_id = t.doc_id AND sg.segment = t.segment JOIN ar ON ar.doc_id = t.doc_id),
gr AS (SELECT doc_id, rank, anchor, sizes, anchor AS first, anchor AS last, sizes[anchor + 1] AS sum, 0 AS turn FROM g0
UNION ALL SELECT doc_id, rank, anchor, sizes, CASE WHEN turn % 2 = 1 AND first > 0 THEN first - 1 ELSE first END, CASE WHEN turn % 2 = 0 AND last + 1 < len(sizes) THEN last + 1 ELSE last END,
  sum + CASE WHEN turn % 2 = 0 AND last + 1 < len(sizes) THEN sizes[last + 2] WHEN turn % 2 = 1 AND first > 0 THEN sizes[first] ELSE 0 END, turn + 1 FROM gr WHERE sum < {WINDOW} AND (first > 0 OR last + 1 < len(sizes))),
gw AS (SELECT doc_id, rank, anchor, arg_max(first, turn) AS first, arg_max(last, turn) AS last FROM gr GROUP BY 1, 2, 3),
mo AS (SELECT *, (first > coalesce(max(last) OVER (PARTITION BY doc_id ORDER BY first, last, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -10) + 1)::INT AS opens FROM gw),
mi AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY first, last, rank ROWS UNBOUNDED PRECEDING) AS island FROM mo),
mg AS (SELECT doc_id, min(first) AS first, max(last) AS last, min(rank) AS rank, arg_min(anchor, rank) AS anchor FROM mi GROUP BY doc_id, island),
ex AS (SELECT mg.*, sum(n_words)::BIGINT AS n_words, sha256(string_agg(sg.text, ' ' ORDER BY sg.place)) AS text FROM mg JOIN sg ON sg.doc_id = mg.doc_id AND sg.place BETWEEN first AND last GROUP BY ALL)"""
)
_ROUTES = f"""un AS (SELECT doc_id, 'c' || doc_id % 8 AS course, CASE WHEN doc_id // 8 % 2 = 1 THEN 'lecture' ELSE 'document' END AS kind, len({_WORDS.format("text")}) AS n_words,
  doc_id % 8 <> 5 AND doc_id % 24 <> 3 AS has, doc_id % 48 = 6 AS changed FROM documents),
rc AS (SELECT course, count(*) AS total, count(*) FILTER (has) AS embedded, count(*) FILTER (has AND NOT changed) AS current FROM un GROUP BY 1),
rr AS (SELECT *, CASE WHEN course = 'c7' THEN 'rebuild_needed' WHEN embedded = 0 THEN 'not_indexed' WHEN embedded < total THEN 'partial' WHEN current < total THEN 'stale' END AS reason FROM rc),
ro AS (SELECT course, total, embedded, CASE WHEN reason IS NULL THEN 'dense' ELSE 'bm25' END AS mode, reason FROM rr)"""
ORACLES = {
    "question_search": _scored_sql(QUESTION) + "SELECT doc_id, segment, round(score, 6) AS score FROM s ORDER BY round(score, 6), doc_id, segment LIMIT 50",
    "course_reading": f"WITH {_LINES} SELECT l.doc_id, l.segment, sha256(l.text) AS text, row_number() OVER (ORDER BY l.doc_id, l.segment) AS place FROM li l JOIN documents d USING (doc_id) WHERE d.source = 'src3' AND trim(l.text) <> ''",
    "search_mixed": _S
    + """, d AS (SELECT kind, doc_id, count(*) AS hits, min(score) AS best, row_number() OVER (PARTITION BY kind ORDER BY min(score), doc_id) AS n FROM b GROUP BY 1, 2)
SELECT CASE WHEN n <= 10 THEN 1 ELSE 2 END AS page, kind, doc_id, hits, CASE WHEN kind = 'lecture' THEN best END AS best FROM d WHERE n <= CASE WHEN kind = 'lecture' THEN 20 ELSE 10 END""",
    "retrieve_passages": _C + f", u AS (SELECT kind, doc_id, segment, sum(len({_WORDS.format('text')})) OVER (ORDER BY fused DESC, doc_id, segment ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM q) SELECT * FROM u WHERE used <= 500",
    "expanded_windows": _W + " SELECT doc_id, first, last, rank, anchor, n_words, text FROM ex",
    "retrieve_windows": _W
    + f""", {_ROUTES}, u AS (SELECT course, doc_id, anchor, sum(n_words) OVER (PARTITION BY course ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used, mode, reason
FROM (SELECT 'c' || doc_id % 8 AS course, * FROM ex) JOIN ro USING (course) WHERE mode = 'bm25') SELECT * FROM u WHERE used <= 600""",
    "course_routes": f"WITH {_ROUTES} SELECT * FROM ro",
    "retrieve_by_coverage": _S
    + f""", {_ROUTES}, qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1),
de AS (SELECT course, kind, doc_id, -1 AS segment, n_words, row_number() OVER (PARTITION BY course, kind ORDER BY cosine DESC, doc_id) AS rank, 'dense' AS mode
  FROM (SELECT un.*, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: e.embedding[i]::DOUBLE * q[i])), 6) AS cosine FROM un JOIN embeddings e ON e.vec_id = un.doc_id % 200, qv WHERE has AND cosine >= 0)),
ke AS (SELECT course, un.kind, doc_id, segment, len({_WORDS.format("b.text")}) AS n_words, row_number() OVER (PARTITION BY course, un.kind ORDER BY score, doc_id, segment) AS rank, 'bm25' AS mode FROM b JOIN un USING (doc_id)),
fu AS (SELECT course, mode, reason, doc_id, segment, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, max(n_words) AS n_words FROM (SELECT * FROM de UNION ALL SELECT * FROM ke) JOIN ro USING (course, mode) WHERE rank <= 50 GROUP BY 1, 2, 3, 4, 5),
us AS (SELECT *, sum(n_words) OVER (PARTITION BY course ORDER BY fused DESC, doc_id, segment ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM fu)
SELECT course, mode, coalesce(reason, 'none') AS reason, doc_id, segment, fused, used FROM us WHERE used <= 1000""",
    "reference_matches": _C
    + f""", {_LINES}, gold AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 2 = 1 THEN 'lecture' ELSE 'document' END AS kind, segment AS gold FROM sg WHERE place % 4 = 1)
SELECT kind, doc_id, segment, gold FROM q JOIN gold USING (doc_id, kind) WHERE (kind = 'document' AND segment = gold) OR (kind = 'lecture' AND segment * 10 <= gold * 10 + 25 AND gold * 10 + 5 <= segment * 10 + 10)""",
    "window_texts": f"WITH {_LINES} SELECT doc_id, count(*) AS lines, sum(n_words)::BIGINT AS n_words FROM sg WHERE segment BETWEEN 3 AND 6 GROUP BY 1",
    "exact_times": rf"""WITH {_LINES}, r AS (SELECT doc_id, segment, segment // 2 * 20.0 AS time, sum(n_words) OVER (PARTITION BY doc_id ORDER BY segment) - n_words AS before, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+')[1] AS word FROM sg),
a AS (SELECT * FROM r WHERE segment % 3 = 2), e AS (SELECT a.doc_id, a.segment AS anchor, min(r.segment) AS exact FROM a JOIN r ON r.doc_id = a.doc_id AND r.time = a.time GROUP BY 1, 2),
n AS (SELECT a.doc_id, a.segment AS anchor, arg_min(r.segment, abs(r.before - a.before) * 1000000 + r.segment) AS nearest FROM a JOIN r ON r.doc_id = a.doc_id AND r.word = a.word AND r.segment <> a.segment AND abs(r.before - a.before) <= 40 GROUP BY 1, 2)
SELECT doc_id, anchor, exact, nearest FROM e LEFT JOIN n USING (doc_id, anchor)""",
}

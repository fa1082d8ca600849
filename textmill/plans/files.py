"""Files and replies made of the documents, read again as they would be from disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..sources import records as R
from ..sources.tables import spread, table


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def asr_replies(spark, sf_dir):
    """Lines as sentences of a speech recogniser's reply, back to segments in seconds."""
    word = lambda w, j: F.struct(w.alias("text"), (j * 250).alias("start"), (j * 250 + 90).alias("end"), F.lit(0.5).alias("confidence"))
    sentences = F.transform(T.lines(F.col("text")), lambda line: F.struct(F.transform(T.words(line), word).alias("words")))
    replies = _docs(spark, sf_dir).select("doc_id", F.to_json(F.struct(sentences.alias("sentences"))).alias("reply"))
    return R.asr_segments(replies, "doc_id", "reply").select("doc_id", "segment", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.size("words").alias("n_words"))


def heading_pages(spark, sf_dir):
    """Lines that begin with A to D as headings; sections as pages."""
    texts = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"(?m)^([A-D])", "## $1").alias("text"))
    return R.logical_pages(texts, "doc_id", 100).select("doc_id", "page", F.sha2("text", 256).alias("hash"))


def text_kinds(spark, sf_dir):
    """Texts as files with marks of other kinds: their kind by what they hold."""
    raw = F.col("text").cast("binary")
    content = (
        F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit(b"%PDF-"), raw)).when(F.col("doc_id") % 6 == 2, F.concat(F.lit(b"PK\x03\x04"), raw)).when(F.col("doc_id") % 6 == 3, F.concat(raw, F.lit(b"0\x00")))
        .when(F.col("doc_id") % 6 == 4, F.concat(raw, F.lit(b"\xff"))).otherwise(F.concat(raw, F.lit(b"10\n20")))
    )
    name = F.concat(F.lit("f"), F.col("doc_id"), F.when(F.col("doc_id") % 6 == 5, ".PDF").otherwise(".Txt"))
    return _docs(spark, sf_dir).select("doc_id", R.sniffed(content, name).alias("kind"), F.when(F.col("doc_id") % 6 != 4, F.sha2(R.decoded(content), 256)).alias("text"))


def lecture_books(spark, sf_dir):
    """Lines as segments that begin every three seconds, every fourth after a pause."""
    rows = C.segments(_docs(spark, sf_dir)).select("doc_id", "segment", (F.col("segment") * 1.5 + F.floor(F.col("segment") / 4) * 3.0).alias("start"), F.trim("text").alias("text"))
    return R.book(rows, "doc_id").select("doc_id", F.sha2("markdown", 256).alias("markdown"), F.sha2("book", 256).alias("book"))


QUERIES = {f.__name__: f for f in (asr_replies, heading_pages, text_kinds, lecture_books)}
_WORDS = r"list_filter(regexp_split_to_array({}, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')"
ORACLES = {
    "asr_replies": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), w AS (SELECT doc_id, i, len({_WORDS.format("t")}) AS n FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS segment, 0.0 AS start, round((n - 1) * 0.25 + 0.09, 3) AS "end", n AS n_words FROM w WHERE n > 0""",
    "heading_pages": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT *, sum((regexp_matches(t, '^[A-D#]'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
g AS (SELECT doc_id, section, string_agg(trim(regexp_replace(t, '^#+', '')), chr(10) ORDER BY i) AS text FROM s GROUP BY 1, 2), w AS (SELECT *, {_WORDS.format("text")} AS w FROM g),
p AS (SELECT doc_id, section, 0 AS part, text FROM w WHERE len(w) <= 100 UNION ALL SELECT doc_id, section, k, array_to_string(w[k:k + 99], ' ') FROM w, unnest(range(1, len(w) + 1, 100)) AS r(k) WHERE len(w) > 100)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS page, sha256(text) AS hash FROM p""",
    "text_kinds": r"""SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'pdf' WHEN 2 THEN 'zip' WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'text' END AS kind,
CASE doc_id % 6 WHEN 4 THEN NULL ELSE sha256(CASE doc_id % 6 WHEN 1 THEN '%PDF-' || text WHEN 2 THEN 'PK' || chr(3) || chr(4) || text WHEN 3 THEN text || '0' || chr(0) ELSE text || '10' || chr(10) || '20' END) END AS text FROM documents""",
    "lecture_books": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, i * 1.5 + i // 4 * 3.0 AS start, trim(t) AS t FROM l WHERE regexp_matches(t, '\S')), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM s),
o2 AS (SELECT *, start - lag(start) OVER (PARTITION BY doc_id ORDER BY i) >= 2 AS gap FROM o), p AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM o2),
g AS (SELECT doc_id, p, floor(min(start))::BIGINT AS b, string_agg(t, ' ' ORDER BY i) AS t FROM p GROUP BY 1, 2)
SELECT doc_id, sha256(string_agg('**[' || lpad((b // 3600)::VARCHAR, 2, '0') || ':' || lpad((b // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((b % 60)::VARCHAR, 2, '0') || ']** ' || t, chr(10) || chr(10) ORDER BY p)) AS markdown, sha256(string_agg(t, chr(10) || chr(10) ORDER BY p)) AS book FROM g GROUP BY 1""",
}

"""Text rules, quotes and measures of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import matching as X
from ..operators import metrics as M
from ..operators import sampling as R
from ..sources.tables import spread, table

STRONG, WEAK, NEGATIVE = ("that the", "de la", "und die"), ("tion", "queau", "heit"), ("of the",)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def text_measures(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.word_count(text).alias("n_words"), T.estimate_tokens(text).alias("n_tokens"), T.revision(text).alias("revision"), T.timestamp(F.col("n_chars") * 1.5).alias("time"))


def text_stems(spark, sf_dir):
    """How often each stem of four letters or more stands in all texts."""
    words = _docs(spark, sf_dir).select(F.explode(T.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select(T.stem(F.col("word")).alias("stem"), "n").where("length(stem) > 3").groupBy("stem").agg(F.sum("n").alias("n"))


def comparable_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.comparable(F.col("text")), 256).alias("hash"))


def course_labels(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(T.effective_label(F.expr("CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE concat(' ', source, '  x ') END"), F.col("lang")).alias("label"))
    return rows.groupBy("label", T.label_key(F.col("label")).alias("key")).agg(F.count("*").alias("n"))


def exact_terms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.exact_terms(F.col("text")), " ").alias("terms"))


def concept_keys(spark, sf_dir):
    """Keys of all lines, as terms of a source and language."""
    rows = _docs(spark, sf_dir).select("source", "lang", F.explode(T.lines(F.col("text"))).alias("line"))
    return rows.groupBy(T.concept_key(F.col("source"), F.col("lang"), F.col("line")).alias("key")).agg(F.count("*").alias("n"))


def word_budgets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_budget(F.lit(8192), F.col("n_chars"), F.lit(1024)).alias("budget"))


def cue_rules(spark, sf_dir):
    return X.cues(C.segments(_docs(spark, sf_dir)), STRONG, WEAK, NEGATIVE).select("doc_id", "segment", "place", F.sha2("sentence", 256).alias("sentence"), "level")


def _phrases(words) -> str:
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")([^\p{L}\p{N}_]|$)"


def redaction(spark, sf_dir):
    """Keys, mail addresses and tokens hidden."""
    patterns = (*T.KEY_PATTERNS, r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", r'"[0-9a-f]{40}"')
    rows = _docs(spark, sf_dir).select("doc_id", "text", T.redact(F.col("text"), patterns=patterns).alias("clean"))
    return rows.where("text <> clean").select("doc_id", F.sha2("clean", 256).alias("clean"))


def edge_lines(spark, sf_dir):
    """Documents of one length class as pages: the first and last lines that more than half of them share."""
    pages = _docs(spark, sf_dir).select(F.concat_ws("-", "source", F.col("n_chars")).alias("file"), F.transform(T.lines(F.col("text")), lambda s: F.trim(s)).alias("lines"))
    return X.edge_lines(pages, "file").where("line <> ''").select("file", "edge", F.sha2("line", 256).alias("line"), "n")


def edge_removal(spark, sf_dir):
    """Lines of a source's documents of one language as pages, under a shared heading and above a shared end that some lack: the pages without them."""
    ends = F.concat(F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("HEAD"))).otherwise(F.array()), T.lines(F.col("text")), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("END"))).otherwise(F.array()))
    pages = _docs(spark, sf_dir).select("doc_id", F.concat_ws("-", "source", "lang").alias("file"), ends.alias("lines"))
    return X.without_edges(pages, "file").select("doc_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("hash"))


def quote_locate(spark, sf_dir):
    return X.quotes_in(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=0)


def word_errors(spark, sf_dir):
    """Each line of a document against the next one."""
    rows = C.segments(_docs(spark, sf_dir)).withColumn("hypothesis", F.lead("text").over(Window.partitionBy("doc_id").orderBy("segment")))
    return M.word_errors(rows.where("hypothesis is not null").select(F.struct("doc_id", "segment").alias("id"), F.col("text").alias("reference"), "hypothesis")).select("id.*", "words", "substitutions", "deletions", "insertions")


def round_robin_sample(spark, sf_dir):
    """Lines of all sources in turns, 5,000 words."""
    rows = C.segments(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return R.sampled(rows.select("source", (F.col("doc_id") * 1_000_000 + F.col("segment")).alias("line"), "n_words"), "source", "line", "n_words", 5_000)


def spread_turns(spark, sf_dir):
    """When each document of a source is visited."""
    return R.turns(_docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


def page_texts(spark, sf_dir):
    """Text of HTML pages: scripts and tags out, spaces collapsed."""
    html = F.regexp_replace(F.col("html"), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(text, 256).alias("text"))


def text_sections(spark, sf_dir):
    """Lines that begin with a capital open a section; its number and words."""
    w = Window.partitionBy("doc_id").orderBy("segment")
    rows = C.segments(_docs(spark, sf_dir)).withColumn("section", F.sum(F.col("text").rlike("^[A-D]").cast("int")).over(w))
    return rows.groupBy("doc_id", "section").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (text_measures, text_stems, comparable_text, course_labels, exact_terms, concept_keys, word_budgets, cue_rules, redaction, edge_lines, edge_removal, quote_locate, word_errors, round_robin_sample, spread_turns, page_texts, text_sections)}
_WORDS = r"len(list_filter(regexp_split_to_array({}, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> ''))"
_SEGMENTS = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
s AS (SELECT *, {_WORDS.format("text")} AS n_words FROM l WHERE {_WORDS.format("text")} > 0)"""
_REDACTED = "text"
for _p in (*T.KEY_PATTERNS, r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", r'"[0-9a-f]{40}"'):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '***', 'g')"
ORACLES = {
    "text_measures": f"SELECT doc_id, {_WORDS.format('text')} AS n_words, ceil({_WORDS.format('text')} * 2.29::DOUBLE)::BIGINT AS n_tokens, sha256(text)[1:16] AS revision, "
    + "lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS time FROM (SELECT *, floor(n_chars * 1.5)::BIGINT AS s FROM documents)",
    "text_stems": r"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')) AS w FROM documents)
SELECT stem, count(*) AS n FROM (SELECT CASE WHEN length(w) >= 5 THEN regexp_replace(w, '[aeiouàèéìòóù]+$', '') ELSE w END AS stem FROM w) WHERE length(stem) > 3 GROUP BY 1""",
    "spread_turns": """WITH RECURSIVE g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
b(source, low, high, node) AS (SELECT source, 0, n - 1, 1 FROM g UNION ALL
SELECT source, CASE WHEN side = 0 THEN low ELSE (low + high) // 2 END, CASE WHEN side = 0 THEN (low + high) // 2 ELSE high END, node * 2 + side FROM b, unnest([0, 1]) AS t(side) WHERE high - low > 1),
v AS (SELECT source, 0 AS place, -2 AS visit FROM g UNION ALL SELECT source, n - 1, -1 FROM g WHERE n > 1 UNION ALL SELECT source, (low + high) // 2, node FROM b WHERE high - low > 1),
d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY visit) AS turn FROM d JOIN v USING (source, place)""",
    "round_robin_sample": rf"""WITH RECURSIVE {_SEGMENTS}, t0 AS (SELECT source, doc_id * 1000000 + segment AS line, n_words AS w FROM s JOIN documents USING (doc_id)),
g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS sno FROM t0 GROUP BY 1),
b(sno, low, high, node) AS (SELECT sno, 0::BIGINT, n - 1, 1::BIGINT FROM g UNION ALL
SELECT sno, CASE WHEN side = 0 THEN low ELSE (low + high) // 2 END, CASE WHEN side = 0 THEN (low + high) // 2 ELSE high END, node * 2 + side FROM b, unnest([0, 1]) AS x(side) WHERE high - low > 1),
v AS (SELECT sno, 0 AS place, -2::BIGINT AS visit FROM g UNION ALL SELECT sno, n - 1, -1 FROM g WHERE n > 1 UNION ALL SELECT sno, (low + high) // 2, node FROM b WHERE high - low > 1),
t AS MATERIALIZED (SELECT sno, source, line, w, visit FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line) - 1 AS place FROM t0) JOIN g USING (source) JOIN v USING (sno, place) WHERE w BETWEEN 1 AND 5000),
r AS (SELECT 0 AS step, sno, -9::BIGINT AS cur, 5000::BIGINT AS room, 0::BIGINT AS pos, NULL::BIGINT AS line, false AS picked FROM g
UNION ALL SELECT step + 1, sno, CASE WHEN sno = chosen THEN visit ELSE cur END, room - need, chosen, line, sno = chosen
FROM (SELECT *, first_value(sno) OVER o AS chosen, first_value(w) OVER o AS need, first_value(visit) OVER o AS best FROM (
    SELECT step, r.sno, cur, room, pos, min(t.visit) AS visit, arg_min(t.w, t.visit) AS w, arg_min(t.line, t.visit) AS line FROM r LEFT JOIN t ON t.sno = r.sno AND t.visit > r.cur AND t.w <= r.room GROUP BY ALL)
  WINDOW o AS (ORDER BY visit IS NULL, sno <= pos, sno ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE best IS NOT NULL)
SELECT source, r.line, w AS n_words FROM r JOIN t ON t.sno = r.sno AND t.line = r.line WHERE picked""",
    "comparable_text": r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(text, '\[\d{2}:\d{2}:\d{2}\]', ' ', 'g'), '\[\?|\?\]', '', 'g')), '[''’`]', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS hash FROM documents""",
    "course_labels": r"""WITH r AS (SELECT coalesce(nullif(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE ' ' || source || '  x ' END, '\s+', ' ', 'g')), ''), nullif(trim(lang), '')) AS label FROM documents)
SELECT label, lower(label) AS key, count(*) AS n FROM r GROUP BY ALL""",
    "exact_terms": r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: regexp_matches(x, '\d') OR (i > 1 AND regexp_matches(x, '^\p{Lu}'))), ' ') AS terms FROM t""",
    "concept_keys": "SELECT sha256(source || ':' || lang || ':' || lower(trim(line))) AS key, count(*) AS n FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
    "word_budgets": "SELECT doc_id, greatest(200, floor(greatest(0, 8192 - n_chars - 1024 - 512) / 2.29::DOUBLE))::BIGINT AS budget FROM documents",
    "cue_rules": rf"""WITH {_SEGMENTS}, c AS (SELECT doc_id, segment, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.!?]+(\s|$)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS q FROM s),
e AS (SELECT doc_id, segment, unnest(q) AS sentence, generate_subscripts(q, 1) - 1 AS place FROM c),
r AS (SELECT *, CASE WHEN regexp_matches(lower(replace(sentence, '’', '''')), '{_phrases(STRONG)}') THEN 'strong' WHEN regexp_matches(lower(replace(sentence, '’', '''')), '{_phrases(NEGATIVE)}') THEN NULL WHEN regexp_matches(lower(replace(sentence, '’', '''')), '{_phrases(WEAK)}') THEN 'weak' END AS level FROM e)
SELECT doc_id, segment, place, sha256(sentence) AS sentence, level FROM r WHERE level IS NOT NULL""",
    "redaction": f"SELECT doc_id, sha256(clean) AS clean FROM (SELECT doc_id, text, {_REDACTED} AS clean FROM documents) WHERE text <> clean",
    "edge_lines": """WITH p AS (SELECT source || '-' || n_chars AS file, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT file, count(*) AS pages FROM p GROUP BY 1),
e AS (SELECT file, 'first' AS edge, trim(l[1]) AS line FROM p UNION ALL SELECT file, 'last', trim(l[-1]) FROM p), c AS (SELECT file, edge, line, count(*) AS n FROM e GROUP BY ALL)
SELECT file, edge, sha256(line) AS line, n FROM c JOIN n USING (file) WHERE line <> '' AND 2 * n > pages""",
    "edge_removal": """WITH p AS (SELECT doc_id, concat_ws('-', source, lang) AS file, CASE WHEN doc_id % 5 <> 0 THEN ['HEAD'] ELSE [] END || string_split(text, chr(10)) || CASE WHEN doc_id % 3 = 0 THEN ['END'] ELSE [] END AS l FROM documents),
n AS (SELECT file, count(*) AS pages FROM p GROUP BY 1), f AS (SELECT file, l[1] AS first FROM p JOIN n USING (file) GROUP BY file, l[1], pages HAVING 2 * count(*) > pages AND pages > 1),
e AS (SELECT file, l[-1] AS last FROM p JOIN n USING (file) GROUP BY file, l[-1], pages HAVING 2 * count(*) > pages AND pages > 1),
t AS (SELECT doc_id, last, CASE WHEN len(l) > 1 AND l[1] = first THEN l[2:] ELSE l END AS l FROM p LEFT JOIN f USING (file) LEFT JOIN e USING (file)),
u AS (SELECT doc_id, CASE WHEN len(l) > 1 AND l[-1] = last THEN l[:len(l) - 1] ELSE l END AS l FROM t)
SELECT doc_id, len(l) AS n_lines, sha256(array_to_string(l, chr(10))) AS hash FROM u""",
    "quote_locate": r"""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents),
q AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN q ON contains(d.t, q.t)""",
    "page_texts": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages",
    "text_sections": f"WITH {_SEGMENTS}, k AS (SELECT *, sum(regexp_matches(text, '^[A-D]')::INT) OVER (PARTITION BY doc_id ORDER BY segment) AS section FROM s) SELECT doc_id, section::BIGINT AS section, sum(n_words)::BIGINT AS n_words, count(*) AS lines FROM k GROUP BY 1, 2",
}

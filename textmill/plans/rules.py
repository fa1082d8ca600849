"""Rules of texts, labels and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import chunking as C
from ..operators import filters as L
from ..operators import search as S
from ..sources.tables import spread, table


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def latex_structure(spark, sf_dir):
    """Documents written as LaTeX lists, without that structure again."""
    written = F.concat(F.lit("\\section*{Head}\n\\begin{itemize}\n\\item "), F.replace("text", F.lit("\n"), F.lit("\n\\item ")), F.lit("\n\\end{itemize}\n"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.without_latex_structure(written), 256).alias("plain"))


def _with_formulas(text):
    for word, sign in ((" the ", " \\( "), (" of ", " \\) "), (" de ", " \\[ "), (" la ", " \\] ")):
        text = F.replace(text, F.lit(word), F.lit(sign))
    return text


def formulas(spark, sf_dir):
    found = T.formulas(_with_formulas(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).alias("n"), F.sha2(F.array_join(found, "|"), 256).alias("hash"))


def doubtful_words(spark, sf_dir):
    """Words of seven letters marked as doubtful, those of nine as corrected."""
    mark = lambda w: F.when(F.length(w) == 7, T.doubtful(w)).when(F.length(w) == 9, T.corrected(w, F.lit("a<b"))).otherwise(w)
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(F.transform(T.words(F.col("text")), mark), " "), 256).alias("hash"))


def visible_labels(spark, sf_dir):
    raw = F.concat(F.lit(" \u202e"), "source", F.lit("\u0007\t  "), "lang", F.expr("repeat('x', int(doc_id % 120))"), F.lit("\u2069"))
    return _docs(spark, sf_dir).select("doc_id", T.visible_label(raw).alias("label"))


_MODELS = ("qwen3-embedding:8b", "embeddinggemma:300m", "bge-m3", "other")


def prompts(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.prompted(F.col("text"), model, True), 256).alias("query"), F.sha2(T.prompted(F.col("text"), model, False), 256).alias("document"))


def markdown_escaped(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.escape_markdown(F.col("text")), 256).alias("hash"))


def file_names(spark, sf_dir):
    raw = F.concat("source", F.lit("/\u0001"), "lang", F.expr("repeat('-n', int(doc_id % 70))"), F.lit(".md"))
    return _docs(spark, sf_dir).select("doc_id", T.clean_name(raw).alias("name"))


def citation_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(U.citation_tokens(F.col("text")), " "), 256).alias("hash"))


def page_normal(spark, sf_dir):
    """Pages with words cut at line ends and full-width letters, as plain text."""
    raw = F.replace(F.replace("text", F.lit("tion"), F.lit("ti-\non")), F.lit("A"), F.lit("\uff21"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(U.page_text(raw), 256).alias("hash"))


def course_keys(spark, sf_dir):
    raw = F.concat(F.upper("source"), F.lit("  \uff21 Stra\u00dfe "), F.upper("lang"))
    return _docs(spark, sf_dir).groupBy(U.course_key(raw).alias("key")).agg(F.count("*").alias("n"))


def highlights(spark, sf_dir):
    """Matches in each line, between marks, and how many parts that makes."""
    rows = C.segments(_docs(spark, sf_dir)).withColumn("parts", T.marked_parts(T.marked(F.col("text"), "[Tt]h[a-z]+")))
    return rows.select("doc_id", "segment", F.size("parts").alias("parts"), F.array_join(F.transform(F.filter("parts", lambda p: p["match"]), lambda p: p["text"]), " ").alias("matches"))


def content_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.content_words(F.col("text"), tuple(sorted(S.STOPWORDS)))).alias("n"))


def quote_lengths(spark, sf_dir):
    rows = C.segments(_docs(spark, sf_dir)).select("doc_id", "segment", T.tokens(F.col("text")).alias("q"))
    return rows.where(T.quote_length(F.col("q"))).groupBy("doc_id").agg(F.count("*").alias("quotes"))


def near_misses(spark, sf_dir):
    """Events as rejected edits: type as reason, value as similarity."""
    rows = table(spark, sf_dir, "events").withColumn("similarity", F.col("value") / 500)
    return rows.where(L.near_miss(F.col("event_type"), F.col("similarity"), "error")).select("event_id", F.round("similarity", 6).alias("similarity"))


def exported_orders(spark, sf_dir):
    return L.projected(table(spark, sf_dir, "orders"), ("o_orderkey", "o_orderstatus", "o_missing"))


def final_answers(spark, sf_dir):
    """Lines of an order as answers: those that are final, given up or judged."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"))).alias("answers"))
    return rows.select("l_orderkey", F.size("answers").alias("answers"), F.size(L.final_answers(F.col("answers"))).alias("final"))


def course_members(spark, sf_dir):
    """Documents of the courses that are asked for by label, whatever its case and spaces."""
    asked = spark.createDataFrame([(" SRC3 ",), ("Src5",), ("none",)], "course string")
    return L.members(_docs(spark, sf_dir), T.effective_label(F.concat(F.lit(" "), F.upper("source")), F.col("lang")), asked, "course").groupBy("source").agg(F.count("*").alias("n"))


def selected_sources(spark, sf_dir):
    """A selection of sources, and an empty one, which selects all."""
    docs, some = _docs(spark, sf_dir).select("doc_id", "source"), spark.createDataFrame([("src1",), ("src4",)], "source string")
    picked = [L.selected(docs, chosen, "source").groupBy("source").agg(F.count("*").alias("n")).withColumn("selection", F.lit(name)) for name, chosen in (("some", some), ("none", some.limit(0)))]
    return picked[0].unionByName(picked[1])


def document_status(spark, sf_dir):
    """Lines as pages; a document where most hold less than 40 characters has no text."""
    pages = _docs(spark, sf_dir).select("doc_id", F.explode(T.lines(F.col("text"))).alias("page"))
    return pages.groupBy("doc_id").agg(L.text_status(F.col("page"), 40).alias("status"), F.count("*").alias("pages"))


def ready_documents(spark, sf_dir):
    return document_status(spark, sf_dir).where("status = 'ready'").join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("ready"), F.sum("pages").alias("pages"))


def correction_totals(spark, sf_dir):
    """Events as corrections: totals by status, suggestions among the rejected ones, and all."""
    rows = table(spark, sf_dir, "events").withColumn("suggestion", L.near_miss(F.col("event_type"), F.col("value") / 500, "error"))
    return rows.rollup("event_type").agg(F.count("*").alias("n"), F.count_if("suggestion").alias("suggestions"))


def previous_imports(spark, sf_dir):
    """For each event the time of the user's first one of its type, if that was earlier."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "events").withColumn("before", F.min("ts").over(w))
    return rows.where("before is not null").select("event_id", F.date_format("before", "yyyy-MM-dd HH:mm:ss").alias("before"))


def chats_newest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("turns"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("text"))
    return rows.orderBy(F.desc("last"), F.desc("conv_id")).limit(20).select("conv_id", "last", "turns", T.title(F.col("text")).alias("title"))


def recovery_queue(spark, sf_dir):
    """What was queued in two logs, by time."""
    e = table(spark, sf_dir, "events")
    logs = e.where("event_type = 'error'").select("ts", "event_id", F.lit("job").alias("log")).unionByName(e.where("event_type = 'signup'").select("ts", "event_id", F.lit("generation").alias("log")))
    return logs.orderBy("ts", "event_id").limit(100).select("event_id", "log")


def turn_words(spark, sf_dir):
    """Words of a conversation's users and assistants: in both, and only in one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(T.tokens(F.col("text"))).alias("word"))
    user, other = (rows.where(F.col("role") == r).select("conv_id", "word") for r in ("user", "assistant"))
    parts = [("both", user.intersect(other)), ("user", user.subtract(other)), ("assistant", other.subtract(user)), ("any", user.union(other).distinct())]
    out = None
    for name, part in parts:
        part = part.groupBy("conv_id").agg(F.count("*").alias("words")).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        latex_structure, formulas, doubtful_words, visible_labels, prompts, markdown_escaped, file_names, citation_tokens, page_normal, course_keys, highlights, content_words, quote_lengths, near_misses, exported_orders,
        final_answers, course_members, selected_sources, document_status, ready_documents, correction_totals, previous_imports, chats_newest, recovery_queue, turn_words,
    )
}
_q = lambda s: s.replace("'", "''")
_WORDS = r"list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\pZ]+'), lambda w: w <> '')"
_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_SEGMENTS = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents), s AS (SELECT * FROM l WHERE len({_WORDS}) > 0)"""
_F = "text"
for _w, _s in ((" the ", " \\( "), (" of ", " \\) "), (" de ", " \\[ "), (" la ", " \\] ")):
    _F = f"replace({_F}, '{_w}', '{_s}')"
_MODEL = f"{list(_MODELS)}[(doc_id % 4 + 1)::INT]"


def _prompt_sql(side: int) -> str:
    cases = " ".join(f"WHEN starts_with({_MODEL}, '{family}') THEN '{p[side]}'" for family, p in T.PROMPTS.items())
    return f"sha256(CASE {cases} ELSE '' END || text)"


_STATUS = "SELECT doc_id, CASE WHEN avg((length(page) < 40)::INT) > 0.5 THEN 'ready_no_text' ELSE 'ready' END AS status, count(*) AS pages FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS page FROM documents) GROUP BY 1"
ORACLES = {
    "latex_structure": r"""WITH t AS (SELECT doc_id, '\section*{Head}' || chr(10) || '\begin{itemize}' || chr(10) || '\item ' || replace(text, chr(10), chr(10) || '\item ') || chr(10) || '\end{itemize}' || chr(10) AS x FROM documents)
SELECT doc_id, sha256(rtrim(regexp_replace(regexp_replace(regexp_replace(x, '\\(?:sub)*section\*?\{([^{}]*)\}', '\1', 'g'), '(?m)^[ \t]*\\(?:begin|end)\{(?:itemize|enumerate)\}[ \t]*\n?', '', 'g'), '(?m)^[ \t]*\\item\b[ \t]*', '- ', 'g'), chr(10))) AS plain FROM t""",
    "formulas": rf"""WITH t AS (SELECT doc_id, regexp_extract_all({_F}, '(?s)\\\((?:[^\\]|\\[^()])*\\\)|\\\[(?:[^\\]|\\[^\[\]])*\\\]') AS f FROM documents)
SELECT doc_id, len(f) AS n, sha256(array_to_string(list_transform(f, lambda x: x[3:-3]), '|')) AS hash FROM t""",
    "doubtful_words": rf"""SELECT doc_id, sha256(array_to_string(list_transform({_WORDS}, lambda w: CASE WHEN length(w) = 7 THEN regexp_replace(w, '{_q(T.WORD_PARTS)}', '\1\2[?\3?]\4') WHEN length(w) = 9 THEN regexp_replace(w, '{_q(T.WORD_PARTS)}', '\1\2\3<sup>a&lt;b</sup>\4') ELSE w END), ' ')) AS hash FROM documents""",
    "visible_labels": """WITH r AS (SELECT doc_id, source || ' ' || lang || repeat('x', (doc_id % 120)::INT) AS label FROM documents) SELECT doc_id, CASE WHEN length(label) <= 100 THEN label END AS label FROM r""",
    "prompts": f"SELECT doc_id, {_prompt_sql(0)} AS query, {_prompt_sql(1)} AS document FROM documents",
    "markdown_escaped": r"""SELECT doc_id, sha256(regexp_replace(replace(replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{}\[\]()#+.!|>~-])', '\\\1', 'g')) AS hash FROM documents""",
    "file_names": "WITH r AS (SELECT doc_id, source || lang || repeat('-n', (doc_id % 70)::INT) AS stem FROM documents) SELECT doc_id, stem[1:97] || '.md' AS name FROM r",
    "citation_tokens": r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))) AS hash FROM documents""",
    "page_normal": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "course_keys": "SELECT lower(source) || ' a strasse ' || lang AS key, count(*) AS n FROM documents GROUP BY 1",
    "highlights": rf"""WITH {_SEGMENTS}, m AS (SELECT doc_id, segment, regexp_extract_all(text, '[Tt]h[a-z]+') AS m, list_filter(regexp_split_to_array(text, '[Tt]h[a-z]+'), lambda x: x <> '') AS o FROM s)
SELECT doc_id, segment, len(m) + len(o) AS parts, array_to_string(m, ' ') AS matches FROM m""",
    "content_words": f"SELECT doc_id, len(list_distinct(list_filter({_TOKENS}, lambda t: NOT list_contains({sorted(S.STOPWORDS)}, t)))) AS n FROM documents",
    "quote_lengths": f"WITH {_SEGMENTS} SELECT doc_id, count(*) AS quotes FROM s WHERE len({_TOKENS}) BETWEEN 3 AND 40 GROUP BY 1",
    "near_misses": "SELECT event_id, round(value / 500, 6) AS similarity FROM events WHERE event_type = 'error' AND value / 500 >= 0.5 AND value / 500 < 0.6",
    "exported_orders": "SELECT o_orderkey, o_orderstatus FROM orders",
    "final_answers": "SELECT l_orderkey, count(*) AS answers, count(*) FILTER (l_returnflag <> 'N' OR l_linestatus = 'F') AS final FROM lineitem GROUP BY 1",
    "course_members": "SELECT source, count(*) AS n FROM documents WHERE source IN ('src3', 'src5') GROUP BY 1",
    "selected_sources": "SELECT source, count(*) AS n, 'some' AS selection FROM documents WHERE source IN ('src1', 'src4') GROUP BY 1 UNION ALL SELECT source, count(*), 'none' FROM documents GROUP BY 1",
    "document_status": _STATUS,
    "ready_documents": f"SELECT source, count(*) AS ready, sum(pages)::BIGINT AS pages FROM ({_STATUS}) JOIN documents USING (doc_id) WHERE status = 'ready' GROUP BY 1",
    "correction_totals": "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error' AND value / 500 >= 0.5 AND value / 500 < 0.6) AS suggestions FROM events GROUP BY ROLLUP (event_type)",
    "previous_imports": """WITH b AS (SELECT event_id, min(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT event_id, strftime(before, '%Y-%m-%d %H:%M:%S') AS before FROM b WHERE before IS NOT NULL""",
    "chats_newest": """WITH c AS (SELECT conv_id, max(turn) AS last, count(*) AS turns, arg_min(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY 1)
SELECT conv_id, last, turns, CASE WHEN length(t) > 60 THEN t[1:59] || '…' ELSE t END AS title FROM c ORDER BY last DESC, conv_id DESC LIMIT 20""",
    "recovery_queue": "SELECT event_id, CASE event_type WHEN 'error' THEN 'job' ELSE 'generation' END AS log FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts, event_id LIMIT 100",
    "turn_words": f"""WITH w AS (SELECT DISTINCT conv_id, role, unnest({_TOKENS}) AS word FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT conv_id, word, count(*) AS n, min(role) AS role FROM w GROUP BY 1, 2), q AS (SELECT conv_id, CASE WHEN n = 2 THEN 'both' ELSE role END AS part FROM p UNION ALL SELECT conv_id, 'any' FROM p)
SELECT conv_id, count(*) AS words, part FROM q GROUP BY conv_id, part""",
}

"""Quotes, cues, repeated edge lines, samples and citations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import written

# What marks a sentence as important, by strength.
STRONG = (
    "all'esame",
    "vi chiederò",
    "domanda d'esame",
    "ricordatevi",
    "ricordatevelo",
    "ricordatevela",
    "ricordateveli",
    "ricordatevele",
    "segnatevelo",
    "segnatevela",
    "segnateveli",
    "segnatevele",
    "lo chiedo",
)
WEAK = ("importante", "fondamentale", "attenzione")
NEGATIVE = ("l'importante è che",)

def has_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """Whether one of the phrases stands in the text as whole words; ’ counts as '. Java and RE2 both read the pattern."""
    quoted = "|".join("".join(c if c.isalnum() or c in " '" else "\\" + c for c in p) for p in phrases)
    return F.lower(F.replace(text, F.lit("’"), F.lit("'"))).rlike(rf"(^|[^\p{{L}}\p{{N}}_])({quoted})([^\p{{L}}\p{{N}}_]|$)")


def cue_level(sentence: Column, strong=STRONG, weak=WEAK, negative=NEGATIVE) -> Column:
    """strong before negative before weak; null without any."""
    return F.when(has_phrase(sentence, strong), "strong").when(has_phrase(sentence, negative), None).when(has_phrase(sentence, weak), "weak")


def cues(segments: DataFrame, strong=STRONG, weak=WEAK, negative=NEGATIVE) -> DataFrame:
    """doc_id, segment, place, sentence, level of every sentence that has a level."""
    rows = segments.select("doc_id", "segment", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))
    return rows.withColumn("level", cue_level(F.col("sentence"), strong, weak, negative)).where("level is not null")


def edge_lines(pages: DataFrame, by: str) -> DataFrame:
    """by, edge, line: the first or last line that more than half of a group's pages share. pages: by, lines (array)."""
    n = pages.groupBy(by).agg(F.count("*").alias("pages"))
    edges = F.array(F.struct(F.lit("first").alias("edge"), F.element_at("lines", 1).alias("line")), F.struct(F.lit("last").alias("edge"), F.element_at("lines", -1).alias("line")))
    rows = pages.where("size(lines) > 0").select(by, F.explode(edges).alias("e")).groupBy(by, "e.edge", "e.line").agg(F.count("*").alias("n"))
    return rows.join(n, by).where("2 * n > pages").select(by, "edge", "line", "n")


def without_edges(pages: DataFrame, by: str) -> DataFrame:
    """pages with lines less the first and last line that more than half of their group's pages share. A page's only line stays, and groups of one page
    are left as they are."""
    shared = edge_lines(pages, by).groupBy(by).agg(*(F.max(F.when(F.col("edge") == edge, F.col("line"))).alias(f"__{edge}") for edge in ("first", "last")))
    several = pages.groupBy(by).agg((F.count("*") > 1).alias("__several"))
    rows = pages.join(several, by).join(shared, by, "left")
    top = F.coalesce(F.col("__several") & (F.size("lines") > 1) & (F.element_at("lines", 1) == F.col("__first")), F.lit(False))
    rows = rows.withColumn("lines", F.when(top, F.slice("lines", F.lit(2), F.size("lines") - 1)).otherwise(F.col("lines")))
    end = F.coalesce(F.col("__several") & (F.size("lines") > 1) & (F.element_at("lines", -1) == F.col("__last")), F.lit(False))
    return rows.withColumn("lines", F.when(end, F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines"))).select(*pages.columns)


def quotes_in(docs: DataFrame, quotes: DataFrame, gram: int = 3, least: int | None = None) -> DataFrame:
    """doc_id, item_id of the quotes whose tokens stand in a document in a row.

    Of each quote the run of `gram` tokens that fewest quotes and fewest documents have is joined by equality with the documents' runs,
    and the whole quote is checked in those documents alone. least: tokens that a quote needs to match, `gram` if not given; of one with fewer than `gram` all tokens
    are the run. A quote without any (if `least` is 0) stands in documents without any.
    """
    least = gram if least is None else least
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))

    def grams(t: Column, n: int) -> Column:
        if n == 0:
            return F.when(F.size(t) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(*(F.get(t, i + j) for j in range(n))))
        return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<long>"))

    q = quotes.select("item_id", T.tokens(F.col("text")).alias("q")).where(F.size("q") >= least).withColumn("n", F.least(F.size("q"), F.lit(gram)))
    lengths = sorted(r.n for r in q.select("n").distinct().collect()) or [gram]  # gram + 1 numbers at most
    own = F.coalesce(*(F.when(F.col("n") == n, grams(F.col("q"), n)) for n in lengths))
    runs = q.select("item_id", F.explode(F.array_distinct(own)).alias("key"))
    d = docs.select("doc_id", T.tokens(F.col("text")).alias("d")).where(F.size("d") >= lengths[0])
    # documents are cut into runs once; what quotes have of them is a small part
    keys = F.explode(F.concat(*(grams(F.col("d"), n) for n in lengths))).alias("key")
    held = written(d.select("doc_id", keys).join(runs.select("key").distinct(), "key", "left_semi").distinct(), "runs")
    often = held.groupBy("key").agg(F.count("*").alias("docs"))
    rarest = runs.join(often, "key").groupBy("item_id").agg(F.min_by("key", F.struct("docs", "key")).alias("key"))
    pairs = held.join(rarest, "key").select("doc_id", "item_id").distinct()
    few = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.tokens(F.col("text")).alias("d"))
    return few.join(pairs, "doc_id").join(q, "item_id").where(F.contains(spaced(F.col("d")), spaced(F.col("q")))).select("doc_id", "item_id")

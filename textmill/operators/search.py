"""Keyword search with BM25 over passages.

A query is a list of terms; a term is a prefix, or a phrase of several tokens. Scores are negative, the lowest is best, and
statistics are always those of the whole table: filters choose rows, they don't change scores. The terms' counts come from
the passages' token arrays without a shuffle; one small aggregate gives the statistics, a single row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
#: What stands for the weight of a term that more than half of all rows have.
LEAST_IDF = 1e-6
MAX_TERMS = 10

# Italian words that a question doesn't search for.
STOPWORDS = frozenset({
    "il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "di", "a", "da", "in", "con", "su", "per", "tra", "fra", "e", "o", "ma", "che", "chi", "cui", "non", "come", "se",
    "è", "sono", "sei", "siamo", "siete", "essere", "ha", "hanno", "del", "della", "dello", "dei", "degli", "delle", "al", "allo", "alla", "ai", "agli", "alle",
    "dal", "dallo", "dalla", "dai", "dagli", "dalle", "nel", "nello", "nella", "nei", "negli", "nelle", "sul", "sullo", "sulla", "sui", "sugli", "sulle",
    "cos", "cosa", "quale", "quali", "questo", "questa", "questi", "queste", "quello", "quella", "quelli", "quelle", "mio", "tuo", "suo", "loro", "nostro", "vostro", "si", "ci", "vi", "ne",
})


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    prefix: bool = True

    def count(self, tokens: Column) -> Column:
        if len(self.words) == 1:
            word = self.words[0]
            return F.size(F.filter(tokens, lambda t: t.startswith(word) if self.prefix else t == word))
        n = len(self.words)
        if not any(self.words[i:] == self.words[: n - i] for i in range(1, n)):  # can't overlap itself
            rows = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
            phrase = f" {'  '.join(self.words)} "
            return ((F.length(rows) - F.length(F.replace(rows, F.lit(phrase)))) / len(phrase)).cast("int")
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        phrase = F.array(*map(F.lit, self.words))
        return F.size(F.filter(starts, lambda i: F.slice(tokens, i, F.lit(n)) == phrase))


def _folded(word: str) -> str:
    return word.lower().translate(str.maketrans(T.ACCENTED, T.FOLDED, T.MARKS))


def _stem(word: str) -> str:
    return word.rstrip(T.FINAL_VOWELS + T.FINAL_VOWELS.upper()) if len(word) >= 5 else word


def match_all(raw: str, most: int = MAX_TERMS) -> list[Term] | None:
    """Quoted phrases as they are, other words of two letters or more as stems; at most `most` terms, all to be found."""
    out: list[Term] = []
    for quoted, word in re.findall(r'"([^"]*)"|(\w+)', raw):
        if quoted:
            found = tuple(re.findall(r"[^\W_]+", _folded(quoted)))
            if found:
                out.append(Term(found, prefix=False))
        elif len(word) >= 2 and (stem := _stem(word)):
            out.append(Term((_folded(stem),)))
        if len(out) == most:
            break
    return out or None


def match_any(question: str, stopwords=STOPWORDS) -> list[Term] | None:
    """Each word of two letters or more that is no stop word, as a stem; a repeated word counts twice."""
    found = re.findall(r"\w+", question.lower())
    return [Term((_folded(_stem(w)),)) for w in found if len(w) >= 2 and w not in stopwords] or None


def passages(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, segment (place among all lines), text, tokens: the lines that have text."""
    rows = docs.select("doc_id", *keep, F.posexplode(T.lines(F.col("text"))).alias("segment", "text"))
    return rows.where("trim(text) != ''").withColumn("tokens", T.tokens(F.col("text")))


def scored(rows: DataFrame, terms: list[Term], every: bool = False, where: Column | None = None) -> DataFrame:
    """The rows that match any term (or every one), with score. where: which rows may come out."""
    if not terms:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
    tf = [f"tf_{i}" for i in range(len(terms))]
    counted = rows.withColumns({name: term.count(F.col("tokens")) for name, term in zip(tf, terms, strict=True)} | {"dl": F.size("tokens")})
    stats = counted.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(name) > 0).alias(f"n_{name}") for name in tf])
    found = [F.col(name) > 0 for name in tf]
    match = found[0]
    for f in found[1:]:
        match = match & f if every else match | f
    out = counted.where(match if where is None else match & where).join(F.broadcast(stats), how="cross")  # one row
    total = F.lit(0.0)
    for name in tf:
        idf = F.log((F.col("n_rows") - F.col(f"n_{name}") + 0.5) / (F.col(f"n_{name}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        total = total + idf * F.col(name) * (K1 + 1) / (F.col(name) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return out.withColumn("score", -total).drop(*tf, *[f"n_{name}" for name in tf], "n_rows", "avgdl", "dl")


def top(rows: DataFrame, n: int, *ties: str, offset: int = 0) -> DataFrame:
    return rows.orderBy("score", *ties).offset(offset).limit(n)


def by_group(hits: DataFrame, group: str) -> DataFrame:
    """Groups with the number of hits and the best score."""
    return hits.groupBy(group).agg(F.count("*").alias("hits"), F.min("score").alias("best"))


def best_of_each(hits: DataFrame, group: str, n: int, *ties: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy("score", *ties)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def snippet(tokens: Column, terms: list[Term], width: int = 32) -> Column:
    """The `width` tokens in a row with the most matches, the earliest of them."""
    hit = F.transform(tokens, lambda t: F.when(_any(t, terms), 1).otherwise(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (width - 1)))
    gain = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(hit, i, F.lit(width)), F.lit(0), lambda a, x: a + x).alias("hits"), (-i).alias("at")))
    at = -F.array_max(gain)["at"]
    return F.array_join(F.slice(tokens, at, F.lit(width)), " ")


def _any(token: Column, terms: list[Term]) -> Column:
    out = F.lit(False)
    for term in terms:
        for word in term.words:
            out = out | (token.startswith(word) if term.prefix else token == word)
    return out

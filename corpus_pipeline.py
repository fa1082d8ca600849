"""A corpus pipeline of the operators in textmill.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last returns the
packed pieces. Null texts pass no further than the first stage. A table without rows gives none.

Stages decide on rows, not on doc_ids: rows with null or repeated doc_ids are kept or rejected each by its own text (language,
decontaminate), or as copies of each other (exact_dedup, near_dedup: the row with the smallest doc_id stays, null ones last in
near_dedup and first in exact_dedup). Columns with other names are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import decontaminate, exact_dedup, language, packing, simhash
from textmill.llm.shared import remove, table, without_intermediates

#: A document whose language is less certain than this is rejected, as are those without letters; the languages to keep (None: all).
LEAST_CERTAIN, WANTED = 0.5, None
#: Words in a shingle, and differing bits of two fingerprints that link.
SHINGLE, DISTANCE = 5, 5
#: Shared share of word shingles from which two linked documents are near duplicates.
SIMILAR = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the network tells; those without a language get it. It is trained on their own labels."""
    return language.kept_documents(docs, language.fit(docs.select("doc_id", "text", "lang")), LEAST_CERTAIN, WANTED)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return simhash.kept_documents(docs, SHINGLE, DISTANCE, SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no passage with the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]
#: SQL expresses neither the network nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage wrote on the way, and what it was given, goes once its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = without_intermediates(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        remove(spark, before)
        before = [path]
    return docs

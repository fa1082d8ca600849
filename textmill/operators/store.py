"""A stored keyword index: passages, postings and states of documents, as Parquet tables.

    passages  bucket, doc_id, segment, text, tokens, dl, and columns of the document     one row a passage
    postings  bucket, term, doc_id, segment, tf, at (places), dl, those columns          one row a term and passage; files are sorted by term
    states    bucket, doc_id, version, passages                                          one row a document
    stats     bucket, rows, total (of dl)                                                one row a bucket

bucket is a hash of doc_id. In each file of a bucket rows of a term lie together, so a query for terms or prefixes reads the row groups that
hold them: the filters reach the Parquet scan. Statistics of the whole index are a sum over the buckets' rows. Texts are tokenised once: passages
are written with their tokens, and the other tables are worked out from them. Building shuffles the texts, once; postings are sorted where their
passages are read.

Documents are replaced by a generation in a folder of its own. It holds the new and changed documents and, as a table of keys, which documents of
the generations before it hold no more; its stats take these away. Where more than half of the documents change, or there are MOST_PARTS of these, the buckets are
written anew with all that stays instead, and the generations before are done with. Which generation holds which buckets stands in a
pointer, a small file with a number in its name that is written last: until then readers open the index as it was, and afterwards as it
is, all tables of it. Of two replacements at a time the second finds its number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from .search import K1, LEAST_IDF, B, Term

TABLES = ("passages", "postings", "states", "stats")
#: Passages in a bucket.
BUCKET_ROWS = 500_000
#: Tokens that are put in the order of their terms at once; a passage with more may be added to them, or taken by itself.
AT_ONCE = 1 << 20
#: Generations from which on buckets are written anew; what the name of one that holds changes only ends in.
MOST_PARTS, CHANGES = 8, "-changes"
#: Bytes of a passages file whose postings a task sorts: they are some 30 times as large there.
SPLIT = 12 << 20


@dataclass(frozen=True)
class Index:
    """An index as it is at one number of its pointer."""

    spark: SparkSession
    path: str
    buckets: int
    keep: tuple[str, ...] = ()
    #: (generation, its buckets).
    parts: tuple[tuple[str, tuple[int, ...]], ...] = ()
    number: int = 0

    def table(self, name: str) -> DataFrame:
        out = schema = None
        for i, part in enumerate(self.parts):
            rows = self._read(part, name, schema)
            schema = rows.schema  # one with changes may have no rows
            for later in self.parts[i + 1 :]:
                if later[0].endswith(CHANGES) and name != "stats":
                    rows = rows.join(self._read(later, "keys"), ["bucket", "doc_id"], "left_anti").select(*schema.names)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _read(self, part: tuple[str, tuple[int, ...]], name: str, schema: ST.StructType | None = None) -> DataFrame:
        generation, held = part
        rows = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/{generation}/{name}")
        return rows if len(self.parts) == 1 and len(held) == self.buckets else rows.where(F.col("bucket").isin(*held))  # prunes folders


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _point(index: Index) -> Index:
    """Writes the pointer of an index. Fails if one of its number is there."""
    files, folder = _files(index.spark, f"{index.path}/pointers")
    files.mkdirs(folder)
    new = index.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{index.number:012d}.json")
    text = json.dumps({"buckets": index.buckets, "keep": index.keep, "parts": index.parts})
    staged = index.spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = files.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    # renaming onto a file that is there fails
    if files.exists(new) or not files.rename(staged, new):
        files.delete(staged, False)
        raise FileExistsError(f"{index.path} has changed since it was opened")
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """The index at path as it is now."""
    files, folder = _files(spark, f"{path}/pointers")
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))
    if not names:
        raise FileNotFoundError(path)
    told = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/pointers/{names[-1]}").collect()))
    return Index(spark, path, told["buckets"], tuple(told["keep"]), tuple((g, tuple(held)) for g, held in told["parts"]), int(names[-1].split(".")[0]))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


_ORDER = {"passages": ("bucket", "doc_id", "segment"), "postings": ("bucket", "term"), "states": ("bucket", "doc_id"), "stats": ("bucket",), "keys": ("bucket", "doc_id")}


def _put(rows: DataFrame, path: str, name: str, buckets: int | None) -> DataFrame:
    """rows as a table of a generation, a folder for each bucket and a task for each (a hash of so few numbers would put several in one); read again. Without buckets rows stay in their tasks."""
    rows = rows.repartitionById(buckets, "bucket") if buckets else rows
    rows.sortWithinPartitions(*_ORDER[name]).write.partitionBy("bucket").option("parquet.block.size", 4 << 20).option("compression", "zstd").parquet(f"{path}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")


@contextmanager
def _splits_of(spark: SparkSession, size: int):
    """What is read inside is read in splits of at most so many bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _passages(docs: DataFrame, buckets: int, keep: tuple[str, ...]) -> DataFrame:
    """The passages of docs, a task for each bucket. Texts are shuffled before they are cut, as passages with their tokens are larger."""
    docs = docs.select(_bucket(buckets).alias("bucket"), "doc_id", "text", *keep).repartitionById(buckets, "bucket")
    rows = docs.select("bucket", "doc_id", *keep, F.posexplode(T.lines(F.col("text"))).alias("segment", "text")).where("trim(text) != ''")
    return rows.withColumn("tokens", T.tokens(F.col("text"))).withColumn("dl", F.size("tokens"))


def _postings(passages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row a term and passage, with its places. Nothing is shuffled: a passage's terms come from its own row."""
    columns = ["bucket", "doc_id", "segment", "dl", *keep]
    schema = ST.StructType([*(passages.schema[c] for c in columns), ST.StructField("term", ST.StringType()), ST.StructField("at", ST.ArrayType(ST.IntegerType()))])
    rows = passages.where("dl > 0").select(*columns, "tokens")
    return rows.mapInArrow(lambda batches: _places(batches, columns), schema).withColumn("tf", F.size("at"))


def _places(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Postings of some AT_ONCE tokens at a time, by term, so that sorting a task's rows only merges runs."""
    held, tokens = [], 0
    for b in batches:
        ends = np.cumsum(b.column("dl").to_numpy().astype(np.int64))
        first = 0
        while first < len(ends):
            done = ends[first - 1] if first else 0
            end = max(int(np.searchsorted(ends, done + AT_ONCE - tokens, side="right")), first + 1)
            held.append(b.slice(first, end - first))
            tokens += int(ends[end - 1] - done)
            if tokens >= AT_ONCE or end < len(ends):
                yield _sorted_places(pa.concat_batches(held), columns)
                held, tokens = [], 0
            first = end
    if held:
        yield _sorted_places(pa.concat_batches(held), columns)


def _sorted_places(b: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    tokens = b.column("tokens")
    n = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    row, coded = np.repeat(np.arange(len(n)), n), tokens.flatten().dictionary_encode()
    terms = coded.dictionary.take(pc.array_sort_indices(coded.dictionary))
    code = pc.index_in(coded.dictionary, value_set=terms).to_numpy().astype(np.int64)[coded.indices.to_numpy()]
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    key = code * len(n) + row
    order = np.argsort(key, kind="stable")  # a term's places stay in order
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    of = pa.array(row[order][first])
    return pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in columns), terms.take(pa.array(code[order][first])), at], names=[*columns, "term", "at"])


def _write(docs: DataFrame, path: str, buckets: int, keep: tuple[str, ...], version: Column, old: Index | None = None, keys: DataFrame | None = None, gone: DataFrame | None = None) -> None:
    """The four tables of docs (doc_id, text and the columns to keep), with what stays of old's buckets that keys (bucket, doc_id) touch. gone: passages that stats take away."""

    def with_old(rows: DataFrame, name: str) -> DataFrame:
        if old is None:
            return rows
        stays = old.table(name).join(F.broadcast(keys.select("bucket").distinct()), "bucket", "left_semi").join(keys, ["bucket", "doc_id"], "left_anti")
        return rows.unionByName(stays.select(*rows.columns))

    new = _passages(docs, buckets, keep)
    passages = _put(with_old(new, "passages"), path, "passages", buckets if old else None)
    with _splits_of(docs.sparkSession, SPLIT):
        _put(_postings(passages, keep), path, "postings", None)
    found = passages.groupBy("bucket", "doc_id").agg(F.count("*").alias("passages"))
    states = with_old(docs.select(_bucket(buckets).alias("bucket"), "doc_id", version.alias("version"), F.lit(0).cast("long").alias("passages")), "states")
    _put(states.drop("passages").join(found, ["bucket", "doc_id"], "left").withColumn("passages", F.coalesce("passages", F.lit(0))), path, "states", buckets)
    count = lambda rows: rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("dl").alias("total"))
    stats = count(passages)
    if gone is not None:
        stats = stats.unionByName(count(gone).select("bucket", (-F.col("rows")).alias("rows"), (-F.col("total")).alias("total")))
    _put(stats, path, "stats", buckets)


def text_version() -> Column:
    return F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16)


def _generation() -> str:
    return f"generation-{uuid.uuid4().hex}"


def build(docs: DataFrame, path: str, *keep: str, version: Column | None = None, buckets: int | None = None) -> Index:
    """Writes the index of docs at path. version: what tells that a document has changed; a hash of its text if not given."""
    spark = docs.sparkSession
    buckets = buckets or max(spark.sparkContext.defaultParallelism, -(-docs.count() * 20 // BUCKET_ROWS))  # some 20 passages a document
    generation = _generation()
    _write(docs, f"{path}/{generation}", buckets, keep, text_version() if version is None else version)
    return _point(Index(spark, path, buckets, keep, ((generation, tuple(range(buckets))),), 1))


def replace(index: Index, docs: DataFrame, gone: DataFrame, version: Column | None = None) -> Index:
    """The index with docs (new or changed) and without gone (doc_id). The one that is given stays readable, as it was."""
    keys = docs.select("doc_id").unionByName(gone.select("doc_id")).distinct().withColumn("bucket", _bucket(index.buckets))
    touched = {r.bucket for r in keys.select("bucket").distinct().collect()}  # numbers of buckets
    if not touched:
        return _point(Index(index.spark, index.path, index.buckets, index.keep, index.parts, index.number + 1))
    generation, version = _generation(), text_version() if version is None else version
    if len(index.parts) < MOST_PARTS and 2 * keys.count() <= index.table("states").count():
        generation += CHANGES
        keys = _put(keys, f"{index.path}/{generation}", "keys", index.buckets)
        gone = index.table("passages").select("bucket", "doc_id", "dl").join(keys, ["bucket", "doc_id"], "left_semi")
        _write(docs, f"{index.path}/{generation}", index.buckets, index.keep, version, gone=gone)
        return _point(Index(index.spark, index.path, index.buckets, index.keep, (*index.parts, (generation, tuple(sorted(touched)))), index.number + 1))
    _write(docs, f"{index.path}/{generation}", index.buckets, index.keep, version, index, keys)
    left = ((g, tuple(b for b in held if b not in touched)) for g, held in index.parts)
    parts = (*((g, held) for g, held in left if held), (generation, tuple(sorted(touched))))
    return _point(Index(index.spark, index.path, index.buckets, index.keep, parts, index.number + 1))


def cleared(index: Index) -> Index:
    """Deletes the generations that the index doesn't name, and earlier pointers; for when no reader has an earlier one open."""
    files, folder = _files(index.spark, index.path)
    named = {g for g, _ in index.parts}
    for s in files.listStatus(folder):
        if s.getPath().getName().startswith("generation-") and s.getPath().getName() not in named:
            files.delete(s.getPath(), True)
    files, folder = _files(index.spark, f"{index.path}/pointers")
    for s in files.listStatus(folder):
        if s.getPath().getName() < f"{index.number:012d}.json":
            files.delete(s.getPath(), False)
    return index


def reconciled(index: Index, docs: DataFrame, version: Column | None = None) -> DataFrame:
    """doc_id, action: what has to be done so that the index holds docs. Rows whose version is null can't be read and keep what is indexed."""
    from .folds import reconcile

    new = docs.select("doc_id", (text_version() if version is None else version).alias("version"))
    return reconcile(new, index.table("states").select("doc_id", "version"), "doc_id", "version")


def _matches(term: Column, word: str, prefix: bool) -> Column:
    if not prefix:
        return term == word
    return term.between(word, word + "\U0010ffff") & term.startswith(word)


def _less(n: int):
    return lambda x: x - n


def hits(index: Index, terms: list[Term] | None, every: bool = False, where: Column | None = None) -> DataFrame:
    """doc_id, segment, dl, the kept columns and score of the passages that match any term (or every one). where: which of them may come out.

    Scores are those of operators.search.scored(): negative, the lowest is best, with the statistics of the whole index.
    """
    keys = ["doc_id", "segment", "dl", *index.keep]
    if not terms:
        return index.table("passages").select(*keys).withColumn("score", F.lit(0.0)).where(F.lit(False))
    words = sorted({(w, term.prefix) for term in terms for w in term.words})
    asked = _matches(F.col("term"), *words[0])
    for w in words[1:]:
        asked = asked | _matches(F.col("term"), *w)
    rows = index.table("postings").where(asked)
    distinct = list(dict.fromkeys(terms))
    counts = []
    for i, term in enumerate(distinct):
        if len(term.words) == 1:
            counts.append(F.sum(F.when(_matches(F.col("term"), term.words[0], term.prefix), F.col("tf")).otherwise(0)).alias(f"tf{i}"))
        else:
            places = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("at"))), F.array().cast("array<int>")) for w in term.words]
            counts.append(F.struct(*[p.alias(f"p{j}") for j, p in enumerate(places)]).alias(f"tf{i}"))
    rows = rows.groupBy(*keys).agg(*counts)
    for i, term in enumerate(distinct):
        if len(term.words) > 1:
            starts = F.col(f"tf{i}.p0")
            for j in range(1, len(term.words)):
                starts = F.array_intersect(starts, F.transform(F.col(f"tf{i}.p{j}"), _less(j)))
            rows = rows.withColumn(f"tf{i}", F.size(starts))
    found = [F.col(f"tf{i}") > 0 for i in range(len(distinct))]
    # document frequencies of all terms and the statistics, as one row
    df = rows.agg(*[F.count_if(f).alias(f"n{i}") for i, f in enumerate(found)])
    stats = index.table("stats").agg(F.sum("rows").alias("n_rows"), (F.sum("total") / F.sum("rows")).alias("avgdl"))
    match = found[0]
    for f in found[1:]:
        match = match & f if every else match | f
    rows = rows.where(match if where is None else match & where).join(F.broadcast(df), how="cross").join(F.broadcast(stats), how="cross")
    total = F.lit(0.0)
    for term in terms:
        i = distinct.index(term)
        tf, n = F.col(f"tf{i}"), F.col(f"n{i}")
        idf = F.log((F.col("n_rows") - n + 0.5) / (n + 0.5))
        total = total + F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.withColumn("score", -total).select(*keys, "score")


def with_text(index: Index, page: DataFrame) -> DataFrame:
    """page (a bounded number of hits) with their text."""
    text = index.table("passages").select("doc_id", "segment", "text")
    return text.join(F.broadcast(page), ["doc_id", "segment"])

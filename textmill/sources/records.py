"""Readers and writers of records: JSON lines with unreadable ones kept apart, nested transcripts, packages."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from ..operators.chunking import let
from . import archives

WORD = "struct<start:double,end:double,text:string,probability:double,corrected_from:string>"
TRANSCRIPT = f"source string, model string, language string, duration double, segments array<struct<start:double,end:double,words:array<{WORD}>>>"
CORRUPT = "_corrupt"
#: Bytes that Latin 1 and Windows-1252 read differently.
_SPECIAL = [b for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")]
LATIN, WINDOWS = "".join(map(chr, _SPECIAL)), bytes(_SPECIAL).decode("cp1252")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The readable records, and the unreadable lines with their files."""
    full = types.StructType([*types.StructType.fromDDL(schema).fields, types.StructField(CORRUPT, types.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    rows = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    good = rows.where(f"r.{CORRUPT} IS NULL AND r IS NOT NULL").select("r.*").drop(CORRUPT)
    return good, rows.where(f"r.{CORRUPT} IS NOT NULL OR r IS NULL").select("file", "value")


def append_json(rows: DataFrame, path: str, mend: bool = False) -> None:
    """rows as JSON lines, in files of their own beside those that are there. mend: unreadable tails of these are cut first."""
    if mend:
        broken_tails(rows.sparkSession, path, cut=True).write.format("noop").mode("overwrite").save()
    rows.write.mode("append").json(path)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each segment of JSON transcripts: file, segment, start, end, text, words. Segments without text drop out; places stay."""
    rows = spark.read.schema(TRANSCRIPT).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("segments").alias("segment", "s"))
    text = F.trim(F.array_join(F.transform("s.words", lambda w: w["text"]), ""))
    return rows.select("file", "segment", F.col("s.start"), F.col("s.end"), text.alias("text"), F.col("s.words").alias("words")).where("text <> ''")


def preferred(files: DataFrame, job: str, variant: str, order: tuple[str, ...]) -> DataFrame:
    """Of each job's variants the first one in order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(variant))
    w = Window.partitionBy(job).orderBy(rank)
    return files.where(rank > 0).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_transcripts(segments: DataFrame, path: str) -> None:
    """Segments (source, model, language, duration, segment, start, end, words) as transcripts, a JSON line each. A run that fails leaves nothing."""
    rows = segments.groupBy("source", "model", "language", "duration").agg(F.array_sort(F.collect_list(F.struct("segment", "start", "end", "words"))).alias("s"))
    write_whole_transcripts(rows.select("source", "model", "language", "duration", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["words"].alias("words"))).alias("segments")), path)


def write_whole_transcripts(transcripts: DataFrame, path: str, compression: str = "none") -> None:
    """The same of rows that are whole transcripts (source, model, language, duration, segments: an array of start, end, words). Nothing is shuffled."""
    transcripts.write.mode("errorifexists").option("compression", compression).json(path)


def newest_first(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records of a folder's JSON files, newest file first, with its time; and the files that can't be read."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    full = types.StructType([*types.StructType.fromDDL(schema).fields, types.StructField(CORRUPT, types.StringType())])
    rows = files.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return rows.where(~bad).select("file", "modified", "r.*").drop(CORRUPT).orderBy(F.desc("modified"), "file"), rows.where(bad).select("file")


def states(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, size of each file: what tells an index that it has changed."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


#: Bytes that are read at a time from a log's end.
TAIL = 64 << 10


def _tail(file, size: int) -> int:
    """Bytes of a log up to where its last line that isn't empty begins, if that line isn't JSON; else all of them."""
    tail, at = b"", size
    while at and b"\n" not in tail.strip():
        at = max(0, at - TAIL)
        file.seek(at)
        tail = file.read(min(TAIL, size - at - len(tail))) + tail
    body = tail.rstrip()
    line = body.rpartition(b"\n")[2]
    try:
        if line:
            json.loads(line)
        return size
    except ValueError:
        return at + len(body) - len(line)


def broken_tails(spark: SparkSession, path: str, cut: bool = False) -> DataFrame:
    """file, size, kept: bytes of each log, and without an unreadable last line, as a broken append leaves it; unreadable lines before it stay. Only the end of a log
    is read. With cut the logs are cut there: a local one in place, others by way of a copy."""

    def of(parts):
        for part in parts:
            out = []
            for file, size in zip(part["file"], part["size"], strict=True):
                with archives.opened(file) as f:
                    kept = _tail(f, size)
                if cut and kept < size:
                    _cut(file, kept)
                out.append((file, size, kept))
            yield pd.DataFrame(out, columns=["file", "size", "kept"])

    files = [(file, size) for file, size in archives.listed(path)]
    rows = spark.createDataFrame(files, "file string, size long")
    return rows.repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism))).mapInPandas(of, "file string, size long, kept long")


def _cut(path: str, size: int) -> None:
    system, at = archives.file_system(path)
    if system.type_name == "local":
        os.truncate(at, size)
        checksum = os.path.join(os.path.dirname(at), f".{os.path.basename(at)}.crc")
        if os.path.exists(checksum):  # of the file as it was
            os.remove(checksum)
        return
    with system.open_input_stream(at) as old, system.open_output_stream(f"{at}.cut") as new:
        while size and (data := old.read(min(TAIL, size))):
            new.write(data)
            size -= len(data)
    system.move(f"{at}.cut", at)


def sniffed(content, name):
    """pdf, zip or text by a file's bytes; text has to be UTF-8 without a NUL and be named .txt or .md. Null for others."""
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(b"\x00"))
    return F.when(F.contains(F.substring(content, 1, 5), F.lit(b"%PDF-")), "pdf").when(F.contains(F.substring(content, 1, 4), F.lit(b"PK\x03\x04")), "zip").when(text & F.lower(name).rlike(r"\.(txt|md)$"), "text")


def decoded(content):
    """UTF-8, or else Windows-1252."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "iso-8859-1"), LATIN, WINDOWS))


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files, read whole: kind (other if none is told), size, hash and text."""
    rows = spark.read.format("binaryFile").load(path)
    content = F.col("content")
    return rows.select("path", "modificationTime", "length", F.sha2(content, 256).alias("sha256"), F.coalesce(sniffed(content, F.col("path")), F.lit("other")).alias("kind"), decoded(content).alias("text"))


def logical_pages(texts: DataFrame, key: str, most: int = 500) -> DataFrame:
    """key, page, text: sections that begin at lines with #, each a page, or pages of `most` words where it has more. texts: key, text."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("heading", F.startswith("line", F.lit("#")))
    return section_pages(lines.withColumn("line", F.trim(F.regexp_replace("line", "^#+", ""))), key, most)


def section_pages(lines: DataFrame, key: str, most: int = 500) -> DataFrame:
    """The same of lines that are told apart already. lines: key, at (their order), heading, line."""
    lines = lines.withColumn("section", F.sum(F.col("heading").cast("int")).over(Window.partitionBy(key).orderBy("at")))
    sections = lines.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(most)), lambda i: F.array_join(F.slice(w, i, F.lit(most)), " "))
    pages = let(T.words(F.col("text")), lambda w: F.when(F.size(w) <= most, F.array("text")).otherwise(cut(w)))
    rows = sections.select(key, "section", F.posexplode(pages).alias("part", "text"))
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("section", "part")) - 1).alias("page"), "text")


ASR_WORD = "struct<text:string,start:long,end:long,confidence:double>"


def asr_segments(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """key, segment, start, end, words of speech recognition replies ({"sentences": [{"words": [...]}]}, times in milliseconds). Sentences without
    words drop out, and the others are numbered without gaps."""
    sentences = F.from_json(reply, f"struct<sentences:array<struct<words:array<{ASR_WORD}>>>>")["sentences"]
    spoken = F.filter(sentences, lambda s: F.size(s["words"]) > 0)
    rows = replies.select(key, F.posexplode(spoken).alias("segment", "s"))
    seconds = lambda ms: ms / 1000
    words = F.transform("s.words", lambda w: F.struct(seconds(w["start"]).alias("start"), seconds(w["end"]).alias("end"), w["text"].alias("text"), w["confidence"].alias("probability")))
    return rows.select(key, "segment", seconds(F.col("s.words")[0]["start"]).alias("start"), seconds(F.element_at("s.words", -1)["end"]).alias("end"), words.alias("words"))


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their references, one row a reference; questions without one have nulls."""
    reference = "struct<kind:string,filename:string,page:int,job_id:string,start_s:double,end_s:double>"
    rows = spark.read.schema(f"id string, type string, course string, question string, references array<{reference}>").json(path, multiLine=True)
    return rows.select("id", "type", "course", "question", F.explode_outer("references").alias("r")).select("id", "type", "course", "question", "r.*")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """file, question_id, passage_id, vote of JSON files {question: {passage: vote}}."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string,map<string,int>>").alias("v"))
    return rows.select("file", F.explode("v").alias("question_id", "p")).select("file", "question_id", F.explode("p").alias("passage_id", "vote"))


def write_inventory(rows: DataFrame, path: str) -> None:
    """Members as Parquet, with a manifest of hashes and sizes beside them."""
    rows.write.mode("overwrite").parquet(f"{path}/members")
    rows.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size")).write.mode("overwrite").json(f"{path}/manifest")


def inventory_faults(spark: SparkSession, path: str) -> DataFrame:
    """path, fault of what manifest and members don't agree on, or that leaves the package's folder."""
    told = spark.read.schema("path string, sha256 string, size long").json(f"{path}/manifest").select("path", F.col("sha256").alias("told"), "size")
    there = spark.read.parquet(f"{path}/members").select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("length"))
    fault = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("told").isNull(), "extra")
        .when(F.col("path").startswith("/") | F.contains(F.concat(F.lit("/"), "path", F.lit("/")), F.lit("/../")), "path")
        .when(F.col("size") != F.col("length"), "size")
        .when(F.col("told") != F.col("sha256"), "hash")
    )
    return told.join(there, "path", "full").select("path", fault.alias("fault")).where("fault is not null")


def rendered(segments: DataFrame, by: str) -> DataFrame:
    """by, text: each group's segments in order, a line each with its time."""
    line = F.format_string("[%02d:%02d:%02d] %s", F.floor(F.col("start") / 3600).cast("int"), (F.floor(F.col("start") / 60) % 60).cast("int"), (F.floor("start") % 60).cast("int"), "text")
    rows = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("segment", line.alias("line")))).alias("l"))
    return rows.select(by, F.array_join("l.line", "\n").alias("text"))


def book(segments: DataFrame, by: str, gap: float = 2.0, longest: float = 120.0) -> DataFrame:
    """by, markdown, book: each group's paragraphs, with the time each begins, and without. segments: by, segment, start, text."""
    from ..operators.chunking import timed_paragraphs

    rows = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("segment", "start", "text"))).alias("s"))
    rows = rows.withColumn("p", timed_paragraphs(F.col("s.start"), gap, longest)).select(by, F.explode(F.arrays_zip("s", "p")).alias("x")).select(by, "x.s.*", "x.p")
    rows = rows.groupBy(by, "p").agg(F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"]), " ").alias("text"))
    stamp = F.format_string("%02d:%02d:%02d", F.floor(F.col("start") / 3600).cast("int"), (F.floor(F.col("start") / 60) % 60).cast("int"), (F.floor("start") % 60).cast("int"))
    rows = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("p", stamp.alias("time"), "text"))).alias("p"))
    joined = lambda line: F.array_join(F.transform("p", line), "\n\n")
    return rows.select(by, joined(lambda x: F.concat(F.lit("**["), x["time"], F.lit("]** "), x["text"])).alias("markdown"), joined(lambda x: x["text"]).alias("book"))

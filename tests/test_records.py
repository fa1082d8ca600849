import json
import os
import zipfile

from pyspark.sql import functions as F

from textmill.operators import fusion
from textmill.sources import archives as A
from textmill.sources import records as R
from textmill.streaming import logs as L


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\nnot json\n\n{"id": 2}\n{"id": "z"}\n{"id": 3, "t"')
    good, bad = R.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string")
    assert sorted(r[:] for r in good.collect()) == [(1, "x"), (2, None)] and bad.count() == 3


def test_transcripts(spark, tmp_path):
    word = lambda t: {"start": 0.0, "end": 1.0, "text": t, "probability": 0.9}
    (tmp_path / "t.json").write_text(json.dumps({"source": "s", "model": "m", "language": "it", "duration": 9.0, "segments": [{"start": 0.0, "end": 1.0, "words": [word(" a"), word(" b")]}, {"start": 1.0, "end": 2.0, "words": []}, {"start": 3661.0, "end": 3662.0, "words": [word(" c")]}]}))
    rows = R.transcripts(spark, str(tmp_path / "t.json"))
    assert [(r.segment, r.text) for r in rows.orderBy("segment").collect()] == [(0, "a b"), (2, "c")]
    assert R.rendered(rows, "file").first().text == "[00:00:00] a b\n[01:01:01] c"


def test_plain_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("perché “x”".encode("cp1252"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    rows = {r.path.rpartition("/")[2]: r for r in R.plain_texts(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "perché “x”" and rows["b.pdf"].kind == "pdf"


def test_inventory(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("../b", b"2")], "path string, content binary")
    R.write_inventory(rows, str(tmp_path))
    assert [r[:] for r in R.inventory_faults(spark, str(tmp_path)).collect()] == [("../b", "path")]
    spark.createDataFrame([("a", b"x"), ("c", b"3")], "path string, content binary").write.mode("overwrite").parquet(f"{tmp_path}/members")
    assert sorted(r[:] for r in R.inventory_faults(spark, str(tmp_path)).collect()) == [("../b", "missing"), ("a", "hash"), ("c", "extra")]


def test_preferred(spark):
    rows = spark.createDataFrame([(1, "original"), (1, "corrected"), (2, "original"), (3, "other")], "job int, variant string")
    assert sorted(r[:] for r in R.preferred(rows, "job", "variant", ("corrected", "original")).collect()) == [(1, "corrected"), (2, "original")]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("u", 0, "a"), ("u", 60, "b"), ("v", 10, "c"), ("u", 5000, "d")], "k string, s long, x string").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    L.to_table(L.latest_states(stream, "k", ["ts"], "x"), str(tmp_path / "latest"), str(tmp_path / "c1"), "update")
    assert sorted(r[:] for r in spark.read.parquet(str(tmp_path / "latest")).select("k", "x", "events").collect()) == [("u", "d", 3), ("v", "c", 1)]
    L.to_table(L.activity(stream, "k", "ts", "1 hour", "1 minute"), str(tmp_path / "activity"), str(tmp_path / "c2"))
    assert ("u", 2) in {(r.k, r.events) for r in spark.read.parquet(str(tmp_path / "activity")).collect()}
    assert L.sessions(stream, "k", "ts", "10 minutes", "1 minute").isStreaming


def test_logs_and_listings(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n{"a": ')
    (tmp_path / "logs/b.jsonl").write_text('{"a": 3}\n')
    (tmp_path / "logs/c.jsonl").write_text("")
    (tmp_path / "logs/d.jsonl").write_text('{"a": 6}\n{"a": "' + "é" * 100_000 + "\n\n")
    (tmp_path / "logs/e.jsonl").write_text('{"a"')
    tails = {r.file.rpartition("/")[2]: (r.size, r.kept) for r in R.broken_tails(spark, str(tmp_path / "logs")).collect()}
    assert tails == {"a.jsonl": (31, 25), "b.jsonl": (9, 9), "c.jsonl": (0, 0), "d.jsonl": (200_018, 9), "e.jsonl": (4, 0)}
    R.append_json(spark.createDataFrame([(7,)], "a int"), str(tmp_path / "logs"), mend=True)
    assert (tmp_path / "logs/a.jsonl").read_text() == '{"a": 1}\nbroken\n{"a": 2}\n' and (tmp_path / "logs/d.jsonl").read_text() == '{"a": 6}\n'
    good, bad = R.json_lines(spark, str(tmp_path / "logs"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2, 3, 6, 7] and [r.value for r in bad.collect()] == ["broken"]
    R.append_json(spark.createDataFrame([(4,)], "a int"), str(tmp_path / "more"))
    R.append_json(spark.createDataFrame([(5,)], "a int"), str(tmp_path / "more"))
    assert sorted(r.a for r in R.json_lines(spark, str(tmp_path / "more"), "a int")[0].collect()) == [4, 5]
    (tmp_path / "records").mkdir()
    for n, (name, text) in enumerate((("x", '{"id": "x"}'), ("y", '{"id": '), ("z", '{"id": "z"}'))):
        (tmp_path / f"records/{name}.json").write_text(text)
        os.utime(tmp_path / f"records/{name}.json", (1000 + n, 1000 + n))
    good, bad = R.newest_first(spark, str(tmp_path / "records"), "id string")
    assert [r.id for r in good.collect()] == ["z", "x"] and [r.file[-6:] for r in bad.collect()] == ["y.json"]
    assert {(r.file[-6:], r.size, r.modified.timestamp()) for r in R.states(spark, str(tmp_path / "records")).collect()} >= {("x.json", 11, 1000.0)}


def test_kinds_and_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.txt", b"value 10\nnext 0\n"), ("b.md", b"x\x00y"), ("c.txt", b"%PDF-1"), ("d.pdf", b"text"), ("e.txt", "è".encode("cp1252"))):
        (tmp_path / "in" / name).write_bytes(content)
    out = {r.path[-5:]: (r.kind, r.text) for r in R.plain_texts(spark, str(tmp_path / "in")).collect()}
    assert {k: v[0] for k, v in out.items()} == {"a.txt": "text", "/b.md": "other", "c.txt": "pdf", "d.pdf": "other", "e.txt": "other"} and out["e.txt"][1] == "è"
    (tmp_path / "zips").mkdir()
    for name, sizes in (("a", [10, 20]), ("b", [1] * 6), ("c", [5000])):
        with zipfile.ZipFile(tmp_path / f"zips/{name}.zip", "w") as z:
            for i, n in enumerate(sizes):
                z.writestr(str(i), "x" * n)
    (tmp_path / "zips/d.zip").write_text("none")
    assert {r.archive[0]: (r.entries, r.bytes, r.fault) for r in A.directories(spark, str(tmp_path / "zips"), entries=5, archive_bytes=1000).collect()} == {"a": (2, 30, None), "b": (6, 6, "too many entries"), "c": (1, 5000, "too large"), "d": (None, None, "unreadable")}


def test_gold_and_transcripts(spark, tmp_path):
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold/g.json").write_text('[{"id": "1", "type": "exam", "question": "q", "references": [{"kind": "document", "filename": "f", "page": 2}]}, {"id": "2", "type": "negative", "references": []}]')
    assert sorted((r.id, r.kind, r.page) for r in R.gold_set(spark, str(tmp_path / "gold")).collect()) == [("1", "document", 2), ("2", None, None)]
    (tmp_path / "votes").mkdir()
    (tmp_path / "votes/1.json").write_text('{"q1": {"p1": 2}, "q3": {"p": 1}}')
    (tmp_path / "votes/2.json").write_text('{"q1": {"p2": 0}, "q2": {"p9": 1}, "q3": {"p": 2}}')
    votes = R.verdicts(spark, str(tmp_path / "votes")).withColumnRenamed("file", "file_no")
    assert sorted(r[:] for r in fusion.merge_verdicts(votes, ["question_id", "passage_id"]).collect()) == [("q1", "p1", 2), ("q1", "p2", 0), ("q2", "p9", 1), ("q3", "p", 2)]
    words = [(0.0, 0.4, " ciao", 0.9, None)]
    rows = spark.createDataFrame([("s", "m", "it", 9.0, 1, 5.0, 6.0, words), ("s", "m", "it", 9.0, 0, 0.0, 1.0, words)], f"source string, model string, language string, duration double, segment int, start double, end double, words array<{R.WORD}>")
    R.write_transcripts(rows, str(tmp_path / "t"))
    assert [(r.segment, r.start, r.text) for r in R.transcripts(spark, str(tmp_path / "t/*.json")).orderBy("segment").collect()] == [(0, 0.0, "ciao"), (1, 5.0, "ciao")]


def test_whole_transcripts_are_compressed_and_not_shuffled(spark, tmp_path):
    segments = f"array<struct<start:double,end:double,words:array<{R.WORD}>>>"
    rows = spark.createDataFrame([("1", "m", "it", 1.0, [(0.0, 5.0, [(0.0, 0.5, " a", 0.9, None)] * 1000)]), ("2", "m", "it", 1.0, [])], f"source string, model string, language string, duration double, segments {segments}")
    R.write_whole_transcripts(rows, str(tmp_path / "t"), "gzip")
    files = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]
    assert all(p.name.endswith(".json.gz") for p in files) and sum(p.stat().st_size for p in files) < 5_000
    read = spark.read.schema(R.TRANSCRIPT).json(str(tmp_path / "t")).select("source", F.size("segments").alias("n"), F.size("segments.words")).collect()
    assert sorted((r.source, r.n) for r in read) == [("1", 1), ("2", 0)]


def test_words_of_a_section_are_worked_out_once(spark):
    lines = spark.createDataFrame([(1, i, i == 0, f"w{i}") for i in range(7)], "id long, at long, heading boolean, line string")
    out = R.section_pages(lines, "id", 3)
    assert [r.text for r in sorted(out.collect(), key=lambda r: r.page)] == ["w0 w1 w2", "w3 w4 w5", "w6"]
    assert out.select("text")._jdf.queryExecution().optimizedPlan().toString().count("split(text") <= 2  # the pages, and whether there are any

import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textmill.sources import archives as A
from textmill.sources import office as O


def zipped(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return path.read_bytes()


def rows(frame):
    return {(r.archive, r.member): r for r in frame.collect()}


def test_members(spark, tmp_path):
    files = {f"a{i}/ü{i}.txt": bytes([i]) * i * 5000 for i in range(40)}
    zipped(tmp_path / "x.zip", list(files.items()) + [("folder/", b"")])
    zipped(tmp_path / "y.zip", [("stored", b"abc" * 50_000), ("empty", b"")], zipfile.ZIP_STORED)
    (tmp_path / "sub").mkdir()
    zipped(tmp_path / "sub" / "z.zip", [])
    (tmp_path / "no.zip").write_bytes(b"not an archive")
    for split in (20_000, 1 << 20):
        found = A.members(spark, str(tmp_path), split_bytes=split, ending=".zip")
        out = rows(found)
        assert {m: r.content for (a, m), r in out.items() if a == "x.zip"} == files
        assert all(r.sha256 == hashlib.sha256(r.content).hexdigest() and r.size == len(r.content) for r in out.values() if not r.fault)
        assert out["y.zip", "stored"].size == 150_000 and out["y.zip", "empty"].content == b"" and out["no.zip", None].fault == "unreadable"
        assert len(out) == 43 == found.count(), sorted(set(out) - {('x.zip', m) for m in files})
    assert A.members(spark, str(tmp_path), split_bytes=20_000).rdd.getNumPartitions() >= 3


def faults(spark, path, data, **options):
    path.write_bytes(data)
    return {r.member: r.fault for r in A.members(spark, str(path), **options).collect()}


def test_faults(spark, tmp_path):
    path = tmp_path / "f.zip"
    data = zipped(path, [("small", b"s" * 100), ("bomb", b"\0" * 5_000_000), ("after", b"x")])
    assert faults(spark, path, data, member_bytes=1_000_000) == {"small": None, "bomb": "too large", "after": None}
    assert faults(spark, path, data, archive_bytes=1_000_000) == {None: "too large"} and faults(spark, path, data, entries=2) == {None: "too many entries"}
    # sizes that lie: the directory claims one byte for the bomb
    lies = bytearray(data)
    at = lies.index(b"PK\x01\x02", lies.index(b"PK\x01\x02") + 1)
    lies[at + 24 : at + 28] = struct.pack("<I", 1)
    assert faults(spark, path, bytes(lies), member_bytes=1_000_000)["bomb"] == "too large"
    # a byte of the stream changed, the header's method changed, the directory's offset of one pointing at another
    plain = zipped(path, [("a", b"hello world" * 20), ("b", b"other")], zipfile.ZIP_STORED)
    broken = bytearray(plain)
    broken[plain.index(b"hello") + 3] ^= 1
    assert faults(spark, path, bytes(broken)) == {"a": "checksum", "b": None}
    method = bytearray(plain)
    method[8] = 8
    assert faults(spark, path, bytes(method))["a"] == "header"
    second = plain.index(b"PK\x01\x02", plain.index(b"PK\x01\x02") + 1)
    grown = bytearray(plain)
    first = plain.index(b"PK\x01\x02")
    grown[first + 20 : first + 24] = struct.pack("<I", 10_000)
    assert faults(spark, path, bytes(grown))["a"] == "overlap"
    away = bytearray(plain)
    away[second + 42 : second + 46] = struct.pack("<I", 5)
    assert faults(spark, path, bytes(away))["b"] == "header"
    locked = bytearray(plain)
    locked[first + 8] |= 1
    assert faults(spark, path, bytes(locked))["a"] == "encrypted"


@pytest.mark.parametrize("change,fault", [(lambda s: s + b"more", "trailing bytes"), (lambda s: s[:-3], "truncated"), (lambda s: b"\xff" * len(s), "damaged"), (lambda s: s, None)])
def test_streams(change, fault):
    """Deflate streams that end early, late or not at all, with sizes that fit them."""
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = bytes(range(256)) * 700
    stream = change(packer.compress(raw) + packer.flush())
    name = b"m"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0, 8, 0, 0, zlib.crc32(raw), len(stream), 1, 1, 0) + name
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 20, 20, 0, 8, 0, 0, zlib.crc32(raw), len(stream), 1, 1, 0, 0, 0, 0, 0, 0) + name
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, len(central), len(local) + len(stream), 0)
    archive = A.Archive(io.BytesIO(local + stream + central + end))
    if fault:
        with pytest.raises(A.Fault, match=fault):
            list(archive.chunks(archive.members[0]))
    else:
        chunks = list(archive.chunks(archive.members[0]))
        assert b"".join(chunks) == raw and max(map(len, chunks)) <= A.CHUNK


def packages(spark, n=5):
    data = [(f"p{i}", f"d/{j}.txt", k, f"{i} {j} {k} ".encode() * 1000) for i in range(n) for j in range(4) for k in range(2)]
    return spark.createDataFrame(data, "package string, member string, place int, content binary"), data


def test_packages(spark, tmp_path):
    frame, data = packages(spark)
    path = str(tmp_path / "out")
    A.write_packages(frame, path, ("member", "place"))
    found = A.members(spark, path)
    out = rows(found)
    assert len(out) == 25 and A.manifest_faults(found).collect() == []
    assert all(out[f"p{i}.zip", f"d/{j}.txt"].content == b"".join(d for p, m, _, d in data if (p, m) == (f"p{i}", f"d/{j}.txt")) for i in range(5) for j in range(4))
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["_SUCCESS", *(f"p{i}.zip" for i in range(5))]
    with pytest.raises(PySparkException):
        A.write_packages(frame, path, ("member", "place"))
    assert len(rows(A.members(spark, path))) == 25
    A.write_packages(frame.where("package = 'p1' and member <> 'd/0.txt'"), path, ("member", "place"), overwrite=True)
    assert len(rows(A.members(spark, path))) == 24
    zipped(tmp_path / "out" / "p2.zip", [("d/0.txt", b"changed"), ("d/9.txt", b"new"), ("manifest.json", (out["p2.zip", "manifest.json"].content).replace(b"d/3", b"d/4"))])
    assert {(r.member, r.fault) for r in A.manifest_faults(A.members(spark, path)).collect()} == {("d/0.txt", "size"), ("d/9.txt", "extra"), ("d/1.txt", "missing"), ("d/2.txt", "missing"), ("d/4.txt", "missing")}


def test_failed_task_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    frame, _ = packages(spark, 8)
    path = tmp_path / "broken"
    bad = frame.withColumn("content", F.when(F.col("package") == "p3", F.when(F.col("place") == 1, F.raise_error("broken").cast("binary")).otherwise(F.col("content"))).otherwise(F.col("content")))
    with pytest.raises(PySparkException):
        A.write_packages(bad, str(path), ("member", "place"))
    assert not path.exists() or list(path.iterdir()) == []
    for member in ("../x", "/x", "a/../b", None):
        with pytest.raises(PySparkException):
            A.write_packages(frame.withColumn("member", F.lit(member)), str(path))
    assert not path.exists() or list(path.iterdir()) == []


def document(body, styles='<w:style w:type="paragraph" w:styleId="T1"><w:name w:val="heading 2"/></w:style><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="character" w:styleId="C"><w:name w:val="Heading 1 Char"/></w:style>', head=""):
    rels = lambda *r: f'<Relationships xmlns="{O.PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{O.R}/{k}" Target="{t}"/>' for i, (k, t) in enumerate(r)) + "</Relationships>"
    return [("_rels/.rels", rels(("officeDocument", "/main/doc.xml"))), ("main/_rels/doc.xml.rels", rels(("styles", "../s.xml"))), ("s.xml", f'<w:styles xmlns:w="{O.W}">{styles}</w:styles>'), ("main/doc.xml", f'{head}<w:document xmlns:w="{O.W}" xmlns:x="u"><w:body>{body}</w:body></w:document>')]


def read_docx(spark, path, parts, **options):
    zipped(path, parts)
    return [(r.heading, r.text, r.fault) for r in sorted(O.docx_paragraphs(spark, str(path), **options).collect(), key=lambda r: r.place or 0)]


def test_docx(spark, tmp_path):
    path = tmp_path / "a.docx"
    styled = lambda i, t: f'<w:p><w:pPr><w:pStyle w:val="{i}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = styled("T1", "Head") + styled("none", "plain") + styled("C", "character style") + "<w:p/>"
    body += '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type="page"/><w:noBreakHyphen/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>no</w:t></w:r></w:ins></w:p>'
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    assert read_docx(spark, path, document(body)) == [(True, "Head", None), (False, "plain", None), (False, "character style", None), (False, "", None), (False, "a\tb\nc-link", None)]
    entity = document('<w:p><w:r><w:t>Safe &x; text</w:t></w:r></w:p>', head='<!DOCTYPE d [<!ENTITY x "PRIVATE">]>')
    assert read_docx(spark, path, entity) == [(False, "Safe  text", None)]
    many = "".join(f"<w:p><w:r><w:t>{i}</w:t></w:r></w:p>" for i in range(5000))
    assert len(read_docx(spark, path, document(many))) == 5000
    assert read_docx(spark, path, document(many), part_bytes=10_000) == [(None, None, "too large")]
    assert read_docx(spark, path, document(many + "<w:p>")) == [(None, None, "xml")]
    assert read_docx(spark, path, document("")[:1]) == [(None, None, "no main/doc.xml")] and read_docx(spark, path, document(""), entries=3) == [(None, None, "too many entries")]
    assert read_docx(spark, path, [("x", b"")]) == [(None, None, "no document")]


def test_docx_round_trip(spark, tmp_path):
    texts = ["Title & <b>", "Head", "one\ttwo\nthree", " spaces  kept ", "", None, "nul\x00 bell\x07 é😀", "a\r\nb\rc"]
    styles = ["Title", "Heading1", None, None, "Normal", "unknown", None, None]
    frame = spark.createDataFrame([(d, i, s, t) for d in ("x", "y") for i, (s, t) in enumerate(zip(styles, texts, strict=True))], "name string, place int, style string, text string")
    O.write_docx(frame, str(tmp_path / "out"), "name")
    got = O.docx_paragraphs(spark, str(tmp_path / "out")).collect()
    expected = [(False, "Title & <b>"), (True, "Head"), (False, "one\ttwo\nthree"), (False, " spaces  kept "), (False, ""), (False, ""), (False, "nul bell é😀"), (False, "a\nb\nc")]
    assert {(r.archive, r.kind, r.entries) for r in A.directories(spark, str(tmp_path / "out")).collect()} == {("x.docx", "docx", 7), ("y.docx", "docx", 7)}
    for name in ("x.docx", "y.docx"):
        assert [(r.heading, r.text) for r in sorted(got, key=lambda r: r.place) if r.file == name] == expected


def slide(shapes, kind="sld"):
    return f'<p:{kind} xmlns:p="{O.P}" xmlns:a="{O.A}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{kind}>'


def shape(text, top=None, ph=""):
    off = f'<a:xfrm><a:off x="1" y="{top}"/></a:xfrm>' if top is not None else ""
    return f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{off}</p:spPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{line}</a:t></a:r></a:p>" for line in text.split("|"))}</p:txBody></p:sp>'


def test_pptx(spark, tmp_path):
    rels = lambda *r: f'<Relationships xmlns="{O.PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{O.R}/{k}" Target="{t}"/>' for i, k, t in r) + "</Relationships>"
    entries = [
        ("_rels/.rels", rels(("a", "officeDocument", "ppt/presentation.xml"))),
        ("ppt/presentation.xml", f'<p:presentation xmlns:p="{O.P}" xmlns:r="{O.R}"><p:sldIdLst><p:sldId id="1" r:id="z"/><p:sldId id="2" r:id="b"/></p:sldIdLst></p:presentation>'),
        ("ppt/_rels/presentation.xml.rels", rels(("b", "slide", "slides/s1.xml"), ("z", "slide", "slides/s2.xml"))),
        ("ppt/slides/s1.xml", slide(shape("low", 300) + shape("high|two", 100) + shape("", 0) + f"<p:grpSp>{shape('grouped', 0)}</p:grpSp>" + shape("title", None, '<p:ph type="title" idx="5"/>') + shape("body", None, '<p:ph idx="7"/>'))),
        ("ppt/slides/_rels/s1.xml.rels", rels(("n", "notesSlide", "../notes/n1.xml"), ("l", "slideLayout", "../l.xml"))),
        ("ppt/notes/n1.xml", slide(shape("number", 1, '<p:ph type="sldNum"/>') + shape("said|aloud", 1, '<p:ph type="body" idx="1"/>'), "notes")),
        ("ppt/l.xml", slide(shape("", 200, '<p:ph type="title" idx="5"/>') + shape("", None, '<p:ph type="pic" idx="7"/>'), "sldLayout")),
        ("ppt/_rels/l.xml.rels", rels(("m", "slideMaster", "m.xml"))),
        ("ppt/m.xml", slide(shape("", 250, '<p:ph type="body" idx="1"/>'), "sldMaster")),
        ("ppt/slides/s2.xml", slide("")),
    ]
    zipped(tmp_path / "a.pptx", entries)
    (tmp_path / "b.pptx").write_bytes(b"x")
    texts = O.pptx_texts(spark, str(tmp_path))
    assert [(r.file, r.page, r.text) for r in O.slide_pages(texts).orderBy("page").collect()] == [("a.pptx", 0, ""), ("a.pptx", 1, "high\ntwo\ntitle\nbody\nlow\nsaid\naloud")]
    assert [r.fault for r in texts.where("fault is not null").collect()] == ["unreadable"]


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_office_files_are_read_once_if_small(tmp_path, monkeypatch, held):
    with zipfile.ZipFile(tmp_path / "a.x", "w") as z:
        z.writestr("m", "m")
    reads = []

    def rows(office):
        reads.append(1)
        yield from ((i, False, "text") for i in range(3))

    monkeypatch.setattr(O, "HELD", held)
    reader = O.OfficeReader({"path": str(tmp_path), "ending": ".x"}, {}, rows, (None,) * 3)
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("a.x", i, False, "text", None) for i in range(3)]
    assert len(reads) == (1 if held else 2)


def test_only_folders_go_through_the_driver(spark, tmp_path):
    """Of many packages the driver sees folders, when they are written and when they are read."""
    writer = A.PackageWriter({"path": str(tmp_path / "p"), "ending": ".docx", "folders": "100", "manifest": "false"}, False)
    told = [writer.write((f"d{t}-{i}", member, text.encode()) for i in range(350) for member, text in document("<w:p/>")) for t in range(2)]
    told.append(writer.write((f"gone{i}", "x", b"x") for i in range(3)))  # an attempt that isn't committed
    assert [(len(m.files), len(m.folders)) for m in told] == [(0, 4), (0, 4), (0, 1)]
    writer.commit([*told[:2], None])
    reader = O.OfficeReader({"path": str(tmp_path / "p"), "listed": "150"}, {}, O.paragraphs, (None,) * 3)
    parts = reader.partitions()
    assert sum(len(p.ranges) for p in parts) <= 200 and sum(p.folder is not None for p in parts) == 6
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(f"d{t}-{i}.docx" for t in range(2) for i in range(350))
    assert [r[1:] for r in reader.read(parts[-1])][0] == (0, False, "", None)
    with pytest.raises(FileExistsError):
        again = A.PackageWriter({"path": str(tmp_path / "p"), "folders": "100"}, False)
        again.commit([again.write(iter([("d", "x", b"x")]))])
    assert len(list((tmp_path / "p").iterdir())) == 9
    frame = spark.createDataFrame([(i, 0, None, f"text {i}") for i in range(30)], "name int, place int, style string, text string")
    O.write_docx(frame, str(tmp_path / "out"), "name", folders=2)
    assert sorted((r.file, r.text) for r in O.docx_paragraphs(spark, str(tmp_path / "out"), listed=3).collect()) == sorted((f"{i}.docx", f"text {i}") for i in range(30))
    bad = frame.withColumn("text", F.when(F.col("name") == 9, F.raise_error("broken")).otherwise(F.col("text")))
    with pytest.raises(PySparkException):
        O.write_docx(bad, str(tmp_path / "broken"), "name", folders=2)
    assert not (tmp_path / "broken").exists() or list((tmp_path / "broken").iterdir()) == []

"""Word documents and slides as Spark sources, and Word documents as a sink.

Parts are XML, parsed in a stream from the archive's inflated chunks: a task holds a paragraph or a shape at a time. Entities are never expanded. A file is
read to its end before its rows are given out, so one that turns out to be damaged gives a row with its fault and nothing else; the rows of one with
little text are held meanwhile, others are read again.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceReader

from .archives import LISTED, Archive, Fault, Split, _Source, opened, planned, splits, write_packages

# Namespaces, relation and content types, part names and style names of the formats.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: A placeholder of a layout takes its place from the one of this type on the master.
MASTER = {"ctrTitle": "title", "title": "title", "dt": "dt", "ftr": "ftr", "sldNum": "sldNum"}
#: Characters of a file's rows that are held until all of it has been read.
HELD = 1 << 20
HEADING = re.compile(r"heading [1-9]$|Heading")


def events(chunks: Iterator[bytes]) -> Iterator[tuple[str, list[str], dict | str | None]]:
    """(start, end or text; the names of the elements that are open; attributes or text). Names are a prefix (w, a, p, r; others whole) and a local name."""
    short = {W: "w", A: "a", P: "p", R: "r"}

    def name(x: str) -> str:
        space, _, local = x.rpartition(" ")
        return f"{short.get(space, space)}:{local}" if space else local

    queue, path = [], []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def start(tag, attributes):
        path.append(name(tag))
        queue.append(("start", list(path), {name(k): v for k, v in attributes.items()}))

    def end(_):
        queue.append(("end", list(path), None))
        path.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: queue.append(("text", list(path), text))
    parser.DefaultHandler = lambda _: None  # with it, references to a document's own entities stay out of the text
    try:
        for data in chunks:
            parser.Parse(data, False)
            yield from queue
            queue.clear()
        parser.Parse(b"", True)
        yield from queue
    except expat.ExpatError as e:
        raise Fault("xml") from e


class Office:
    """Parts of a package, found by their relations."""

    def __init__(self, file, most: int, **limits):
        self.archive, self.most = Archive(file, **limits), most

    def part(self, name: str) -> Iterator[tuple]:
        if name not in self.archive.by_name:
            raise Fault(f"no {name}")
        return events(self.archive.chunks(self.archive.by_name[name], self.most))

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id: (end of the type, part) of what a part, or the package (""), relates to."""
        folder, base = posixpath.split(part)
        name = posixpath.join(folder, "_rels", f"{base}.rels")
        if name not in self.archive.by_name:
            return {}
        found = [at for kind, path, at in self.part(name) if kind == "start" and path[-1].endswith(":Relationship") and at.get("TargetMode") != "External"]
        return {r["Id"]: (r["Type"].rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, r["Target"])).lstrip("/")) for r in found if "Id" in r and "Target" in r and "Type" in r}

    def related(self, part: str, kind: str) -> str | None:
        return next((target for k, target in self.relations(part).values() if k == kind), None)

    def main(self) -> str:
        part = self.related("", "officeDocument")
        if part is None:
            raise Fault("no document")
        return part


def heading_styles(office: Office, part: str | None) -> tuple[set[str], set[str], bool]:
    """Ids of paragraph styles, those of headings, and whether the style of paragraphs without one is a heading."""
    known, headings, default, now = set(), set(), False, None
    for kind, path, at in office.part(part) if part else ():
        if kind != "start":
            continue
        if path[-1] == "w:style":
            now = at if at.get("w:type") == "paragraph" else None
            known |= {at.get("w:styleId")} if now else set()
        elif now and path[-2:] == ["w:style", "w:name"] and HEADING.match(at.get("w:val", "")):
            headings.add(now.get("w:styleId"))
            default |= now.get("w:default") in ("1", "true", "on")
    return known, headings, default


def paragraphs(office: Office) -> Iterator[tuple[int, bool, str]]:
    """place, heading, text of the paragraphs of a document's body (not those in tables and boxes)."""
    main = office.main()
    known, headings, default = heading_styles(office, office.related(main, "styles"))
    place, heading, text = 0, default, []
    signs = {"w:tab": "\t", "w:ptab": "\t", "w:cr": "\n", "w:noBreakHyphen": "-"}
    for kind, path, at in office.part(main):
        if path[:3] != ["w:document", "w:body", "w:p"]:
            continue
        inside = path[3:]
        if not inside:
            if kind == "start":
                heading, text = default, []
            elif kind == "end":
                yield place, heading, "".join(text)
                place += 1
        elif kind == "start" and inside == ["w:pPr", "w:pStyle"]:
            heading = at.get("w:val") in headings if at.get("w:val") in known else default
        elif inside[0] == "w:r" or inside[:2] == ["w:hyperlink", "w:r"]:
            last = inside[1 if inside[0] == "w:r" else 2 :]
            if kind == "text" and last == ["w:t"]:
                text.append(at)
            elif kind == "start" and len(last) == 1:
                text.append("\n" if last[0] == "w:br" and at.get("w:type", "textWrapping") == "textWrapping" else signs.get(last[0], ""))


def shapes(office: Office, part: str) -> Iterator[tuple[str | None, str | None, int | None, str]]:
    """placeholder's type and number (None: not one), top if given, text of each shape of a slide, layout, master or notes page."""
    kind_, number, top, lines = None, None, None, []
    for kind, path, at in office.part(part):
        if len(path) < 4 or path[1:4] != ["p:cSld", "p:spTree", "p:sp"]:
            continue
        inside = path[4:]
        if not inside:
            if kind == "start":
                kind_, number, top, lines = None, None, None, []
            elif kind == "end":
                yield kind_, number, top, "\n".join(map("".join, lines))
        elif kind == "start" and inside == ["p:nvSpPr", "p:nvPr", "p:ph"]:
            kind_, number = at.get("type", "obj"), at.get("idx", "0")
        elif kind == "start" and inside == ["p:spPr", "a:xfrm", "a:off"]:
            top = int(at["y"]) if at.get("y", "").lstrip("-").isdigit() else None
        elif inside[:2] == ["p:txBody", "a:p"]:
            if kind == "start" and len(inside) == 2:
                lines.append([])
            elif kind == "start" and inside[2:] == ["a:br"]:
                lines[-1].append("\v")
            elif kind == "text" and inside[2:] in (["a:r", "a:t"], ["a:fld", "a:t"]):
                lines[-1].append(at)


def slides(office: Office) -> Iterator[tuple[int, int, bool, int, str | None]]:
    """slide, place, notes, top, text of each text on each slide; a slide's first row has no text."""
    main = office.main()
    relations = office.relations(main)
    order = [at.get("r:id") for kind, path, at in office.part(main) if kind == "start" and path == ["p:presentation", "p:sldIdLst", "p:sldId"]]
    layouts: dict[str | None, tuple[dict, dict]] = {}

    def places(layout: str | None) -> tuple[dict, dict]:
        """Types and tops of a layout's placeholders by number, and tops of those of its master by type."""
        if layout not in layouts:
            master = office.related(layout, "slideMaster") if layout else None
            layouts[layout] = ({n: (k, top) for k, n, top, _ in reversed(list(shapes(office, layout))) if k} if layout else {}, {k: top for k, _, top, _ in reversed(list(shapes(office, master))) if k} if master else {})
        return layouts[layout]

    for n, part in enumerate(relations[i][1] for i in order if i in relations):
        yield n, -1, False, 0, None
        own, master = places(office.related(part, "slideLayout"))
        for place, (kind, number, top, text) in enumerate(shapes(office, part)):
            if kind and top is None:
                on_layout, top = own.get(number, (None, None))
                top = master.get(MASTER.get(on_layout, "body")) if on_layout and top is None else top
            if text:
                yield n, place, False, top or 0, text
        notes = office.related(part, "notesSlide")
        if notes and (text := next((text for kind, _, _, text in shapes(office, notes) if kind == "body"), "")):
            yield n, 0, True, 0, text


class _Files(_Source):
    """Whole files of one kind. More options: part_bytes, the most that a part may inflate to; listed, how many files the driver lists before it leaves folders to tasks."""

    rows, empty = None, ()

    def reader(self, schema) -> DataSourceReader:
        return OfficeReader(self.options, self.limits(), type(self).rows, self.empty)


class OfficeReader(DataSourceReader):
    def __init__(self, options, limits, rows, empty):
        self.path, self.ending, self.most, self.limits, self.rows, self.empty = options["path"], options.get("ending", ""), int(options.get("part_bytes", 500 << 20)), limits, rows, empty
        self.listed = int(options.get("listed", LISTED))

    def partitions(self):
        files, folders = planned(self.path, self.ending, self.listed)
        return splits(files, whole=True) + [Split([], folder) for folder in folders]

    def read(self, partition):
        for path in partition.files(self.ending):
            name = path.rpartition("/")[2]
            with opened(path) as file:
                try:
                    office = Office(file, self.most, **self.limits)
                    held = self._held(office)
                except Fault as e:
                    yield (name, *self.empty, str(e))
                    continue
                for row in self.rows(office) if held is None else held:
                    yield (name, *row, None)

    def _held(self, office: Office) -> list[tuple] | None:
        """The rows of a file that is read to its end; None if they are too large to be held."""
        held, size = [], 0
        for row in self.rows(office):
            size += 100 + sum(len(value) for value in row if isinstance(value, str))
            if size <= HELD:
                held.append(row)
            else:
                held.clear()
        return held if size <= HELD else None


class DocxParagraphs(_Files):
    rows, empty = staticmethod(paragraphs), (None,) * 3

    @classmethod
    def name(cls) -> str:
        return "docx_paragraphs"

    def schema(self) -> str:
        return "file string, place int, heading boolean, text string, fault string"


class PptxTexts(_Files):
    rows, empty = staticmethod(slides), (None,) * 5

    @classmethod
    def name(cls) -> str:
        return "pptx_texts"

    def schema(self) -> str:
        return "file string, slide int, place int, notes boolean, top long, text string, fault string"


def docx_paragraphs(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, place, heading, text, fault."""
    spark.dataSource.register(DocxParagraphs)
    return spark.read.format("docx_paragraphs").options(path=path, **options).load()


def pptx_texts(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, slide, place, notes, top, text, fault."""
    spark.dataSource.register(PptxTexts)
    return spark.read.format("pptx_texts").options(path=path, **options).load()


def slide_pages(texts: DataFrame) -> DataFrame:
    """file, page, text: a slide's texts from top to bottom, then its notes."""
    text = F.struct("notes", "top", "place", "text")
    rows = texts.where("fault is null").groupBy("file", F.col("slide").alias("page")).agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), text))).alias("t"))
    return rows.select("file", "page", F.array_join("t.text", "\n").alias("text"))


# Writing. What a reader of the format asks for; the look is that of a book page on A4.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = "application/vnd.openxmlformats-officedocument.wordprocessingml."
STYLES = {"Normal": "Normal", "Title": "Title", "Heading1": "heading 1"}
_LOOK = {
    "Normal": '<w:pPr><w:spacing w:after="0" w:line="276" w:lineRule="auto"/><w:ind w:firstLine="340"/><w:jc w:val="both"/></w:pPr><w:rPr><w:rFonts w:ascii="Cambria" w:hAnsi="Cambria"/><w:sz w:val="24"/><w:lang w:val="it-IT"/></w:rPr>',
    "Title": '<w:pPr><w:ind w:firstLine="0"/></w:pPr><w:rPr><w:color w:val="222222"/><w:sz w:val="48"/></w:rPr>',
    "Heading1": '<w:pPr><w:keepNext/><w:ind w:firstLine="0"/><w:outlineLvl w:val="0"/></w:pPr><w:rPr><w:b/><w:sz w:val="28"/></w:rPr>',
}
DOCX = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    + "".join(f'<Override PartName="/word/{part}.xml" ContentType="{_TYPES}{kind}+xml"/>' for part, kind in (("document", "document.main"), ("styles", "styles"), ("settings", "settings"), ("footer1", "footer")))
    + "</Types>",
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{R}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships">'
    + "".join(f'<Relationship Id="rId{i}" Type="{R}/{kind}" Target="{part}.xml"/>' for i, (kind, part) in enumerate((("styles", "styles"), ("settings", "settings"), ("footer", "footer1")), 1))
    + "</Relationships>",
    "word/settings.xml": f'{_HEAD}<w:settings xmlns:w="{W}"><w:autoHyphenation/></w:settings>',
    "word/footer1.xml": f'{_HEAD}<w:ftr xmlns:w="{W}"><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:fldSimple w:instr="PAGE"/></w:p></w:ftr>',
    "word/styles.xml": f'{_HEAD}<w:styles xmlns:w="{W}">'
    + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"{" w:default=" + chr(34) + "1" + chr(34) if i == "Normal" else ""}><w:name w:val="{name}"/>{"" if i == "Normal" else "<w:basedOn w:val=" + chr(34) + "Normal" + chr(34) + "/>"}{_LOOK[i]}</w:style>' for i, name in STYLES.items())
    + "</w:styles>",
}
_BODY = f'{_HEAD}<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>'
_BODY_END = '<w:sectPr><w:footerReference w:type="default" r:id="rId3"/><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1417" w:right="1417" w:bottom="1417" w:left="1417" w:header="708" w:footer="708" w:gutter="0"/></w:sectPr></w:body></w:document>'


def xml_text(text: Column) -> Column:
    """Text as it may stand in XML: characters that XML has no place for drop out."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def write_docx(rows: DataFrame, path: str, key: str, overwrite: bool = False, folders: int = 0) -> None:
    """rows: key (the file's name), place, style (a key of STYLES; null: Normal), text. A Word document for each key, its paragraphs in order of place.

    folders: of so many documents each, for more of them than the driver should list; else all lie in the path itself.
    """
    run = F.concat(F.lit('<w:r><w:t xml:space="preserve">'), F.regexp_replace(F.replace(xml_text(F.coalesce("text", F.lit(""))), F.lit("\t"), F.lit("</w:t><w:tab/><w:t xml:space=\"preserve\">")), "\r\n|\r|\n", '</w:t><w:br/><w:t xml:space="preserve">'), F.lit("</w:t></w:r>"))
    style = F.when(F.col("style").isin(*STYLES), F.concat(F.lit('<w:pPr><w:pStyle w:val="'), "style", F.lit('"/></w:pPr>'))).otherwise("")
    one = lambda part, member, place, content: F.struct(F.lit(part).alias("part"), F.lit(member).alias("member"), F.lit(place).cast("long").alias("place"), F.lit(content).alias("content"))
    package = F.col(key).cast("string").alias("package")
    frame = [one(i, member, 0, content) for i, (member, content) in enumerate(DOCX.items())] + [one(len(DOCX), "word/document.xml", None, _BODY), one(len(DOCX) + 2, "word/document.xml", 0, _BODY_END)]
    fixed = rows.select(package).distinct().select("package", F.inline(F.array(*frame)))
    body = rows.select(package, F.lit(len(DOCX) + 1).alias("part"), F.lit("word/document.xml").alias("member"), F.col("place").cast("long").alias("place"), F.concat(F.lit("<w:p>"), style, run, F.lit("</w:p>")).alias("content"))
    write_packages(fixed.unionByName(body).withColumn("content", F.encode("content", "utf-8")), path, ("part", "place"), overwrite, manifest=False, ending=".docx", folders=folders)

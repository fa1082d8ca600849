"""ZIP packages as Spark sources and sinks: members, office documents, packages with a manifest.

Archives are cut into splits by bytes, like other files: a member belongs to the split in which its header begins. Each split reads the directory at the
archive's end and then its own members, so no archive is ever one value, and none goes through the driver, which only lists files. Members are
inflated in chunks with a limit, whatever size they claim.

Paths are those that pyarrow's file systems read (local, s3, gs, hdfs).
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CHUNK = 64 << 10
#: What a member, an archive's declared sizes and its directory may come to.
MEMBER_BYTES, ARCHIVE_BYTES, ENTRIES = 64 << 20, 500 << 20, 10_000
SPLIT_BYTES, FILE_BYTES = 64 << 20, 1 << 20
#: For packages of our own, of any size: no limit.
UNLIMITED = 1 << 62
#: Splits of an archive: each reads its directory, which would take longer with the square of the archive's size were they more for a larger one.
ARCHIVE_SPLITS = 32
MANIFEST = "manifest.json"
#: Files that the driver lists; folders in which more lie are listed by tasks. Packages in a folder, where there are too many for one.
LISTED, FOLDER = 20_000, 1000


class Fault(Exception):
    """What is wrong with an archive or a member."""


def file_system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if ":" not in path.split("/", 1)[0]:
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str, ending: str = "") -> list[tuple[str, int]]:
    """Files in a folder (at any depth; hidden ones aside) or the one file, with their sizes, in order."""
    from pyarrow import fs

    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file]
    inside = lambda f: f.path[len(at) :].strip("/").split("/")
    return sorted((f.path, f.size) for f in found if f.path.endswith(ending) and not any(x.startswith((".", "_")) for x in inside(f)))


def planned(path: str, ending: str = "", most: int = LISTED) -> tuple[list[tuple[str, int]], list[str]]:
    """Files as listed() has them, and folders that have not been listed: those after the first `most` files."""
    from pyarrow import fs

    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.Directory:
        return listed(path, ending), []
    inside = [f for f in system.get_file_info(fs.FileSelector(at)) if not f.base_name.startswith((".", "_"))]
    files, later = [(f.path, f.size) for f in inside if f.is_file and f.path.endswith(ending)], []
    for name in sorted(f.base_name for f in inside if not f.is_file):
        folder = f"{path.rstrip('/')}/{name}"
        if len(files) < most:
            files += listed(folder, ending)
        else:
            later.append(folder)
    return sorted(files), later


@dataclass
class Split(InputPartition):
    """(file, its first byte, the byte after its last) of several files or parts of one, or a folder of whole files."""

    ranges: list[tuple[str, int, int]]
    folder: str | None = None

    def files(self, ending: str = "") -> list[str]:
        """Its files, for readers that take them whole."""
        return [path for path, *_ in (self.ranges if self.folder is None else listed(self.folder, ending))]


def splits(files: list[tuple[str, int]], target: int = SPLIT_BYTES, whole: bool = False) -> list[Split]:
    """Parts of about `target` bytes; with whole, files aren't cut."""
    out: list[Split] = []
    room = 0
    for path, size in files:
        n = 1 if whole else max(1, -(-size // target))
        for i in range(n):
            part = (path, size * i // n, size * (i + 1) // n if i + 1 < n else size + 1)
            cost = max(part[2] - part[1], FILE_BYTES)
            if cost > room:
                out.append(Split([]))
                room = target
            out[-1].ranges.append(part)
            room -= cost
    return out


class Archive:
    """A ZIP file that can be sought in; nothing that it says about sizes is believed.

    Raises Fault for what isn't a ZIP file, or has too many or (as declared) too large entries.
    """

    LOCAL = struct.Struct("<4sHHHHHIIIHH")

    def __init__(self, file, entries: int = ENTRIES, archive_bytes: int = ARCHIVE_BYTES):
        self.file = file
        try:
            directory = zipfile.ZipFile(file)
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, struct.error) as e:
            raise Fault("unreadable") from e
        self.members = directory.infolist()
        if len(self.members) > entries:
            raise Fault("too many entries")
        if sum(m.file_size for m in self.members) > archive_bytes:
            raise Fault("too large")
        starts = sorted({m.header_offset for m in self.members} | {directory.start_dir})
        self.ends = dict(zip(starts, starts[1:], strict=False))
        self.by_name = {m.filename: m for m in self.members}

    def chunks(self, member: zipfile.ZipInfo, most: int = MEMBER_BYTES) -> Iterator[bytes]:
        """The member's bytes, at most `most` of them. Raises Fault for damaged, encrypted and overlapping members, and if there are more bytes."""
        if member.flag_bits & 0x1:
            raise Fault("encrypted")
        if member.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise Fault("method")
        self.file.seek(member.header_offset)
        head = self.file.read(self.LOCAL.size)
        if len(head) < self.LOCAL.size or head[:4] != b"PK\x03\x04":
            raise Fault("header")
        _, _, flags, method, *_, name, extra = self.LOCAL.unpack(head)
        if flags != member.flag_bits or method != member.compress_type:
            raise Fault("header")
        at = member.header_offset + self.LOCAL.size + name + extra
        if at + member.compress_size > self.ends.get(member.header_offset, 0):
            raise Fault("overlap")
        crc = total = 0
        for data in self._inflated(at, member.compress_size, method):
            total += len(data)
            if total > most:
                raise Fault("too large")
            crc = zlib.crc32(data, crc)
            yield data
        if crc != member.CRC:
            raise Fault("checksum")

    def _raw(self, at: int, size: int) -> Iterator[bytes]:
        while size:
            self.file.seek(at)
            data = self.file.read(min(CHUNK, size))
            if not data:
                raise Fault("truncated")
            at, size = at + len(data), size - len(data)
            yield data

    def _inflated(self, at: int, size: int, method: int) -> Iterator[bytes]:
        if method == zipfile.ZIP_STORED:
            yield from self._raw(at, size)
            return
        stream = zlib.decompressobj(-15)
        try:
            for data in self._raw(at, size):
                if stream.eof:
                    raise Fault("trailing bytes")
                while not stream.eof and (data or stream.unconsumed_tail):
                    yield stream.decompress(data or stream.unconsumed_tail, CHUNK)
                    data = b""
            while rest := stream.decompress(stream.unconsumed_tail, CHUNK):
                yield rest
        except zlib.error as e:
            raise Fault("damaged") from e
        if not stream.eof:
            raise Fault("truncated")
        if stream.unused_data:
            raise Fault("trailing bytes")


class _Bytes(io.RawIOBase):
    """One of pyarrow's files, as Python's own are: seeking to before its start is an OSError."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, offset, whence=0):
        at = offset + (0, self.at, self.file.size())[whence]
        if at < 0:
            raise OSError("before the start")
        self.at = at
        return at

    def tell(self):
        return self.at

    def readinto(self, into):
        data = self.file.read_at(len(into), self.at) if self.at < self.file.size() else b""
        into[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self):
        self.file.close()
        super().close()


def opened(path: str) -> io.BufferedReader:
    system, at = file_system(path)
    return io.BufferedReader(_Bytes(system.open_input_file(at)), CHUNK)


class _Source(DataSource):
    """Options: path; ending of the files' names; limits of a member, an archive's entries and its declared bytes; split_bytes."""

    def limits(self) -> dict[str, int]:
        return {"entries": int(self.options.get("entries", ENTRIES)), "archive_bytes": int(self.options.get("archive_bytes", ARCHIVE_BYTES))}


class ZipMembers(_Source):
    """A row for each member: archive, member, place in the directory, size, sha256, content; or with a fault, and no content. An archive that can't be read
    is one row without a member."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, place int, size long, sha256 string, content binary, fault string"

    def reader(self, schema) -> DataSourceReader:
        return ZipMembersReader(self.options, self.limits())


class ZipMembersReader(DataSourceReader):
    def __init__(self, options, limits):
        self.path, self.ending = options["path"], options.get("ending", "")
        self.most, self.split, self.limits = int(options.get("member_bytes", MEMBER_BYTES)), int(options.get("split_bytes", SPLIT_BYTES)), limits

    def partitions(self):
        files = listed(self.path, self.ending)
        return splits(files, max(self.split, -(-max((size for _, size in files), default=0) // ARCHIVE_SPLITS)))

    def read(self, partition):
        for path, begin, end in partition.ranges:
            name = path.rpartition("/")[2]
            with opened(path) as file:
                try:
                    archive = Archive(file, **self.limits)
                except Fault as e:
                    if begin == 0:
                        yield name, None, None, None, None, None, str(e)
                    continue
                for place, m in enumerate(archive.members):
                    if begin <= m.header_offset < end and not m.is_dir():
                        yield self._row(archive, name, place, m)

    def _row(self, archive, name, place, m):
        held, digest = [], hashlib.sha256()
        try:
            for data in archive.chunks(m, self.most):
                held.append(data)
                digest.update(data)
        except Fault as e:
            return name, m.filename, place, None, None, None, str(e)
        content = b"".join(held)
        return name, m.filename, place, len(content), digest.hexdigest(), content, None


class ZipDirectories(_Source):
    """A row for each archive, by its directory alone: archive, entries, bytes that it declares, kind (docx, pptx or null, by its content types), fault."""

    @classmethod
    def name(cls) -> str:
        return "zip_directories"

    def schema(self) -> str:
        return "archive string, entries long, bytes long, kind string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return ZipDirectoriesReader(self.options, self.limits())


class ZipDirectoriesReader(DataSourceReader):
    #: What an office document's content types hold.
    KINDS = ((b"wordprocessingml", "docx"), (b"presentationml", "pptx"))

    def __init__(self, options, limits):
        self.path, self.ending, self.limits = options["path"], options.get("ending", ""), limits

    def partitions(self):
        return splits([(path, FILE_BYTES) for path, _ in listed(self.path, self.ending)], whole=True)

    def read(self, partition):
        for path, *_ in partition.ranges:
            with opened(path) as file:
                yield (path.rpartition("/")[2], *self._row(file))

    def _row(self, file):
        try:
            archive = Archive(file, UNLIMITED, UNLIMITED)
        except Fault as e:
            return None, None, None, str(e)
        entries, size = len(archive.members), sum(m.file_size for m in archive.members)
        fault = "too many entries" if entries > self.limits["entries"] else "too large" if size > self.limits["archive_bytes"] else None
        return entries, size, None if fault else self._kind(archive), fault

    def _kind(self, archive):
        kind, before = None, b""
        try:
            for data in archive.chunks(archive.by_name["[Content_Types].xml"]):
                kind = next((k for sign, k in reversed(self.KINDS) if sign in before + data), kind)
                before = data[-32:]
        except (KeyError, Fault):
            return None
        return kind


class PackageWriter(DataSourceWriter):
    """Rows (package, member, content), all of a package in one task and those of a member in a row, as ZIP files; a member's rows are its pieces.

    Tasks write beside the target. Once all have ended the packages are moved into place; if any fails, none is there. With manifest, each package
    ends in a list of its members with sizes and hashes: whoever sees a package sees both.

    With folders, a task puts each so many packages into a folder of their own, and only folders go through the driver. The target has to be empty then, and that a package
    comes from one task isn't checked (write_packages sees to it).
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.manifest, self.ending, self.overwrite = options["path"].rstrip("/"), options.get("manifest", "true") == "true", options.get("ending", ".zip"), overwrite
        self.folders = int(options.get("folders", 0))
        if self.folders and overwrite:
            raise ValueError("packages in folders can't be overwritten one by one")
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, staging = file_system(self.staging)
        system.create_dir(staging)
        made, now, archive, part, closing = [], None, None, None, []
        folders, count, own = [], 0, uuid.uuid4().hex
        inventory, entry = [], None

        def end_member():
            nonlocal entry, part
            if part is not None:
                part.close()
                inventory.append({"path": entry[0], "size": entry[1], "sha256": entry[2].hexdigest()})
                entry = part = None

        def end_package():
            nonlocal archive, inventory
            if archive is None:
                return
            end_member()
            if self.manifest:
                archive.writestr(zipfile.ZipInfo(MANIFEST), json.dumps({"format_version": 1, "inventory": inventory}), zipfile.ZIP_DEFLATED)
            archive.close()
            closing.pop().close()
            archive, inventory = None, []

        try:
            for package, member, content in iterator:
                if package != now:
                    end_package()
                    named(package)
                    if self.folders:
                        if count % self.folders == 0:
                            folders.append(f"{own}-{len(folders)}")
                            system.create_dir(f"{staging}/{folders[-1]}")
                        now, at, count = package, f"{staging}/{folders[-1]}/{package}{self.ending}", count + 1
                    else:
                        now, at = package, f"{staging}/{uuid.uuid4().hex}"
                        made.append((package, at))
                    closing.append(system.open_output_stream(at))
                    archive = zipfile.ZipFile(closing[-1], "w", zipfile.ZIP_DEFLATED)
                if entry is None or member != entry[0]:
                    end_member()
                    named(member)
                    if member == MANIFEST and self.manifest or any(member == e["path"] for e in inventory[-1:]):
                        raise ValueError(f"{member} is there already in {package}")
                    info = zipfile.ZipInfo(member)
                    info.compress_type = zipfile.ZIP_DEFLATED
                    part, entry = archive.open(info, "w", force_zip64=True), [member, 0, hashlib.sha256()]
                if content:
                    part.write(content)
                    entry[1] += len(content)
                    entry[2].update(content)
            end_package()
        finally:
            for stream in closing:
                stream.close()
        return Packages([(f"{package}{self.ending}", at) for package, at in made], folders)

    def commit(self, messages):
        from pyarrow import fs

        files = [f for m in messages if m for f in m.files]
        system, target = file_system(self.path)
        if self.folders:
            return self._commit_folders(system, target, [f for m in messages if m for f in m.folders])
        moved = []
        try:
            names = [n for n, _ in files]
            if len(set(names)) < len(names):
                raise ValueError("a package came from several tasks")
            if not self.overwrite and (there := [n for n in names if system.get_file_info(f"{target}/{n}").type != fs.FileType.NotFound]):
                raise FileExistsError(there[0])
            system.create_dir(target)
            for name, at in files:
                system.move(at, f"{target}/{name}")
                moved.append(f"{target}/{name}")
        except Exception:
            for path in moved:
                system.delete_file(path)
            raise
        finally:
            self._clear()
        with system.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def _commit_folders(self, system, target, folders):
        from pyarrow import fs

        staging, moved = file_system(self.staging)[1], []
        system.create_dir(target)
        try:
            if there := [f.base_name for f in system.get_file_info(fs.FileSelector(target)) if not f.base_name.startswith(".")]:
                raise FileExistsError(there[0])
            for name in folders:
                moved.append(f"{target}/{name}")
                if system.type_name in ("local", "hdfs"):
                    system.move(f"{staging}/{name}", moved[-1])
                else:  # object stores move files
                    system.create_dir(moved[-1])
                    for f in system.get_file_info(fs.FileSelector(f"{staging}/{name}")):
                        system.move(f.path, f"{moved[-1]}/{f.base_name}")
        except Exception:
            for path in moved:
                if system.get_file_info(path).type != fs.FileType.NotFound:
                    system.delete_dir(path)
            raise
        finally:
            self._clear()
        with system.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def abort(self, messages):
        self._clear()

    def _clear(self):
        from pyarrow import fs

        system, staging = file_system(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


@dataclass
class Packages(WriterCommitMessage):
    """(name, staged file) of what a task wrote, or its folders."""

    files: list[tuple[str, str]]
    folders: list[str]


def named(path: str | None) -> None:
    if not path or path.startswith("/") or "\\" in path or ".." in path.split("/"):
        raise ValueError(f"not a name inside a package: {path!r}")


class ZipPackages(DataSource):
    """Options: path, manifest (true), ending of the packages' names (.zip), folders: packages in a folder (0: all lie in the path itself)."""

    @classmethod
    def name(cls) -> str:
        return "zip_packages"

    def schema(self) -> str:
        return "package string, member string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema] != ["package", "member", "content"]:
            raise ValueError("rows must be package, member, content")
        return PackageWriter(self.options, overwrite)


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    """archive, member, place, size, sha256, content, fault of the archives in a folder."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(path=path, **options).load()


def directories(spark: SparkSession, path: str, **options) -> DataFrame:
    """archive, entries, bytes, kind, fault of the archives in a folder, without reading more than their directories."""
    spark.dataSource.register(ZipDirectories)
    return spark.read.format("zip_directories").options(path=path, **options).load()


def write_packages(rows: DataFrame, path: str, order: tuple[str, ...] = ("member",), overwrite: bool = False, **options) -> None:
    """rows: package, member, content, and the columns of order, by which a package's rows are written; a member's rows have to be in a row then.

    A package is one file, so one task writes it, in a stream.
    """
    rows.sparkSession.dataSource.register(ZipPackages)
    rows = rows.repartition("package").sortWithinPartitions("package", *order).select("package", "member", "content")
    rows.write.format("zip_packages").mode("overwrite" if overwrite else "append").options(path=path, **{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).save()


def manifest_faults(found: DataFrame) -> DataFrame:
    """archive, member, fault: what a package's manifest and its members don't agree on. found: rows of members()."""
    inventory = F.from_json(F.col("content").cast("string"), "format_version int, inventory array<struct<path:string,size:long,sha256:string>>")
    told = found.where((F.col("member") == MANIFEST) & F.col("fault").isNull()).select("archive", inventory.alias("m"))
    told = told.select("archive", F.explode(F.coalesce("m.inventory", F.array())).alias("t")).select("archive", F.col("t.path").alias("member"), F.col("t.size").alias("told_size"), F.col("t.sha256").alias("told"))
    there = found.where(F.coalesce(F.col("member") != MANIFEST, F.lit(True))).select("archive", "member", "size", "sha256", "fault")
    rows = there.join(told, ["archive", "member"], "full")
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("sha256").isNull(), "missing").when(F.col("told").isNull(), "extra")
        .when(F.col("size") != F.col("told_size"), "size").when(F.col("sha256") != F.col("told"), "hash")
    )
    return rows.select("archive", "member", fault.alias("fault")).where("fault is not null")

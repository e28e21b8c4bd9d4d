"""Expand archive blobs to entry rows, and pack rows to archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.schemas import ARCHIVE_ENTRY
from packsift.settings import MIB, ArchiveLimits

_ARROW_ENTRY = pa.schema(
    [
        ("archive", pa.string()),
        ("entry_no", pa.int64()),
        ("path", pa.string()),
        ("method", pa.string()),
        ("size", pa.int64()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
_METHODS = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflated"}
_ZIP64_ENTRIES = 0xFFFF


class Rejected(Exception):
    """An archive that breaks a limit; the text is a code and what it is about."""


class Admission:
    """Checks members one after the other; both formats go through it."""

    def __init__(self, limits: ArchiveLimits):
        self.limits = limits
        self.members = self.expanded = 0

    def admit(self, name: str, size: int, supported: bool = True) -> None:
        self.members += 1
        self.expanded += size
        broken = {
            "unsafe-name": name.startswith("/") or ".." in name.split("/"),
            "method-not-read": not supported,
            "too-many-entries": self.members > self.limits.entries,
            "entry-too-large": size > self.limits.scan_size,
            "expands-too-far": self.expanded > self.limits.expanded_size,
        }
        for code, is_broken in broken.items():
            if is_broken:
                raise Rejected(f"{code}: {name}")


def _zip_entries(blob: bytes, limits: ArchiveLimits) -> Iterator[tuple[str, str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(blob)) as archive:
        infos = archive.infolist()
        if len(infos) >= _ZIP64_ENTRIES:
            raise Rejected("zip64: too many members for the plain format")
        admission, names = Admission(limits), set()
        for info in infos:  # the directory alone decides; nothing is inflated yet
            admission.admit(info.filename, info.file_size, info.compress_type in _METHODS)
            if info.filename in names:
                raise Rejected(f"repeated-name: {info.filename}")
            names.add(info.filename)
        for info in infos:
            if not info.is_dir():
                yield info.filename, _METHODS[info.compress_type], archive.read(info)


def _tar_entries(blob: bytes, limits: ArchiveLimits) -> Iterator[tuple[str, str, bytes]]:
    """Unpacking to a folder, a later member of one name replaces an earlier one."""
    found: dict[str, bytes] = {}
    with tarfile.open(fileobj=io.BytesIO(blob), mode="r|gz") as archive:
        admission = Admission(limits)
        for member in archive:
            admission.admit(member.name, member.size)
            if member.isfile():
                found.pop(member.name, None)
                found[member.name] = archive.extractfile(member).read()
    for name, content in found.items():
        yield name, "deflated", content


def _archive_rows(archive: str, blob: bytes | None, fmt: str, limits: ArchiveLimits) -> list[dict]:
    """All entries of one archive, or a single error row; never a partial result.

    Whatever a decoder raises on damaged or encrypted input is that archive's error.
    """
    empty = {"archive": archive, "entry_no": None, "path": None, "method": None, "size": None, "content": None}
    if blob is None:
        return [{**empty, "error": "blob-missing: no content"}]
    if len(blob) > limits.download_size:
        return [{**empty, "error": f"blob-too-large: more than {limits.download_size} bytes"}]
    read = _tar_entries if fmt == "tar.gz" else _zip_entries
    try:
        return [
            {
                "archive": archive,
                "entry_no": number,
                "path": name,
                "method": method,
                "size": len(content),
                "content": content,
                "error": None,
            }
            for number, (name, method, content) in enumerate(read(blob, limits))
        ]
    except Rejected as refusal:
        return [{**empty, "error": str(refusal)}]
    except MemoryError:
        raise
    except Exception as error:
        return [{**empty, "error": f"not-readable: {type(error).__name__}: {error}"}]


def expand_archives(archives: DataFrame, limits: ArchiveLimits | None = None) -> DataFrame:
    """Entry rows of archives (archive, content, format).

    One archive is one input row, and its limits bound what a task holds.
    """
    limits = limits or ArchiveLimits()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            for archive, blob, fmt in zip(columns["archive"], columns["content"], columns["format"]):
                rows = _archive_rows(archive, blob, fmt, limits)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_ENTRY)

    return archives.select("archive", "content", "format").mapInArrow(expand, ARCHIVE_ENTRY)


def package_files(
    fetched: DataFrame, limits: ArchiveLimits | None = None
) -> tuple[DataFrame, DataFrame]:
    """Files and failures of fetched distributions (pkg, dist_index, content,
    format, error).

    Returns file rows (pkg, dist_index, path, content) and failure rows
    (pkg, dist_index, reason).
    """
    label = F.concat_ws("#", F.col("dist_index").cast("string"), "pkg")
    entries = expand_archives(
        fetched.where("error IS NULL").select(label.alias("archive"), "content", "format"), limits
    )
    index = F.substring_index("archive", "#", 1)
    keyed = entries.withColumns(
        {
            "dist_index": index.cast("int"),
            "pkg": F.substring(F.col("archive"), F.char_length(index) + 2, F.char_length("archive")),
        }
    )
    files = keyed.where("error IS NULL").select("pkg", "dist_index", "path", "content")
    failures = keyed.where("error IS NOT NULL").select("pkg", "dist_index", F.col("error").alias("reason"))
    refused = fetched.where("error IS NOT NULL").select("pkg", "dist_index", F.col("error").alias("reason"))
    return files, failures.unionByName(refused)


def _build(fmt: str, files: list[tuple[str, bytes]]) -> bytes:
    buffer = io.BytesIO()
    if fmt == "tar.gz":
        with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as archive:
            for name, content in files:
                info = tarfile.TarInfo(name)
                info.size = len(content)
                archive.addfile(info, io.BytesIO(content))
    else:
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
            for name, content in files:
                archive.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def pack_archives(
    files: DataFrame, max_entries: int = 256, max_bytes: int = 4 * MIB
) -> DataFrame:
    """Pack rows (format, path, content) to archives without moving them.

    Each task closes an archive when it holds ``max_entries`` files or would
    pass ``max_bytes``, so no group is ever gathered.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: dict[str, list[tuple[str, bytes]]] = {}
        open_bytes: dict[str, int] = {}

        def close(fmt: str) -> pa.RecordBatch:
            content = _build(fmt, open_files.pop(fmt))
            open_bytes.pop(fmt)
            return pa.RecordBatch.from_pylist(
                [{"archive": None, "content": content, "format": fmt}],
                schema=pa.schema([("archive", pa.string()), ("content", pa.binary()), ("format", pa.string())]),
            )

        for batch in batches:
            columns = batch.to_pydict()
            for fmt, path, content in zip(columns["format"], columns["path"], columns["content"]):
                full = len(open_files.get(fmt, ())) >= max_entries
                if full or (fmt in open_files and open_bytes[fmt] + len(content) > max_bytes):
                    yield close(fmt)
                open_files.setdefault(fmt, []).append((path, content))
                open_bytes[fmt] = open_bytes.get(fmt, 0) + len(content)
        for fmt in list(open_files):
            yield close(fmt)

    return files.select("format", "path", "content").mapInArrow(
        pack, "archive string, content binary, format string"
    )

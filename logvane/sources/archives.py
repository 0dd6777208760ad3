"""Zip archives of line files, read member by member from where they lie."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a batch of lines ends at either bound
LINES_PER_BATCH, CHARS_PER_BATCH = 20_000, 8 << 20
#: compressed bytes that a task reads, unless one member is larger
BYTES_PER_TASK = 64 << 20
MEMBER_SCHEMA = "path string, member string, packed_bytes long, bytes long, error string"
LINE_SCHEMA = "path string, member string, number long, line string, error string"
_FAULTS = (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path on it."""
    if re.match(r"file:/|/", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^(file:)?/+", "", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


class _Raw(io.RawIOBase):
    """An Arrow file for ``zipfile``, which expects an ``OSError`` where a seek leads before the beginning."""

    def __init__(self, path: str) -> None:
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        target = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.size}[whence]
        if target < 0:
            raise OSError("before the beginning of the file")
        return self.file.seek(target)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        found = self.file.read(len(buffer))
        buffer[: len(found)] = found
        return len(found)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_archive(path: str) -> io.BufferedReader:
    return io.BufferedReader(_Raw(path), 1 << 16)


def _fault(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def list_members(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """``path, member, packed_bytes, bytes, error`` for every file in every archive at any depth below ``root``.

    Tasks read the archives' directories only, never their contents. An archive that is none, is cut off or cannot be
    opened is one row with its error and no member; so is an encrypted member, with its name. Spark's file scans pass
    over files of zero bytes, so those are not listed.
    """

    def read(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    with open_archive(path) as raw, zipfile.ZipFile(raw) as archive:
                        rows += [
                            (path, entry.filename, entry.compress_size, entry.file_size, "encrypted" if entry.flag_bits & 1 else None)
                            for entry in archive.infolist() if not entry.is_dir()
                        ]
                except _FAULTS as error:
                    rows.append((path, None, None, None, _fault(error)))
            names = ["path", "member", "packed_bytes", "bytes", "error"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    )
    # opening files is waiting, so the paths are dealt out evenly whatever their sizes
    return found.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read, MEMBER_SCHEMA)


def read_members(members: DataFrame, suffix: str = ".json") -> DataFrame:
    """``path, member, number, line, error``: the lines, numbered from 0, of the listed members with the given suffix.

    Members are dealt out by their compressed bytes, so one large archive is read by several tasks; each opens the
    archive, goes to its member and streams it, holding one batch of lines. A member is deflated as one stream and so
    is one task's work. Bytes that are no text are replaced. Listed errors are passed on, and a member that turns out to
    be damaged gives the lines before the damage and a row with the error: ``error is null`` are the lines, the rest is
    to be quarantined. An empty member has no rows.
    """
    wanted = members.filter(F.col("error").isNotNull() | F.col("member").endswith(suffix))
    total = wanted.agg(F.sum("packed_bytes").alias("n")).first()["n"] or 0
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-total // BYTES_PER_TASK))
    return wanted.repartition(tasks, "path", "member").select("path", "member", "error").mapInArrow(_lines_of, LINE_SCHEMA)


def _lines_of(batches):
    for batch in batches:
        for row in batch.to_pylist():
            if row["error"] is not None:
                yield _batch(row, 0, [None], row["error"])
                continue
            first, held, chars = 0, [], 0
            try:
                with open_archive(row["path"]) as raw, zipfile.ZipFile(raw) as archive, archive.open(row["member"]) as packed:
                    for line in io.TextIOWrapper(packed, encoding="utf-8", errors="replace", newline="\n"):
                        held.append(line.removesuffix("\n"))
                        chars += len(line)
                        if len(held) >= LINES_PER_BATCH or chars >= CHARS_PER_BATCH:
                            yield _batch(row, first, held, None)
                            first, held, chars = first + len(held), [], 0
                fault = None
            except (*_FAULTS, KeyError) as error:
                fault = _fault(error)
            if held:
                yield _batch(row, first, held, None)
            if fault:
                yield _batch(row, first + len(held), [None], fault)


def _batch(row: dict, first: int, lines: list, error: str | None) -> pa.RecordBatch:
    n = len(lines)
    columns = [
        pa.array([row["path"]] * n, pa.string()), pa.array([row["member"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
        pa.array(lines, pa.string()), pa.array([error] * n, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["path", "member", "number", "line", "error"])


def read_archives(spark: SparkSession, root: str, pattern: str = "*.zip", suffix: str = ".json") -> DataFrame:
    """The lines of all members with the suffix in all archives, and the faults: see ``read_members``."""
    return read_members(list_members(spark, root, pattern), suffix)

"""Large files in blocks: a data source that plans byte ranges of plain files and streams compressed files and archives.

Rows are (path, start, text): a block of whole lines, and the byte of the
(decompressed) file at which it begins. A task holds one block at a time,
whatever the size of the file; a single line is never cut, so a block is as long
as its longest line demands. Values that are written over several lines are not
seen whole where a block ends inside them.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import posixpath
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BufferedReader
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import basename
from .files import ARCHIVE, DEPTH, DROPPED, safe_member

OPEN = {".gz": gzip.open, ".xz": lzma.open, ".bz2": bz2.open}
BROKEN = (tarfile.TarError, EOFError, OSError, lzma.LZMAError, zlib.error)
SCHEMA = "path string, start long, text string"
ROWS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("text", pa.string())])
#: Bytes of a block; bytes of files, or of a range of one, that a task reads.
BLOCK, TASK = 8 << 20, 128 << 20


def cut(stream: BinaryIO, block: int, at: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of blocks of whole lines, from ``at`` on, of the lines that begin before ``end``."""
    while end is None or at < end:
        data = stream.read(block if end is None else min(block, end - at))
        if not data:
            return
        if not data.endswith(b"\n"):
            data += stream.readline()
        yield at, data
        at += len(data)


def first_line(stream: BinaryIO, start: int, end: int) -> int:
    """Where the first line begins that begins in ``start`` to ``end``; the stream is left there. ``end`` or more if there is none."""
    if start == 0:
        return 0
    stream.seek(start - 1)
    at = start - 1
    while at < end:
        data = stream.readline(1 << 20)
        at += len(data)
        if not data or data.endswith(b"\n"):
            return at if data else end
    return at


def listing(stream: BinaryIO, depth: int = DEPTH) -> list[tuple[str, list | None]] | None:
    """(path, listing of what is inside, where it is an archive) of an archive's regular files, in order; None if it can't be read."""
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            return [(p, listing(tar.extractfile(m), depth - 1) if depth > 0 and ARCHIVE.search(p) else [])
                    for m in tar if m.isfile() and (p := safe_member(m.name))]
    except BROKEN:
        return None


def unpacked(stream: BinaryIO, names: list[tuple[str, list | None]], block: int, depth: int = DEPTH) -> Iterator[tuple[str, int, bytes | None]]:
    """(path, start, bytes) of the blocks of an archive's files, by its listing.

    A single folder around all files goes; nested archives become folders
    beside them, with a number where that name is taken.
    """
    tops = {p.split("/", 1)[0] for p, _ in names}
    strip = len(tops) == 1 and all("/" in p for p, _ in names)
    paths = [p.split("/", 1)[1] if strip else p for p, _ in names]
    taken = set(paths)
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        regular = (m for m in tar if m.isfile() and safe_member(m.name))
        for path, (_, inside), member in zip(paths, names, regular):
            if not (depth > 0 and ARCHIVE.search(path)):
                yield from ((path, at, data) for at, data in contents(path, tar.extractfile(member), block))
            elif inside is None:
                yield path, 0, None
            else:
                plain = folder = ARCHIVE.sub("", path)
                k = 0
                while any(t == folder or t.startswith(f"{folder}/") for t in taken if t != path):
                    k += 1
                    folder = f"{plain}_{k}"
                taken.add(folder)
                for p, at, data in unpacked(tar.extractfile(member), inside, block, depth - 1):
                    yield f"{folder}/{p}", at, data


def contents(path: str, stream: BinaryIO, block: int) -> Iterator[tuple[int, bytes | None]]:
    """The blocks of one file, decompressed by its name; one empty block of an empty file. Where it breaks off, a null one ends it."""
    end = posixpath.splitext(path)[1].lower()
    at = 0
    try:
        source = OPEN[end](stream) if end in OPEN and not ARCHIVE.search(path) else stream
        for at, data in cut(source, block):
            yield at, data
            at += len(data)
        if at == 0:
            yield 0, b""
    except BROKEN:
        yield at, None


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path, start, end) of plain files; an archive or a compressed file is one range."""

    parts: list[tuple[str, int, int]]


class BlockReader(DataSourceReader):
    def __init__(self, paths: list[str], block: int, task: int):
        self.paths, self.block, self.task = paths, block, task

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        parts, size = [], 0
        for path, length in sorted(found for p in self.paths for found in files_below(p)):
            whole = ARCHIVE.search(path) or posixpath.splitext(path)[1].lower() in OPEN
            step = max(1, length) if whole else self.task
            for start in range(0, max(1, length), step):
                end = min(length, start + step)
                if parts and size + end - start > self.task:
                    out.append(Ranges(parts))
                    parts, size = [], 0
                parts.append((path, start, end))
                size += end - start
        return [*out, Ranges(parts)] if parts else out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, start, end in partition.parts:
            for name, at, data in self.blocks(path, start, end):
                rows.append((name, at, None if data is None else data.decode("utf-8", "ignore")))
                size += len(data or b"")
                if size >= self.block or len(rows) >= 1024:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    def blocks(self, path: str, start: int, end: int) -> Iterator[tuple[str, int, bytes | None]]:
        filesystem, inner = located(path)
        opened = lambda: BufferedReader(filesystem.open_input_file(inner))
        if ARCHIVE.search(path):
            with opened() as stream:
                names = listing(stream)
            if names is None:
                yield path, start, None
                return
            with opened() as stream:
                for name, at, data in unpacked(stream, names, self.block):
                    yield f"{ARCHIVE.sub('', path)}/{name}", at, data
        elif end == 0 or posixpath.splitext(path)[1].lower() in OPEN:
            with opened() as stream:
                yield from ((path, at, data) for at, data in contents(path, stream, self.block))
        else:
            with opened() as stream:
                at = first_line(stream, start, end)
                yield from ((path, *found) for found in cut(stream, self.block, at, end))


class BlockSource(DataSource):
    """Options: paths, separated by line ends; block, task: bytes."""

    @classmethod
    def name(cls) -> str:
        return "lethe_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        o = self.options
        return BlockReader(o["paths"].split("\n"), int(o.get("block", BLOCK)), int(o.get("task", TASK)))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and "://" not in path else path)
    return pa.fs.LocalFileSystem(), posixpath.abspath(path)


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder, with the scheme that was given."""
    filesystem, inner = located(path)
    info = filesystem.get_file_info(inner)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else filesystem.get_file_info(pa.fs.FileSelector(inner, recursive=True))
    head = path[:path.index(inner)] if inner in path else ""
    return [(head + f.path, f.size) for f in found if f.is_file]


def read(spark: SparkSession, *paths: str, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """files(path, start, text) of any mix of folders, files and archives, in blocks of whole lines.

    The blocks of a path, joined by ``start``, are the text that
    ``files.read_all`` gives. A file or an archive that can't be opened has one
    null text; a compressed file that breaks off ends with one.
    """
    spark.dataSource.register(BlockSource)
    out = spark.read.format("lethe_blocks").options(paths="\n".join(paths), block=block, task=task).load()
    return out.filter(~basename(F.col("path")).rlike(DROPPED))

"""Readers: folders, single and compressed files, archives and archives inside them, tables, keywords.

All give files(path, text): one row for each file, invalid UTF-8 bytes dropped.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename

ARCHIVE = re.compile(r"\.(?:txz|tgz|tbz|tbz2|tar\.(?:xz|gz|bz2)|tar)$", re.IGNORECASE)
OPENERS = {".gz": gzip.decompress, ".xz": lzma.decompress, ".bz2": bz2.decompress}
#: Binary statistics and object files, which are dropped.
DROPPED = r"^sa\d{8}(\.xz)?$|\.obj$"
#: Levels of archives inside archives.
DEPTH = 5


def safe_member(name: str) -> str | None:
    """A member's path inside its archive; None if it would lead out of it."""
    name = posixpath.normpath(name)
    return None if name.startswith(("/", "../")) or name in ("..", ".") else name


def members(name: str, data: bytes, depth: int = DEPTH) -> Iterator[tuple[str, bytes | None]]:
    """(path, content) of an archive's regular files; ("", None) if it can't be opened. Links are skipped; nested archives become folders beside them."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            found = [(p, tar.extractfile(m).read()) for m in tar if m.isfile() and (p := safe_member(m.name))]
    except (tarfile.TarError, EOFError, OSError, lzma.LZMAError):
        yield "", None
        return
    tops = {p.split("/", 1)[0] for p, _ in found}
    if len(tops) == 1 and all("/" in p for p, _ in found):  # one wrapper folder that holds every file
        found = [(p.split("/", 1)[1], d) for p, d in found]
    taken = {p for p, _ in found}
    for p, d in found:
        if ARCHIVE.search(p) and depth > 0:
            folder, k = ARCHIVE.sub("", p), 0
            while any(t == folder or t.startswith(f"{folder}/") for t in taken if t != p):
                k += 1
                folder = f"{ARCHIVE.sub('', p)}_{k}"
            taken.add(folder)
            for q, e in members(p, d, depth - 1):
                yield f"{folder}/{q}" if q else p, e
        else:
            yield p, d


def decoded(path: str, data: bytes | None) -> str | None:
    """The text of a file, decompressed by its name; None where it can't be."""
    if data is None:
        return None
    end = posixpath.splitext(path)[1].lower()
    if end in OPENERS and not ARCHIVE.search(path):
        try:
            data = OPENERS[end](data)
        except (OSError, EOFError, lzma.LZMAError):
            return None
    return data.decode("utf-8", "ignore")


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """read_all() without what can't be opened."""
    return read_all(spark, *paths).filter(F.col("text").isNotNull())


def read_all(spark: SparkSession, *paths: str) -> DataFrame:
    """files(path, text) of any mix of folders, files and archives. Paths of members follow their archive's.

    The text is null where a file or an archive can't be opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                inside = members(path, data) if ARCHIVE.search(path) else [("", data)]
                for member, content in inside:
                    full = f"{ARCHIVE.sub('', path)}/{member}" if member else path
                    yield pd.DataFrame({"path": [full], "text": [decoded(full, content)]})

    out = raw.mapInPandas(run, "path string, text string")
    return out.filter(~basename(F.col("path")).rlike(DROPPED))


def from_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """files(path, text) of a table's text column; the path is the key, zero-padded to 20 places so that it sorts as a number does."""
    name = F.col(key)
    path = F.when(name.isNotNull(), F.format_string("%020d", name)) if dict(df.dtypes)[key] in ("bigint", "int") else name.cast("string")
    return df.select(path.alias("path"), F.col(text).alias("text"))


def first_line_only(files: DataFrame) -> DataFrame:
    """head (what is to be rewritten) and tail of each text: for statistics reports (sarYYYYMMDD) only the first line is rewritten, and of later blocks nothing."""
    sar = basename(F.col("path")).rlike(r"^sar\d{8}(\.xz)?$")
    cut = F.instr("text", "\n")
    head = F.when(sar & (cut > 0), F.substring(F.col("text"), F.lit(1), cut - 1)).otherwise(F.col("text"))
    tail = F.when(sar & (cut > 0), F.substring(F.col("text"), cut, F.char_length("text"))).otherwise("")
    if "start" not in files.columns:
        return files.select("path", head.alias("text"), tail.alias("tail"))
    later = sar & (F.col("start") > 0)
    return files.select("path", "start", F.when(later, "").otherwise(head).alias("text"), F.when(later, F.col("text")).otherwise(tail).alias("tail"))


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Keywords of a file: one a line, what follows # left out, lower-cased."""
    rows = spark.read.text(path).select(F.lower(F.trim(F.substring_index("value", "#", 1))).alias("k")).filter("k <> ''").distinct()
    return [r.k for r in rows.orderBy("k").collect()]

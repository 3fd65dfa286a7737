"""A whole run in one call: read, learn, rewrite, rename, write, verify, and record what was done."""

from __future__ import annotations

import itertools
import re
import shutil
import time
import uuid
from collections.abc import Iterable
from collections.abc import Mapping as MappingType
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .operators import discover, report, verify
from .operators.rewrite import in_passes, serial_passes
from .sources import blocks, sinks
from .sources import files as readers
from .sources.config import Config
from .sources.naming import artifact_names, output_path, renamed
from .sources.tables import materialize, shared_dir


@dataclass
class Outcome:
    mapping: engine.Mapping
    status: int  # 0, or 3 if verification found leaks
    records: dict[str, str]  # mappings, audit, report: where they are
    unreadable: list[str]  # inputs, or members of archives, that could not be opened
    seconds: dict[str, float] = field(default_factory=dict)


class SameName(ValueError):
    pass


def inner_path(path: Column, root: str) -> Column:
    """A path below ``root``, without its scheme."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    return F.regexp_replace(plain, f"^{re.escape(root.rstrip('/'))}/+", "")


def rewritten(files: DataFrame, mapping: engine.Mapping, config: Config, root: str = "", header: bool = False) -> DataFrame:
    """path (of the output), source (of the input), text and changed.

    Of statistics reports only the first line is rewritten. Learned domains and
    host names are replaced in paths too.
    """
    done = engine.apply(readers.first_line_only(files), mapping, config, header)
    done = done.withColumn("name", inner_path(F.col("path"), root))
    for category in ("domain", "hostname"):
        if category in mapping.tables:
            done = in_passes(done, serial_passes(mapping.tables[category]), "name")
        else:
            done = done.withColumn("name", renamed(F.col("name"), mapping.category(category)))
    place = ["start"] if "start" in done.columns else []
    return done.select(output_path(F.col("name")).alias("path"), F.col("path").alias("source"), *place, F.concat("text", "tail").alias("text"), "changed")


def pipe(spark: SparkSession, source: Iterable[str], target: TextIO, config: Config | None = None, known: engine.Mapping | None = None,
         seeds: MappingType[str, list[str]] | None = None, keywords: list[str] = (), block_lines: int = 10_000) -> engine.Mapping:
    """Lines of ``source`` (as of sys.stdin) rewritten to ``target`` (as sys.stdout), in order; returns what was learned.

    Lines are spooled to the shared folder in blocks, so that the driver holds
    one block at a time; names are learned from all of them before the first is
    rewritten. No value spans two lines of different blocks but one that is
    written over several lines.
    """
    folder = Path(f"{shared_dir(spark).removeprefix('file:')}/pipe-{uuid.uuid4().hex}")
    folder.mkdir(parents=True)
    try:
        lines = iter(source)
        for k in itertools.count():
            block = list(itertools.islice(lines, block_lines))
            if not block:
                break
            (folder / f"{k:012d}").write_text("".join(block), encoding="utf-8", errors="surrogateescape", newline="")
        if not any(folder.iterdir()):
            return known or engine.Mapping()
        files = readers.read(spark, str(folder))
        mapping = engine.learn(files, config, known, seeds, keywords, from_text=True)
        done = materialize(engine.apply(files, mapping, config).select("path", "text"), "piped")
        for row in done.orderBy("path").toLocalIterator():
            target.write(row.text)
        return mapping
    finally:
        shutil.rmtree(folder, ignore_errors=True)  # what was piped is not left behind


def scrub(spark: SparkSession, paths: list[str], folder: str, stamp: str, config: Config | None = None, root: str = "", records: str | None = None,
          known: engine.Mapping | None = None, seeds: MappingType[str, list[str]] | None = None, keywords: list[str] = (), from_text: bool | None = None,
          header: bool = False, check: bool = True, password: str | None = None, host: str | None = None, operator: str = "",
          block: int | None = None) -> Outcome:
    """Rewrite ``paths`` (folders, files, archives) into ``folder``, which all executors must share.

    root: what output paths lose. records: the folder of the mapping, the audit
    record and the report, by default the configuration's. password: for an
    encrypted mapping, needed where the configuration asks for one. block: files
    are read, rewritten and written in blocks of so many bytes, whatever their
    size; names are then numbered by their place in a block, and the report gives
    findings by ``path@start`` and the line there. Inputs that can't be opened
    are named in the report. Two files of one output name are an error, found
    before anything is written.
    """
    config, seconds = config or Config(), {}
    if config.encrypt_mappings and password is None:
        raise ValueError("the configuration asks for an encrypted mapping, which needs a password")

    @contextmanager
    def timed(phase: str):
        began = time.monotonic()
        yield
        seconds[phase] = round(time.monotonic() - began, 3)

    with timed("read"):  # archives are unpacked once, though learning reads the texts several times
        given = materialize(blocks.read(spark, *paths, block=block) if block else readers.read_all(spark, *paths), "inputs")
        files = given.filter(F.col("text").isNotNull())
        if block:  # nothing of a file that breaks off is written
            files = files.join(given.filter(F.col("text").isNull()).select("path").distinct(), "path", "left_anti")
        unreadable = [r.path for r in given.filter(F.col("text").isNull()).select("path").orderBy("path").toLocalIterator()]
    with timed("learn"):
        words = [*keywords, *(readers.read_keywords(spark, config.key_words_file) if config.use_key_words_file else ())]
        mapping = engine.learn(files, config, known, seeds, words, from_text)
    with timed("rewrite"):
        done = materialize(rewritten(files, mapping, config, root, header), "rewritten")
        whole = done.filter("start = 0") if block else done
        if twice := whole.groupBy("path").count().filter("count > 1").first():
            raise SameName(f"{twice['count']} files would be written as {twice['path']}")
    with timed("write"):
        materialize(sinks.write_blocks(done, folder) if block else sinks.write_files(done.select("path", "text"), folder), "written")
    with timed("verify"):
        pairs = materialize(engine.mapping_table(files, mapping, config), "pairs")
        findings = None
        if check:
            identity = verify.identity(files, discover.sections(files))
            label = F.format_string("%s@%d", F.col("path"), F.col("start")).alias("path") if block else F.col("path")
            findings = materialize(verify.verify(done.select(label, "text"), pairs, identity, config.obfuscate_private_ip), "findings")
    names = {k: str(Path(records or config.dataset_dir, v)) for k, v in artifact_names(stamp, host).items()}
    names["mappings"] = sinks.save_mapping(mapping, names["mappings"], password if config.encrypt_mappings else None)
    raw = lambda *p: report.sha256_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(p)))
    sinks.save_json(sinks.audit_record(raw(*paths), raw(folder), stamp, "batch", names["mappings"], operator), names["audit"])
    told = sinks.report(report.counts_by_category(pairs), findings, stamp)
    sinks.save_json(told | {"unreadable": unreadable, "seconds": seconds, "changed": done.filter("changed").select("path").distinct().count(), "files": whole.count()}, names["report"])
    return Outcome(mapping, 0 if findings is None or findings.isEmpty() else 3, names, unreadable, seconds)

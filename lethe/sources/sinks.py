"""Writers: rewritten files, mappings, audit records and reports."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import io
import json
import lzma
import os
import tarfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Mapping
from ..operators.allocate import SubnetMap
from .naming import output_path


#: Files are compressed as their names say.
PACKERS = {".gz": lambda d: gzip.compress(d, mtime=0), ".xz": lzma.compress, ".bz2": bz2.compress}


def write_files(files: DataFrame, folder: str, root: str = "") -> DataFrame:
    """Write every (path, text) below ``folder``, which all executors must share; paths lose ``root``. Returns (path, bytes) of what was written."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path, text in zip(batch["path"], batch["text"]):
                inner = path.removeprefix("file:").removeprefix(root).lstrip("/")
                target = Path(folder, inner)
                if not os.path.realpath(target).startswith(os.path.realpath(folder) + os.sep):
                    raise ValueError(f"{path} leads out of {folder}")
                target.parent.mkdir(parents=True, exist_ok=True)
                data = PACKERS.get(target.suffix.lower(), bytes)((text or "").encode())
                part = target.with_name(f".{target.name}.{os.getpid()}")  # a task that runs again replaces whole files
                part.write_bytes(data)
                os.replace(part, target)
                done.append((str(target), len(data)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return files.mapInPandas(run, "path string, bytes long")


#: Compressed as the name says, a block at a time.
OPENERS = {".gz": lambda p: gzip.GzipFile(p, "wb", mtime=0), ".xz": lambda p: lzma.open(p, "wb"), ".bz2": lambda p: bz2.open(p, "wb")}


def write_blocks(blocks: DataFrame, folder: str, root: str = "") -> DataFrame:
    """write_files() for files in blocks (path, start, text): each is written in the order of its blocks by one task, which holds a few of them at a time.

    A file appears under its name when it is whole: a task that ends early
    leaves no part of it there, and one that runs again writes it anew.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = part = out = None
        done = []

        def close():
            if out is not None:
                out.close()
                os.replace(part, target)
                done.append((str(target), os.path.getsize(target)))

        current = None
        try:
            for batch in batches:
                for path, text in zip(batch["path"], batch["text"]):
                    if path != current:
                        close()
                        out, current = None, path
                        target = Path(folder, path.removeprefix("file:").removeprefix(root).lstrip("/"))
                        if not os.path.realpath(target).startswith(os.path.realpath(folder) + os.sep):
                            raise ValueError(f"{path} leads out of {folder}")
                        target.parent.mkdir(parents=True, exist_ok=True)
                        part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                        out = OPENERS.get(target.suffix.lower(), lambda p: open(p, "wb"))(part)
                    out.write((text or "").encode())
                yield pd.DataFrame(done, columns=["path", "bytes"])
                done.clear()
            close()
            out = None
            yield pd.DataFrame(done, columns=["path", "bytes"])
        finally:
            if out is not None:  # the task failed or was stopped inside this file
                out.close()
                Path(part).unlink(missing_ok=True)

    ordered = blocks.select("path", "start", "text").repartition("path").sortWithinPartitions("path", "start")
    return ordered.mapInPandas(run, "path string, bytes long")


def pack(folder: str, archive: str) -> str:
    """Pack a folder as a .txz archive, in the order of names."""
    with tarfile.open(archive, "w:xz") as tar:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file():
                tar.add(p, p.relative_to(folder), recursive=False)
    return archive


def to_json(mapping: Mapping) -> dict:
    """A mapping as an object of objects; names that are tables are not in it."""
    out = {c: dict(m) for c, m in mapping.names.items() if c not in mapping.tables}
    out["subnet"] = dict(mapping.subnets.rows())
    out["tld_map"] = dict(mapping.tld_map)
    out["state"] = mapping.subnets.state()
    return out


def from_json(data: dict) -> Mapping:
    if not isinstance(data, dict) or any(not isinstance(v, dict) for v in data.values()):
        raise ValueError("not a mapping: an object of objects is expected")
    import ipaddress

    subnets = SubnetMap()
    for real, fake in data.get("subnet", {}).items():
        r, f = ipaddress.IPv4Network(real), ipaddress.IPv4Network(fake)
        subnets.nets[int(r.network_address), r.prefixlen] = int(f.network_address)
        for pool, cidr in subnets.pools.items():
            space = ipaddress.IPv4Network(cidr)
            if f.network_address in space:
                slot = int(f.network_address) - int(space.network_address) >> 8
                subnets.used.setdefault(pool, set()).update(range(slot, slot + (1 << max(0, 24 - max(r.prefixlen, space.prefixlen)))))
    subnets.cursor = {k.removeprefix("pool_cursor_"): int(v) for k, v in data.get("state", {}).items() if k.startswith("pool_cursor_")}
    names = {c: dict(m) for c, m in data.items() if c not in ("subnet", "tld_map", "state", "tables")}
    return Mapping(names, subnets, dict(data.get("tld_map", {})))


def _cipher(password: str):
    from cryptography.fernet import Fernet  # an optional package

    key = hashlib.scrypt(password.encode(), salt=b"lethe-mappings", n=2**14, r=8, p=1, dklen=32)
    return Fernet(base64.urlsafe_b64encode(key))


def save_mapping(mapping: Mapping, path: str, password: str | None = None) -> str:
    """Write a mapping for its owner's eyes only; with a password, encrypted as <path>.enc or not at all.

    Names that are tables become tables in <path>.tables, which executors must
    share; there is no encrypted form of these.
    """
    if mapping.tables and password is not None:
        raise ValueError(f"more names than a mapping file holds, and no encrypted form of tables: {sorted(mapping.tables)}")
    record = to_json(mapping)
    for name, table in mapping.tables.items():
        record.setdefault("tables", {})[name] = f"{path}.tables/{name}"
        os.makedirs(f"{path}.tables", 0o700, exist_ok=True)
        table.select("real", "fake").write.mode("overwrite").parquet(f"{path}.tables/{name}")
    data = json.dumps(record, indent=2, sort_keys=True).encode()
    if password is not None:
        data, path = _cipher(password).encrypt(data), f"{path}.enc"
    _private(path, data)
    return path


def load_mapping(path: str, password: str | None = None, spark: SparkSession | None = None) -> Mapping:
    """Read a mapping; missing or malformed files are errors. spark: where names are tables."""
    data = Path(path).read_bytes()
    if path.endswith(".enc"):
        if password is None:
            raise ValueError("an encrypted mapping needs its password")
        data = _cipher(password).decrypt(data)
    record = json.loads(data)
    out = from_json(record)
    if places := record.get("tables"):
        if spark is None:
            raise ValueError("a mapping with tables needs a session")
        out.tables = {name: spark.read.parquet(p) for name, p in places.items()}
    return out


def show_mapping(path: str, password: str | None = None) -> str:
    """A mapping file as text, decrypted where it has to be; names that are tables are named by their place."""
    if path.endswith(".enc") and password is None:
        raise ValueError("an encrypted mapping needs its password")
    data = Path(path).read_bytes()
    if path.endswith(".enc"):
        data = _cipher(password).decrypt(data)
    return json.dumps(json.loads(data), indent=2, sort_keys=True)


def _private(path: str, data: bytes) -> None:
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb") as f:
        f.write(data)


def audit_record(inputs: DataFrame, outputs: DataFrame, stamp: str, mode: str, mapping_file: str | None = None, operator: str = "") -> dict:
    """Who ran what on which files. inputs, outputs: path, sha256 (see report.sha256_of)."""
    listed = lambda df: [{"path": r.path, "sha256": r.sha256} for r in df.select("path", "sha256").orderBy("path").toLocalIterator()]
    return {"tool": "lethe", "timestamp": stamp, "operator": operator, "mode": mode, "mapping_file": mapping_file, "inputs": listed(inputs), "outputs": listed(outputs)}


def save_json(record: dict, path: str) -> str:
    _private(path, json.dumps(record, indent=2).encode())
    return path


def report(counts: DataFrame, findings: DataFrame | None, stamp: str) -> dict:
    """Counts by category, and all findings where there are any; they pass one partition at a time."""
    out = {"tool": "lethe", "timestamp": stamp, "counts": {r.category or "total": r.n for r in counts.collect()}}
    if findings is not None and (rows := [r.asDict() for r in findings.orderBy("file", "line", "category", "value").toLocalIterator()]):
        out["verify"] = rows
    return out


def named_outputs(files: DataFrame) -> DataFrame:
    """``files`` under the names of outputs."""
    return files.withColumn("path", output_path(F.col("path")))


def archive_bytes(files: list[tuple[str, bytes]]) -> bytes:
    """A .txz archive of (path, content), for fixtures and small results."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:xz") as tar:
        for path, data in files:
            info = tarfile.TarInfo(path)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()

"""Files in blocks: the same texts, sections and outputs as whole files, in bounded memory."""

import bz2
import gzip
import io
import lzma
import random
import resource
import tarfile

import pytest
from pyspark.sql import functions as F

from lethe import job
from lethe.operators import discover
from lethe.sources import blocks, sinks
from lethe.sources import files as S
from lethe.sources.config import Config


def joined(df):
    """Text by path of rows in blocks; None where a null ends them."""
    parts = {}
    for r in df.orderBy("path", "start").collect():
        parts.setdefault(r.path.removeprefix("file:"), []).append(r)
    return {p: None if any(r.text is None for r in rows) else "".join(r.text for r in rows) for p, rows in parts.items()}


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abc é\U0001F600#") for _ in range(rng.randrange(40)))
    text = "\n".join(line() for _ in range(400))
    inner = sinks.archive_bytes([("w/deep.txt", text.encode()), ("w/deep.gz", gzip.compress(b"packed\nlines"))])
    base = tmp_path / "in"
    (base / "sub").mkdir(parents=True)
    (base / "a.txz").write_bytes(sinks.archive_bytes([("top/x.txt", b"ex \xff ok"), ("top/n.txz", inner), ("top/n/own.txt", b"own"), ("top/sa20240101", b"bin"),
                                                      ("top/bad.tgz", b"no archive"), ("top/empty", b"")]))
    (base / "multi.txz").write_bytes(sinks.archive_bytes([("one/x", b"1\n\n"), ("two/y", b"2"), ("../evil", b"3"), ("/abs", b"4")]))
    (base / "broken.tgz").write_bytes(b"no archive")
    (base / "cut.gz").write_bytes(gzip.compress(text.encode() * 9)[:-200])
    for end, pack in ((".gz", gzip.compress), (".xz", lzma.compress), (".bz2", bz2.compress)):
        (base / f"log{end}").write_bytes(pack(text.encode()))
    (base / "sub" / "plain.txt").write_text(text)
    (base / "sub" / "ended.txt").write_text(text + "\n")
    (base / "sub" / "bad.txt").write_bytes(b"a\xe2\x82\nb\xff\n" * 90)
    (base / "sub" / "long.txt").write_text("x" * 5000 + "\n" + "y" * 3000)
    (base / "sub" / "empty.txt").write_text("")
    (base / "x.obj").write_text("dropped")
    return str(base)


@pytest.mark.parametrize("block,task", [(64, 256), (1, 7), (1000, 100_000), (1 << 20, 1 << 20)])
def test_blocks_are_the_texts_of_whole_files(spark, folder, block, task):
    whole = {r.path.removeprefix("file:"): r.text for r in S.read_all(spark, folder).collect()}
    whole[f"{folder}/sub/empty.txt"] = ""  # which is no row of whole files
    if (block, task) == (1, 7):  # each task opens its file: the smallest ones are enough
        folder += "/sub/bad.txt"
        whole = {p: t for p, t in whole.items() if p == folder}
    got = joined(blocks.read(spark, folder, block=block, task=task))
    assert got == whole and len(got) in (1, 18)
    assert [p for p, t in got.items() if t is None and p.endswith(("cut.gz", "broken.tgz", "bad.tgz"))] == [p for p, t in got.items() if t is None]


def test_ranges_own_each_line_once(tmp_path):
    path = tmp_path / "f"
    for data in (b"", b"\n", b"\n\n\n", b"ab\n\ncd", b"ab\n\ncd\n", b"abcdefghij"):
        path.write_bytes(data)
        for task in range(1, len(data) + 2):
            for block in (1, 3, 100):
                reader = blocks.BlockReader([str(path)], block, task)
                rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
                assert "".join(r["text"] for r in rows).encode() == data
                assert [r["start"] for r in rows] == [sum(len(q["text"]) for q in rows[:i]) for i in range(len(rows))]


def test_many_small_files_share_a_task(tmp_path):
    for i in range(50):
        (tmp_path / f"f{i}").write_text("line\n" * 10)
    assert len(blocks.BlockReader([str(tmp_path)], 1 << 20, 1 << 20).partitions()) == 1
    assert len(blocks.BlockReader([str(tmp_path)], 1 << 20, 500).partitions()) == 5


def test_sections_go_on_from_block_to_block(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["# /etc/hosts", "#==[ x ]==", "  # /indented ", "# note", "", "10.0.0.1 web", "a # b", " "]
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_text("\n".join(rng.choice(kinds) for _ in range(300)) + ("\n" if k % 2 else ""))
    (tmp_path / "none.txt").write_text("")
    plain = lambda df: sorted((r.path.removeprefix("file:"), r.header, r.line_no, r.line) for r in discover.sections(df).collect())
    expected = plain(S.read(spark, str(tmp_path)))
    assert len(expected) > 300
    for block in (1, 50, 777, 1 << 20):  # from a block for each line to one for each file
        assert plain(blocks.read(spark, str(tmp_path), block=block)) == expected


def test_a_run_in_blocks_writes_what_a_run_of_whole_files_writes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"mail user{i % 7}@corp{i % 3}.io from 8.8.{i % 5}.{i % 200} password=Secret{i:04d}abc" for i in range(300)]
    (tmp_path / "in" / "messages.log").write_text("\n".join(lines))
    (tmp_path / "in" / "sar20240101").write_text("Linux host 8.8.8.8\nrest 8.8.8.8\n" * 20)
    (tmp_path / "in" / "packed.gz").write_bytes(gzip.compress("\n".join(lines[:50]).encode()))
    (tmp_path / "in" / "cut.gz").write_bytes(gzip.compress("\n".join(lines).encode() * 20)[:-60])
    out = {}
    config = Config(obfuscate_public_ip=True, obfuscate_username=False)
    for name, block in (("whole", None), ("parts", 500)):
        (tmp_path / f"r-{name}").mkdir()
        done = job.scrub(spark, [str(tmp_path / "in")], str(tmp_path / name), "T", config, root=str(tmp_path / "in"), records=str(tmp_path / f"r-{name}"),
                         from_text=True, block=block)
        assert [p.rpartition("/")[2] for p in done.unreadable] == ["cut.gz"]
        read = lambda p: gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes()
        out[name] = {p.name: read(p) for p in (tmp_path / name).rglob("*") if p.is_file()}
    assert set(out["whole"]) == set(out["parts"]) and len(out["whole"]) == 3
    lengths = {n: [len(t.split(b"\n")) for t in (out["whole"][n], out["parts"][n])] for n in out["whole"]}
    assert all(a == b for a, b in lengths.values()) and b"user" not in out["parts"]["messages_scrubbed.log"]
    assert b"rest 8.8.8.8" in next(t for n, t in out["parts"].items() if n.startswith("sar"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a/x", 0, "one\n"), ("a/x", 4, "two"), ("../out", 0, "evil")], "path string, start long, text string")
    with pytest.raises(Exception, match="leads out of"):
        sinks.write_blocks(rows.coalesce(1), str(tmp_path / "o")).collect()
    assert sinks.write_blocks(rows.filter("path = 'a/x'"), str(tmp_path / "o")).collect() == [(str(tmp_path / "o" / "a" / "x"), 7)]
    assert [p.name for p in (tmp_path / "o").rglob("*") if p.is_file()] == ["x"] and (tmp_path / "o" / "a" / "x").read_text() == "one\ntwo"


def test_large_members_and_files_are_read_in_bounded_memory(tmp_path):
    size = 200 << 20
    line = b"x" * 99 + b"\n"
    with tarfile.open(tmp_path / "big.tgz", "w:gz", compresslevel=1) as tar:
        info = tarfile.TarInfo("top/big.txt")
        info.size = size // len(line) * len(line)

        class Lines(io.RawIOBase):
            def read(self, n=-1):
                return (line * (n // len(line) + 1))[:n]

        tar.addfile(info, Lines())
    with open(tmp_path / "big.txt", "wb") as f:
        for _ in range(size // len(line) // 1000):
            f.write(line * 1000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    reader = blocks.BlockReader([str(tmp_path)], 1 << 20, 32 << 20)
    assert len(reader.partitions()) > 6
    total = sum(len(r["text"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())
    assert total == info.size + size // len(line) // 1000 * 1000 * len(line)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60 << 10  # KiB


def test_null_texts_and_columns(spark, tmp_path):
    (tmp_path / "a.xz").write_bytes(b"not xz")
    assert [tuple(r)[1:] for r in blocks.read(spark, str(tmp_path)).collect()] == [(0, None)]
    with pytest.raises(Exception):
        blocks.read(spark, str(tmp_path / "missing")).collect()
    (tmp_path / "none").mkdir()
    assert blocks.read(spark, str(tmp_path / "none")).count() == 0
    assert blocks.read(spark, str(tmp_path)).select(F.sum("start")).first()[0] == 0

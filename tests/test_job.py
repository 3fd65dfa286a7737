"""A whole run: inputs of all kinds, records, and reuse of a mapping."""

import io
import json
import lzma

import pytest

from lethe import engine, job
from lethe.sources import files as S
from lethe.sources import sinks
from lethe.sources.config import Config


@pytest.fixture
def inputs(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "corp.io.log").write_text("mail bob@corp.io about Acme at web.corp.io from 8.8.8.8\n")
    (root / "sar20240101").write_text("Linux web.corp.io\n10:00 web.corp.io 0.5\n")
    (root / "old.log.xz").write_bytes(lzma.compress(b"see corp.io\n"))
    (root / "a.txz").write_bytes(sinks.archive_bytes([("top/x.txt", b"nothing here\n"), ("top/bad.tgz", b"no archive")]))
    (root / "broken.tgz").write_bytes(b"no archive")
    (tmp_path / "words").write_text("acme # ours\n")
    return root


def run(spark, tmp_path, inputs, name, **more):
    config = Config(use_key_words_file=True, key_words_file=str(tmp_path / "words"))
    (tmp_path / f"records-{name}").mkdir()
    return job.scrub(spark, [str(inputs)], str(tmp_path / name), "T", config, root=str(inputs), records=str(tmp_path / f"records-{name}"), from_text=True, **more)


def test_a_whole_run(spark, tmp_path, inputs):
    got = run(spark, tmp_path, inputs, "out")
    out = tmp_path / "out"
    fake = got.mapping.category("domain")["corp.io"]
    assert {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()} == {
        f"{fake}_scrubbed.log", "sar20240101_scrubbed", "old_scrubbed.log.xz", "a/x_scrubbed.txt"}
    text = (out / f"{fake}_scrubbed.log").read_text()
    assert "corp.io" not in text and "bob" not in text and "Acme" not in text and "8.8.8.8" not in text and "keyword_1" in text
    first, rest = (out / "sar20240101_scrubbed").read_text().split("\n", 1)
    assert "corp.io" not in first and rest == "10:00 web.corp.io 0.5\n"
    assert lzma.decompress((out / "old_scrubbed.log.xz").read_bytes()).decode() == f"see {fake}\n"
    assert (out / "a" / "x_scrubbed.txt").read_text() == "nothing here\n"
    assert [p.rpartition("/in/")[2] for p in got.unreadable] == ["a/bad.tgz", "broken.tgz"]
    assert got.status == 3  # the rest of the statistics report still names a domain
    told, audit = (json.loads(open(got.records[k]).read()) for k in ("report", "audit"))
    assert told["files"] == 4 and told["changed"] == 3 and told["verify"] and set(told["seconds"]) == {"read", "learn", "rewrite", "write", "verify"}
    assert len(audit["inputs"]) == 5 and len(audit["outputs"]) == 4
    again = run(spark, tmp_path, inputs, "out2", known=sinks.load_mapping(got.records["mappings"]))
    assert again.mapping.names == got.mapping.names
    assert (tmp_path / "out2" / f"{fake}_scrubbed.log").read_text() == text


def test_two_files_of_one_name_are_an_error(spark, tmp_path, inputs):
    (inputs / "x.txt").write_text("a")
    (inputs / "x_scrubbed.txt").write_text("b")
    with pytest.raises(job.SameName):
        run(spark, tmp_path, inputs, "out")
    assert not (tmp_path / "out").exists()


def test_an_encrypted_mapping_needs_a_password(spark, tmp_path):
    with pytest.raises(ValueError):
        job.scrub(spark, [], str(tmp_path), "T", Config(encrypt_mappings=True))


def test_lines_are_piped_in_order(spark):
    given = [f"line {i} nfs: server files{i % 3}y.corp.io at corp.io\n" for i in range(25)] + ["last without end"]
    out = io.StringIO()
    mapping = job.pipe(spark, iter(given), out, Config(), keywords=["last"], block_lines=10)
    got = out.getvalue().splitlines(keepends=True)
    assert len(got) == 26 and all(g.startswith(f"line {i} ") for i, g in enumerate(got[:25])) and got[25] == "keyword_1 without end"
    assert "corp.io" not in out.getvalue() and set(mapping.names["hostname"]) == {"files0y", "files1y", "files2y"}
    assert job.pipe(spark, [], out).names == {}


def test_steps_are_timed(spark):
    from pyspark.sql import functions as F

    from lethe.functions import entities as E
    from lethe.operators import report

    files = spark.createDataFrame([("a", "mail ab@corp.io"), ("b", "none")], "path string, text string")
    rows = report.timed_profile(files, [("email", E.EMAIL_ENTITY.apply(F.col("text"))), ("mac", E.MAC_ENTITY.apply(F.col("text")))])
    assert {r["step"]: r["changed"] for r in rows} == {"email": 1, "mac": 0} and sum(r["share"] for r in rows) == pytest.approx(1)
    assert rows[0]["seconds"] >= rows[1]["seconds"] > 0 and all(r["bytes"] > 0 and r["mb_per_second"] > 0 for r in rows)


def test_a_mapping_can_be_shown(tmp_path):
    path = sinks.save_mapping(engine.Mapping({"user": {"bob": "user_0"}}), str(tmp_path / "m.json"))
    assert json.loads(sinks.show_mapping(path))["user"] == {"bob": "user_0"}
    with pytest.raises(ValueError):
        sinks.show_mapping(str(tmp_path / "m.json.enc"))


def test_unreadable_inputs_are_named(spark, inputs):
    assert S.read_all(spark, str(inputs)).filter("text is null").count() == 2 and S.read(spark, str(inputs)).count() == 4

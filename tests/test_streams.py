"""Streams that learn while they run: both limits of the bootstrap, numbers that go on, and restarts."""

import json
import os

import pytest

from lethe.sources.config import Config
from lethe.streaming.stream import Learner, wait_for

CONFIG = Config(obfuscate_private_ip=True)
SCHEMA = "path string, line_no long, text string"


def feed(folder, k, *lines):
    folder.mkdir(exist_ok=True)
    part = folder / f".{k}.json"
    part.write_text("".join(json.dumps({"path": "s", "line_no": 100 * k + i, "text": t}) + "\n" for i, t in enumerate(lines)))
    os.utime(part, (10**9 + k, 10**9 + k))  # files are read by age
    part.rename(folder / f"{k}.json")


def source(spark, folder, most=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most).json(str(folder))


def written(spark, sink):
    return [r.text for r in spark.read.parquet(str(sink)).orderBy("line_no").collect()]


def login(name):
    return f"session opened for user {name}"


def learner(tmp_path, **more):
    return Learner(str(tmp_path / "state"), str(tmp_path / "out"), CONFIG, **more)


def test_the_bootstrap_ends_with_its_lines(spark, tmp_path):
    for k, names in enumerate((["anna"], ["berta"], ["carla"], ["dora"])):
        feed(tmp_path / "in", k, *map(login, names), "anna berta carla dora")
    run = learner(tmp_path, lines=4, seconds=600)
    run.start(source(spark, tmp_path / "in"), str(tmp_path / "check"))
    assert run.mapping(spark).names["user"] == {"anna": "user_0", "berta": "user_1"}
    assert written(spark, tmp_path / "out") == [login("user_0"), "user_0 user_1 carla dora", login("user_1"), "user_0 user_1 carla dora",
                                                login("carla"), "user_0 user_1 carla dora", login("dora"), "user_0 user_1 carla dora"]


def test_the_bootstrap_ends_with_its_time(spark, tmp_path):
    feed(tmp_path / "in", 0, login("anna"))
    run = learner(tmp_path, lines=500, seconds=1.0)
    query = run.start(source(spark, tmp_path / "in"), str(tmp_path / "check"), once=False)
    try:
        assert wait_for(lambda: run._status()["frozen"] or run.failed) and run.failed is None
        feed(tmp_path / "in", 1, login("berta") + " after anna")
        assert wait_for(lambda: len(list((tmp_path / "out").glob("batch=*/_SUCCESS"))) == 2)
    finally:
        query.stop()
    assert written(spark, tmp_path / "out") == [login("user_0"), login("berta") + " after user_0"]


def test_a_stream_that_ends_early_ends_the_bootstrap(spark, tmp_path):
    feed(tmp_path / "in", 0, login("anna"), None)
    run = learner(tmp_path)
    run.start(source(spark, tmp_path / "in"), str(tmp_path / "check"))
    assert written(spark, tmp_path / "out") == [login("user_0"), None]


def test_numbers_go_on_and_survive_restarts(spark, tmp_path):
    feed(tmp_path / "in", 0, login("anna"), login("berta"))
    feed(tmp_path / "in", 1, login("carla") + " and anna")
    first = learner(tmp_path, lines=2, keep_learning=True)
    first.start(source(spark, tmp_path / "in"), str(tmp_path / "check"))
    assert first.mapping(spark).names["user"] == {"anna": "user_0", "berta": "user_1", "carla": "user_2"}
    feed(tmp_path / "in", 2, login("dora") + " carla")
    feed(tmp_path / "in", 3, login("anna") + " dora")
    again = learner(tmp_path, lines=2, keep_learning=True)  # a new process would start so
    again.start(source(spark, tmp_path / "in"), str(tmp_path / "check"))
    expected = [login("user_0"), login("user_1"), login("user_2") + " and user_0", login("user_3") + " user_2", login("user_0") + " user_3"]
    assert written(spark, tmp_path / "out") == expected
    # A micro-batch that comes again after a failure meets what was known before it, and replaces what it wrote.
    batch = spark.createDataFrame([("s", 200, login("dora") + " carla")], SCHEMA)
    again(batch, 2)
    assert written(spark, tmp_path / "out") == expected


@pytest.mark.parametrize("most", [1, 5])
def test_batches_do_not_matter_for_what_is_learned_at_first(spark, tmp_path, most):
    for k in range(5):
        feed(tmp_path / "in", k, login(f"name{k}x"), f"nfs: server files{k}y.corp.io down")
    run = learner(tmp_path, lines=10, seconds=600)
    run.start(source(spark, tmp_path / "in", most), str(tmp_path / "check"))
    assert run.mapping(spark).names["user"] == {f"name{k}x": f"user_{k}" for k in range(5)}
    assert all("name1x" not in t and "files" not in t for t in written(spark, tmp_path / "out"))

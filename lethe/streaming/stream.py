"""Streams: names are learned from a bootstrap and frozen, or learned on and on; all else is rewritten by hash, without state."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Mapping, apply, learn
from ..sources.config import Config
from ..sources.sinks import load_mapping, save_mapping

#: Lines of a bootstrap, and seconds that it lasts at most.
BOOTSTRAP_LINES, BOOTSTRAP_SECONDS = 500, 3.0


def bootstrap(lines: DataFrame, config: Config | None = None, seeds=None, keywords=(), n: int = BOOTSTRAP_LINES, order: Sequence[str] = ("line_no",)) -> Mapping:
    """Learn from the first ``n`` rows of a batch (path, line_no, text): host names, domains, users and networks."""
    head = lines.orderBy(*order).limit(n)
    whole = head.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda r: r["text"]), "\n").alias("text"))
    return learn(whole.select(F.lit("stream").alias("path"), F.coalesce("text", F.lit("")).alias("text")), config, seeds=seeds, keywords=keywords, from_text=True)


def scrub(stream: DataFrame, mapping: Mapping, config: Config | None = None) -> DataFrame:
    """A stream (or batch) of rows (path, text, ...) rewritten row by row, by the same chain as a batch."""
    return apply(stream, mapping, config)


def start(stream: DataFrame, mapping: Mapping, sink: str, checkpoint: str, config: Config | None = None, fmt: str = "parquet", once: bool = True):
    """Write the rewritten stream; restarts go on from the checkpoint. With names that are tables, each micro-batch is rewritten as a batch."""
    if mapping.tables:
        writer = stream.writeStream.foreachBatch(lambda batch, _: scrub(batch, mapping, config).write.format(fmt).mode("append").save(sink)).option("checkpointLocation", checkpoint)
    else:
        writer = scrub(stream, mapping, config).writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", sink).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


class Learner:
    """A stream that learns while it runs: the state of a run is a folder of mappings, one for each micro-batch that changed it.

    The first ``lines`` rows, or what comes in the first ``seconds`` after the
    first row, wait; then names are learned from them, and they are rewritten.
    After that the mapping is frozen or, with ``keep_learning``, each micro-batch
    adds what it has to what is known, with numbers that go on.

    Restarts: outputs are folders of micro-batches, written whole. A micro-batch
    that comes again after a failure meets the mapping of the one before it, and
    so gets the same fakes; one that was written is replaced by itself.
    """

    def __init__(self, state: str, sink: str, config: Config | None = None, lines: int = BOOTSTRAP_LINES, seconds: float = BOOTSTRAP_SECONDS,
                 keep_learning: bool = False, seeds=None, keywords=(), fmt: str = "parquet"):
        self.state, self.sink, self.config, self.fmt = Path(state), sink, config, fmt
        self.lines, self.seconds, self.keep_learning, self.seeds, self.keywords = lines, seconds, keep_learning, seeds, keywords
        self.lock, self.timer, self.failed = threading.RLock(), None, None
        self.state.mkdir(parents=True, exist_ok=True)

    def _status(self, before: int | None = None) -> dict:
        """The last status, or the last of a micro-batch before a given one."""
        known = [int(p.stem.split("-")[1]) for p in self.state.glob("status-*.json")]
        known = [b for b in known if before is None or b < before]
        if not known:
            return {"batch": -1, "frozen": False, "waiting": [], "lines": 0, "mapping": None}
        return json.loads((self.state / f"status-{max(known)}.json").read_text())

    def _save(self, status: dict) -> None:
        """A status is there whole or not at all; the two before it stay, for micro-batches that come again."""
        target = self.state / f"status-{status['batch']}.json"
        part = target.with_suffix(".part")
        part.write_text(json.dumps(status))
        os.replace(part, target)
        for p in sorted(self.state.glob("status-*.json"), key=lambda p: int(p.stem.split("-")[1]))[:-3]:
            p.unlink()

    def mapping(self, spark, status: dict | None = None) -> Mapping:
        """What is known now."""
        status = self._status() if status is None else status
        return load_mapping(status["mapping"], spark=spark) if status["mapping"] else Mapping()

    def _emit(self, rows: DataFrame, mapping: Mapping, batch: int) -> None:
        scrub(rows, mapping, self.config).write.format(self.fmt).mode("overwrite").save(f"{self.sink}/batch={batch}")

    def _freeze(self, spark, status: dict) -> dict:
        """Learn from the rows that wait, and let them go."""
        parts = [spark.read.parquet(str(self.state / f"waiting-{b}")).withColumn("_batch", F.lit(b)) for b in status["waiting"]]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        order = ("_batch", "line_no") if "line_no" in rows.columns else ("_batch", "path")
        mapping = bootstrap(rows, self.config, self.seeds, self.keywords, self.lines, order)
        path = save_mapping(mapping, str(self.state / f"mapping-{status['batch']}.json"))
        for b, p in zip(status["waiting"], parts):
            self._emit(p.drop("_batch"), mapping, b)
        return status | {"frozen": True, "waiting": [], "mapping": path}

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        with self.lock:
            status = self._status(batch)
            if not status["frozen"]:
                rows.write.mode("overwrite").parquet(str(self.state / f"waiting-{batch}"))
                n = spark.read.parquet(str(self.state / f"waiting-{batch}")).count()
                status |= {"batch": batch, "waiting": [*status["waiting"], batch], "lines": status["lines"] + n}
                if n and self.timer is None:  # the time runs from the first row, and is not for the next one to end
                    self.timer = threading.Timer(self.seconds, self._time_is_up, [spark])
                    self.timer.daemon = True
                    self.timer.start()
                if status["lines"] >= self.lines:
                    status = self._freeze(spark, status)
                self._save(status)
                return
            mapping = self.mapping(spark, status)
            if self.keep_learning:
                mapping = learn(rows.select("path", "text"), self.config, mapping, keywords=self.keywords, from_text=True)
                status = status | {"batch": batch, "mapping": save_mapping(mapping, str(self.state / f"mapping-{batch}.json"))}
            self._emit(rows, mapping, batch)
            self._save(status | {"batch": batch})

    def _time_is_up(self, spark) -> None:
        try:
            self.finish(spark)
        except Exception as failure:  # noqa: BLE001 - told by finish(), which the caller runs
            self.failed = failure

    def finish(self, spark) -> None:
        """End the bootstrap with what there is: when its time is up, or when the stream has ended."""
        with self.lock:
            status = self._status()
            if not status["frozen"] and status["lines"]:
                self._save(self._freeze(spark, status))

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Run over a stream of rows (path, line_no, text). once: what is there now, the bootstrap's end included."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if once else writer).start()
        if once:
            query.awaitTermination()
            self.finish(stream.sparkSession)
        return query


def wait_for(condition, seconds: float = 60.0, step: float = 0.1) -> bool:
    """Whether a condition comes true in time."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if condition():
            return True
        time.sleep(step)
    return False

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Mapping
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word, in Java's, Python's and DuckDB's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: White space between words.
GAP = r"[\x20\x09-\x0D]+"

_LOCAL_DIR: list[str] = []
_PATHS: dict[int, tuple] = {}  # of materialized tables, by the identity of their DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a
    ``local`` master gets a temporary folder of its own (driver and executors
    are one process there); any other master is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        folder = tempfile.TemporaryDirectory(prefix="lethe-")
        atexit.register(folder.cleanup)
        _LOCAL_DIR.append(folder.name)
    return _LOCAL_DIR[0]


def release(spark: SparkSession) -> None:
    """Let go what nothing refers to any more, on the driver, in Python and in the JVM, which gives back what its heap then doesn't need."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str, options: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back. options: of the writer.

    Lineage ends there: losing an executor later costs no recomputation, and
    what reads the result twice computes it once. Shuffle files of steps that
    are over are let go first: Spark deletes them once the driver has collected
    the garbage that refers to them.
    """
    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        held, path = _PATHS.pop(id(df), (lambda: None, ""))
        if held() is df:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def word_count(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of an Arrow batch that Python code works on at a time.
SLICE = 256


def append_columns(df: DataFrame, inputs: list[str], fields: T.StructType, make: Callable[..., list[pa.Array]], without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (but for its columns ``without``) and the columns ``fields``, which ``make`` computes from Arrow arrays of the columns ``inputs``.

    Columns of ``df`` with names of ``fields`` (in any case) give way to the new ones, as with withColumn.

    Works on ``SLICE`` rows at a time, so that the memory of a Python worker
    follows the longest rows and not the batch size. Workers live on between
    stages; what Arrow holds in reserve is let go when a partition is over.
    """
    at = [df.columns.index(c) for c in inputs]
    gone = {*without, *(f.name.lower() for f in fields)}
    passed = [k for k, c in enumerate(df.columns) if c not in without and c.lower() not in gone]
    schema = T.StructType([*(df.schema.fields[k] for k in passed), *fields.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                columns = [*(batch.column(k) for k in passed), *make(*(batch.column(k) for k in at))]
                yield pa.RecordBatch.from_arrays(
                    [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)

"""Which of very many values stand in texts, wherever they stand: an inverted index of grams, and verification.

Every value is filed under one gram, ``GRAM`` bytes of it (or the whole of a
shorter value), namely the one that fewest values share.  A pass over the texts
looks at every place and keeps those whose gram may be filed, by a bitmap of
bounded size; what is kept meets the values by an equality join on grams, and is
compared in full.  No pattern, list or product of values takes part, so that the
cost follows the texts and the hits, not the number of values.

The bitmap is the only thing sent to all tasks: some 16 bits for each value, and
never more than 2^``MOST_BITS`` bits, 16 MB. A fuller bitmap lets more places
through to the join, and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import materialize

GRAM = 6
#: Bits of the bitmap, as powers of two.
LEAST_BITS, MOST_BITS = 16, 27
#: Bytes of texts that are looked at together, and bytes that are kept on either side of a gram besides the longest value.
SLICE_BYTES, MARGIN = 1 << 20, 4
BREAK = 0xFF  # a byte that UTF-8 never holds


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """The grams of so many bytes at every place, with their length above the bytes."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    out = np.full(len(data) - length + 1, length, np.uint64)
    for k in range(length):
        out = (out << np.uint64(8)) | data[k:len(data) - length + k + 1]
    return out


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


FILED = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("gram", T.LongType()), T.StructField("offset", T.IntegerType()),
    T.StructField("points", T.IntegerType()), T.StructField("breaks", T.IntegerType())])


def filed(values: DataFrame, fold: bool = False) -> DataFrame:
    """value, key (its bytes, folded if told so), gram, and where the gram stands in the key: offset, in code points, in lines. Values are distinct and not empty."""
    arrow = to_arrow_schema(FILED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                key = (folded(value) if fold else value).encode("utf-8", "replace")
                data = np.frombuffer(key, np.uint8)
                points, breaks = np.cumsum((data & 0xC0) != 0x80), np.cumsum(data == 10)
                for i, g in enumerate(_grams(data, min(GRAM, len(key))).tolist()):
                    rows.append((value, key, g, i, int(points[i - 1]) if i else 0, int(breaks[i - 1]) if i else 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    own = values.select(F.col("value").cast("string").alias("value")).filter("value <> ''").distinct()
    every = own.mapInArrow(run, FILED)
    shared = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = every.join(shared, "gram").groupBy("value").agg(F.min(F.struct("n", "offset", "gram", "points", "breaks", "key")).alias("b"))
    return materialize(best.select("value", *[f"b.{f.name}" for f in FILED.fields[1:]]), "filed-values")


def _bitmap(index: DataFrame) -> tuple[np.ndarray, int, list[int], int]:
    """The bitmap of all grams, its bits, the lengths of grams, and the longest key."""
    about = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("key")).alias("longest")).first()
    bits = max(LEAST_BITS, min(MOST_BITS, (16 * about.n).bit_length()))
    lengths = index.select(F.least(F.length("key"), F.lit(GRAM)).alias("n")).distinct().collect()  # at most GRAM rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            own[_slots(batch.column(0).to_numpy().astype(np.uint64), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    table = np.zeros(1 << bits >> 3, np.uint8)
    for r in index.select("gram").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():  # bitmaps of one size, one after the other
        table |= np.frombuffer(bytes(r.bits), np.uint8)
    return table, bits, sorted(r.n for r in lengths), about.longest or 0


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some bytes of text, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def occurrences(files: DataFrame, values: DataFrame, keys: Sequence[str] = ("path",), text: str = "text", fold: bool = False) -> DataFrame:
    """Where values stand: ``keys`` of the row, start and size in code points, inner_line (from 0), value, seen (as it stands there, folded if told so),
    and the characters before and after.

    values: a column ``value``; empty and null ones don't count. fold: in any
    case. Every place of every value is found, places that overlap too; null
    texts have none; a row that occurs twice gives its places twice.
    """
    index = filed(values, fold)
    table, bits, lengths, longest = _bitmap(index)
    shared = files.sparkSession.sparkContext.broadcast(table)
    fields = [files.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("gram", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("place", T.IntegerType()),
                           T.StructField("row_line", T.IntegerType()), T.StructField("window", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(shared.value).view(bool)
        for whole in batches:
            for batch in _slices(whole, len(fields)):
                texts = [t or "" for t in batch.column(len(fields)).to_pylist()]
                parts = [(folded(t) if fold else t).encode("utf-8", "replace") for t in texts]
                joined = bytes([BREAK]).join(parts) + bytes([BREAK])
                data = np.frombuffer(joined, np.uint8)
                starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                lines = np.concatenate([[0], np.cumsum(data == 10)])
                for length in lengths:
                    grams = _grams(data, length)
                    at = np.flatnonzero(may[_slots(grams, bits)])
                    row = np.searchsorted(starts, at, side="right") - 1
                    lo, hi = np.maximum(starts[row], at - longest - MARGIN), np.minimum(starts[row + 1] - 1, at + longest + MARGIN)
                    numbers = [grams[at].astype(np.int64), at - lo, points[at] - points[starts[row]], lines[at] - lines[starts[row]]]
                    columns = [*(batch.column(k).take(pa.array(row)) for k in range(len(fields))), *map(pa.array, numbers),
                               pa.array([joined[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())]
                    yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    near = files.select(*keys, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    met = near.join(index, "gram").withColumn("from", F.col("at") - F.col("offset")).filter("from >= 0")
    met = met.filter(F.substring("window", F.col("from") + 1, F.length("key")) == F.col("key"))
    part = lambda a, n: F.substring("window", a, n).cast("string")
    lead = F.least(F.col("from"), F.lit(MARGIN))
    seen = F.col("key").cast("string")
    return met.select(
        *keys, (F.col("place") - F.col("points")).alias("start"), F.char_length(seen).alias("size"), (F.col("row_line") - F.col("breaks")).alias("inner_line"), "value", seen.alias("seen"),
        F.right(part(F.col("from") - lead + 1, lead), F.lit(1)).alias("before"),
        F.left(part(F.col("from") + F.length("key") + 1, F.lit(MARGIN)), F.lit(1)).alias("after"))


def bounded(before: str, after: str, flags: str = "") -> Column:
    """Whether a place of occurrences() has its boundaries: Java's zero-width patterns before its first and after its last character."""
    tests = []
    if before:
        tests.append(F.when(F.col("before") == "", F.col("seen").rlike(f"(?s){flags}^{before}")).otherwise(F.concat("before", "seen").rlike(f"(?s){flags}^.{before}")))
    if after:
        tests.append(F.when(F.col("after") == "", F.col("seen").rlike(f"(?s){flags}{after}\\z")).otherwise(F.concat("seen", "after").rlike(f"(?s){flags}{after}.\\z")))
    return reduce(lambda a, b: a & b, tests, F.lit(True))

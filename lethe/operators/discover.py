"""Discovery: candidates(category, real, path, pos) from files(path, text).

A candidate's ``pos`` is its place among the values of its kind in its text;
values are ordered by (path, pos), which makes first sight a total order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import ipv4
from ..functions.text import find_all
from ..sources.tables import materialize


def candidates(files: DataFrame, entity: E.Entity) -> DataFrame:
    """category, kind, real, path, pos: the values of one entity, as often as they occur."""
    return files.select("path", F.posexplode(entity.values(F.col("text"))).alias("pos", "real")).select(
        F.lit(entity.category).alias("category"), F.lit(entity.name).alias("kind"), "real", "path", "pos")


def all_candidates(files: DataFrame, which: Iterable[E.Entity] = E.PATTERN_ENTITIES) -> DataFrame:
    return reduce(DataFrame.unionByName, [candidates(files, e) for e in which])


def first_seen(found: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: first_path, first_pos and n, its occurrences."""
    return found.groupBy(*keys).agg(F.min(F.struct("path", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("first.path").alias("first_path"), F.col("first.pos").alias("first_pos"), "n")


#: Rows that one task may rank.
FEW_ROWS = 50_000


def numbered(seen: DataFrame, start: int = 1, order: Sequence[str] = ("first_path", "first_pos", "real"), rows: int | None = None) -> DataFrame:
    """``seen`` and ``number``, its rank by ``order`` (first sight) from ``start``. rows: its count, where that is known.

    Up to FEW_ROWS, counted, are ranked by one task. Beyond that
    the rank is two-level: rows are range-sorted by first sight, ranked within
    their partition's span, and shifted by the counts of the spans before, so
    that no single task sees all values.
    """
    if rows is not None and rows <= FEW_ROWS:
        return seen.withColumn("number", (F.row_number().over(Window.orderBy(*order)) + (start - 1)).cast("long"))
    spread = seen.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    spread = spread.sortWithinPartitions(*order).withColumn("step", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    spread = materialize(spread, "numbered")  # its partitions are read twice, and must be the same
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(before.select("part", "before")), "part").withColumn(
        "number", (F.col("before") + F.col("step") + start).cast("long")).drop("part", "step", "before")


def ipv4_candidates(files: DataFrame) -> DataFrame:
    """real, prefixlen (null where none is written), address (long), path, pos."""
    rows = files.filter(F.col("text").rlike(ipv4.MAY_HOLD)).select("path", F.posexplode(find_all(F.col("text"), ipv4.TOKEN)).alias("pos", "hit"))
    return ipv4_parsed(rows)


def ipv4_apart(files: DataFrame) -> DataFrame:
    """The same columns for addresses by their form alone, without context and prefixes (entities.IPV4_APART_ENTITY)."""
    return ipv4_parsed(candidates(files, E.IPV4_APART_ENTITY).select("path", "pos", F.col("real").alias("hit")))


def ipv4_parsed(rows: DataFrame) -> DataFrame:
    """real, prefixlen, address, path, pos of ``rows`` with matches (path, pos, hit)."""
    real = F.substring_index("hit", "/", 1)
    prefix = F.when(F.col("hit").contains("/"), F.substring_index("hit", "/", -1).try_cast("int"))
    return rows.select("path", "pos", real.alias("real"), prefix.alias("prefixlen"), ipv4.number(real).alias("address"))


def networks(found: DataFrame, private: bool = True) -> DataFrame:
    """Networks that are written with a prefix: real_net (long), prefixlen, category, first sight."""
    n, p = F.col("address"), F.col("prefixlen")
    rows = found.filter(p.between(1, 31) & ~ipv4.kept(n, F.col("real"), private))
    rows = rows.select("path", "pos", F.expr("shiftleft(shiftright(address, 32 - prefixlen), 32 - prefixlen)").alias("real_net"), "prefixlen")
    return first_seen(rows, "real_net", "prefixlen").withColumn("category", ipv4.category(F.col("real_net")))


def headers_before(blocks: DataFrame) -> DataFrame:
    """path, start, header_before, lines_before, is_last: what each block of a file takes over from the blocks before it.

    The window holds one narrow row for each block, and no text.
    """
    marks = F.filter(F.transform(F.split("text", "\n"), lambda line: F.trim(line)), lambda line: line.startswith("#"))
    own = blocks.select("path", "start", F.try_element_at(marks, F.lit(-1)).alias("mark"), F.regexp_count("text", F.lit("\n")).alias("ends"))
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return own.select("path", "start", F.last("mark", ignorenulls=True).over(before).alias("header_before"),
                      F.coalesce(F.sum("ends").over(before), F.lit(0)).cast("int").alias("lines_before"), F.lead("start").over(order).isNull().alias("is_last"))


def sections(files: DataFrame) -> DataFrame:
    """path, header, line_no, line: lines below ``# /path`` headers; a section ends at the next line that begins with #.

    Files may come in blocks of whole lines (with the column ``start``): sections
    go on from block to block, and lines are numbered in their file.
    """
    in_blocks = "start" in files.columns
    keys = ["path", "start"] if in_blocks else ["path"]
    last_no = [(F.size(F.split("text", "\n")) - 1).alias("last_no")] if in_blocks else []
    lines = files.select(*keys, *last_no, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marks = F.when(F.trim("line").rlike(r"^#"), F.struct("line_no", F.trim(F.col("line")).alias("header")))
    below = Window.partitionBy(*keys).orderBy("line_no")
    marked = lines.withColumn("mark", F.last(marks, ignorenulls=True).over(below)).withColumn("header", F.col("mark.header"))
    if in_blocks:  # what follows the last line end of a block is the next block's first line
        marked = marked.join(headers_before(files), keys).filter(F.col("is_last") | (F.col("line_no") < F.col("last_no")))
        marked = marked.withColumn("header", F.coalesce("header", "header_before")).withColumn("line_no", F.col("line_no") + F.col("lines_before"))
    return marked.filter(~F.trim("line").rlike("^#") & F.col("header").rlike(r"^# ?/")).select("path", "header", "line_no", "line")


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))

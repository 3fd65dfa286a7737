"""Counts, coverage, audit and profile."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def counts_by_category(mapping: DataFrame) -> DataFrame:
    """category, n: distinct values of each category, and a total under null."""
    return mapping.select("category", "real").distinct().rollup("category").agg(F.count(F.lit(1)).alias("n"))


def coverage_first_seen(found: DataFrame) -> DataFrame:
    """path, category, n: values whose first sight is in that file."""
    first = found.groupBy("category", "real").agg(F.min_by("path", F.struct("path", "pos")).alias("path"))
    return first.groupBy("path", "category").agg(F.count(F.lit(1)).alias("n"))


def coverage(found: DataFrame) -> DataFrame:
    """path, categories: what kinds a file contains."""
    return found.groupBy("path").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def top_files(found: DataFrame, k: int = 10) -> DataFrame:
    """path, hits: the files with the most values."""
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "path").limit(k)


def profile(files: DataFrame, chain, text: str = "text") -> DataFrame:
    """step, files, changed, bytes, share: how many texts each step of the chain changes, and the share of all changes."""
    rows, current = [], files
    for name, step in chain:
        after = current.withColumn("_new", step)
        rows.append(after.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("_new") != F.col(text)).alias("changed"),
                              F.sum(F.octet_length(text)).alias("bytes")))
        current = after.withColumn(text, F.col("_new")).drop("_new")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    total = F.sum("changed").over(Window.partitionBy())
    return out.withColumn("share", F.when(total > 0, F.col("changed") / total).otherwise(0.0))


def timed_profile(files: DataFrame, chain, text: str = "text") -> list[dict]:
    """step, seconds, share (of all seconds), bytes, mb_per_second, changed of each step (name, expression), the slowest first.

    Each step is run on what the one before left, and written, so that its
    seconds are its own; those of reading and writing are in all of them.
    """
    rows, current = [], materialize(files, "profile")
    for name, step in chain:
        began = time.monotonic()
        after = materialize(current.withColumn("_new", step), "profile")
        seconds = time.monotonic() - began
        r = after.agg(F.sum(F.octet_length(text)).alias("b"), F.count_if(F.col("_new") != F.col(text)).alias("changed")).first()
        rows.append({"step": name, "seconds": seconds, "bytes": r.b or 0, "mb_per_second": (r.b or 0) / 1e6 / max(seconds, 1e-9), "changed": r.changed})
        current = after.withColumn(text, F.col("_new")).drop("_new")
    total = sum(r["seconds"] for r in rows) or 1.0
    return sorted((r | {"share": r["seconds"] / total} for r in rows), key=lambda r: -r["seconds"])


def sha256_of(files: DataFrame, content: str = "content") -> DataFrame:
    """path, bytes, sha256."""
    return files.select("path", F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def tcprewrite_rules(subnets: DataFrame) -> DataFrame:
    """rank, rule: network pairs of equal prefix length below 32, most specific first. subnets: real_net, fake_net in prefix notation."""
    prefix = lambda c: F.substring_index(c, "/", -1).cast("int")
    first = F.substring_index("real_net", ".", 1).cast("int")
    own = subnets.filter(F.col("real_net").rlike(r"^[\d.]+/\d+$") & F.col("fake_net").rlike(r"^[\d.]+/\d+$"))
    own = own.filter((prefix("real_net") == prefix("fake_net")) & (prefix("real_net") < 32) & (first != 127) & ~first.between(224, 239))
    order = Window.orderBy(prefix("real_net").desc(), F.desc("real_net"), F.desc("fake_net"))
    return own.select(F.row_number().over(order).cast("long").alias("rank"), F.concat_ws(":", "real_net", "fake_net").alias("rule"))

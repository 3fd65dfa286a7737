"""Mixing sources to target weights with a time-varying curriculum [native].

Every source gets a target number of words (weights, cap, resharing) and a
schedule: a piecewise linear rate over training time 0..1.  The integral of the
schedule, scaled to the target, is the source's cumulative demand; a document
whose words begin at offset c of its source's stream is trained on at the time
t at which that demand reaches c.  The result is sorted by t.

Scale: texts are reduced to word counts in one pass.  Offsets are prefix sums
in two levels: documents fall into buckets of a hash order within their source,
bucket sums give each bucket's offset, and a window sums within one bucket, so
that no source, however hot, ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, free_name, materialize, table, word_count

Knots = Sequence[tuple[float, float]]

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Schedules by rank of the source, repeating: (time, rate) knots.
SCHEDULES: tuple[Knots, ...] = (((0, 1.5), (1, 0.5)), ((0, 1.0), (1, 1.0)), ((0, 0.5), (1, 1.5)))
#: Hexadecimal digits of the hash that name a bucket: 16**3 buckets a source.
BUCKET_DIGITS = 3


def segments(knots: Knots) -> list[tuple[float, float, float, float]]:
    """(start time, rate there, slope, share of demand before it) of each piece, for a total demand of 1."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must run from time 0 to time 1")
    if any(r < 0 for _, r in knots) or all(r == 0 for _, r in knots):
        raise ValueError("rates must not be negative, nor all 0")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        out.append((float(t0), r0 / area, (r1 - r0) / area / (t1 - t0), before))
        before += (t1 - t0) * (r0 + r1) / 2 / area
    return out


def invert(share: Column, knots: Knots) -> Column:
    """The time at which the integral of the schedule reaches ``share`` (0 to 1)."""
    pieces = segments(knots)
    out = None
    for i, (t0, rate, slope, before) in enumerate(pieces):
        x = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + F.lit(2 * slope) * x, F.lit(0.0)))
        below = F.lit(rate) + root
        at = F.lit(t0) + F.when(below > 0, F.lit(2.0) * x / below).otherwise(0.0)
        out = at if out is None else F.when(share >= before, at).otherwise(out)
    return out


def source_targets(sizes: DataFrame, share: float, cap: float, weights: Sequence[float]) -> DataFrame:
    """Targets from rows (source, words): source, rank, source_size, target.

    Sources rank by code point, null last.  The level of water filling is found
    in closed form: with sources ordered by the level at which they reach their
    cap, it is the first level that stays under the next source's.  The windows
    hold one row for each source.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = sizes.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    w = ranked.withColumn("weight", weight).withColumn("budget", F.lit(float(share)) * total)
    w = w.withColumn("full_at", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(order), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    w = w.withColumn("level", (F.col("budget") - capped) / (F.sum("weight").over(Window.partitionBy()) - used))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(Window.partitionBy())
    full = F.lit(float(cap)) * F.col("source_size")
    return w.withColumn("at", level["level"]).select(
        "source", "rank", "source_size",
        F.round(F.least(full, F.coalesce(F.col("at") * F.col("weight"), full)), 6).alias("target"))


def plan_mix(docs: DataFrame, carry: Sequence[str] = (), share: float = 1.5, cap: float = 2.0,
             weights: Sequence[float] = WEIGHTS, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """Sizes, targets, words taken and training times, one row for each document.

    Columns: doc_id, source, size, source_size, target, taken, epochs (an array
    of (position, start, words), a struct for each time that the document is
    taken) and the hash that fixed its place, besides those in ``carry``.

    A source's stream is its documents in hash order, over and over.  The mix
    takes the first floor(target) words of it, so one document of a source may
    be cut; no document exceeds ``ceil(cap)`` passes.  Null texts have 0 words
    and are never taken; a null source is a source, the last; repeated rows are
    rows of their own, which hash order places side by side; an empty table
    gives no rows; extra columns don't matter.
    """
    keep = [F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest"), *keep)
    narrow = narrow.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    if not carry:  # a row is some 60 bytes: one pass over the texts serves both the sums and the windows
        narrow = materialize(narrow, "mix-sizes")
    sums = materialize(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    targets = source_targets(sums, share, cap, weights)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    s, t = offsets.alias("s"), targets.alias("t")
    offsets = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("source_"), F.col("s.bucket").alias("bucket_"), "offset", "rank", "source_size", "target")

    within = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, placed.source.eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    start = F.col("offset") + F.col("inner")
    whole = F.floor("target")
    epochs = []
    for e in range(int(-(-cap // 1))):
        at = start + F.lit(e) * F.col("source_size")
        words = F.greatest(F.least(whole, at + F.col("size")) - at, F.lit(0)).cast("long")
        part = F.when(F.col("target") > 0, at.cast("double") / F.col("target")).otherwise(0.0)
        time = None
        for k, knots in enumerate(schedules):
            now = invert(part, knots)
            time = now if time is None else F.when(F.pmod("rank", F.lit(len(schedules))) == k, now).otherwise(time)
        epochs.append(F.struct(F.round(time, 9).alias("position"), at.alias("start"), words.alias("words")))
    all_epochs = F.array(*epochs)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate(all_epochs, F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.filter(all_epochs, lambda x: x["words"] > 0).alias("epochs"), "digest",
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)])


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = WEIGHTS,
        schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """The training stream: a row for each time that a document is taken, with
    the columns of ``docs``, sorted by training position.

    Where a target ends inside a document, the text of that last copy ends
    there too.  Documents that the mix doesn't take are absent.
    """
    row = free_name(docs, "row")
    kept = docs.withColumn(row, F.struct(*docs.columns)).select("doc_id", "source", "text", row)
    planned = plan_mix(kept, carry=[row], share=share, cap=cap, weights=weights, schedules=schedules)
    copies = planned.select(F.explode("epochs").alias("epoch"), "size", "digest", F.col(row).alias("row"))
    copies = copies.orderBy(F.col("epoch")["position"], "digest", F.col("epoch")["start"])
    text = F.when(F.col("epoch")["words"] >= F.col("size"), F.col("row")["text"]).otherwise(
        first_words(F.col("row")["text"], F.col("epoch")["words"]))
    return copies.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    ends = F.split(text, rf"(?<={WORD[:-1]})(?={GAP[:-1]})")
    return F.array_join(F.slice(ends, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with what the mix takes of each, in training order."""
    planned = plan_mix(table(spark, sf_dir, "documents"))
    first = F.try_element_at("epochs", F.lit(1))["position"]
    out = planned.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), "digest")
    return out.orderBy(F.col("position").asc_nulls_last(), "digest").drop("digest")


OP2_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + rank % 3] AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank
    FROM sized GROUP BY source)),
filled AS (
  SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level,
         2.0::DOUBLE * source_size / weight AS full_at
  FROM ranked WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, rank, source_size,
         round(least(2.0::DOUBLE * source_size,
                     coalesce((SELECT arg_min(level, full_at) FROM filled WHERE level <= full_at) * weight, 2.0::DOUBLE * source_size)), 6) AS target
  FROM filled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank, floor(t.target)::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(least(whole, start + size) - start, 0)::BIGINT AS first_take,
         greatest(least(whole, start + source_size + size) - start - source_size, 0)::BIGINT AS second_take,
         CASE WHEN target > 0 THEN start / target ELSE 0 END AS part,
         CASE rank % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0 ELSE 0.5 END AS rate,
         CASE rank % 3 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0 ELSE 1.0 END AS slope
  FROM placed)
SELECT doc_id, size, source_size, target, (first_take + second_take)::BIGINT AS taken,
       CASE WHEN first_take > 0
            THEN round(2.0::DOUBLE * part / (rate + sqrt(greatest(rate * rate + 2.0::DOUBLE * slope * part, 0))), 9) END AS position
FROM taken
"""

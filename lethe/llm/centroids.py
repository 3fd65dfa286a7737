"""Centroid clustering by weighted deduplication, in whole numbers.

Vectors are quantised and grouped: equal ones become one row with a
multiplicity.  Lloyd's rounds run over the distinct vectors, with sums weighted
by multiplicity, and the assignments are joined back to the ids.  All sums,
distances and centroids are whole numbers, so that results depend on neither
order nor partitions.

Scale: a round is a narrow pass over the distinct vectors that sends one row
for each cluster and component of a partition; only the k centroids come to the
driver.  Vectors that make up more than a thousandth of all rows (under a
thousand of them) are joined back by broadcast, so that no key of the shuffled
join is hot.

Vectors of another length, or with null or non-finite components, are left out.
A null vec_id is clustered, but never a first centroid. Repeated rows count as
often as they occur. Ties: equal distances go to the smaller cluster; equal
hashes of first centroids go by vector. With fewer kept vectors with an id than
clusters, there are fewer clusters; without any, the result is empty. Other
columns are not read. A component beyond the range of a long is cut to it, and
so is a distance or a sum of distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: A vector with more than this share of all rows is joined back by broadcast.
HOT_SHARE = 1000
LARGEST = (1 << 63) - 1

Centroids = list[list[int]]


def quantised(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component x, of the vectors with so many finite components."""
    x = F.col("embedding")
    whole = F.coalesce((F.size(x) == components) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.filter(whole).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def first_centroids(kept: DataFrame, clusters: int, prefix: str) -> Centroids:
    """The vectors with the smallest hashes of their ids, in the order of the hashes."""
    rows = kept.withColumn("h", F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)).filter(F.col("h").isNotNull())
    return [list(r.v) for r in rows.orderBy("h", "v").limit(clusters).collect()]


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and the squared distance, exactly.

    Components below 2^22 are exact in double precision, and below 2^27 in
    longs; beyond that Python's numbers are used.
    """
    largest = max((max(map(abs, c)) for c in centroids), default=0)
    if len(vectors):
        largest = max(largest, int(vectors.max()), -int(vectors.min()))
    if largest < 1 << 22:
        x, c = vectors.astype(np.float64), np.array(centroids, np.float64)
        all_ = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        kind = np.int64 if largest < 1 << 27 else object
        x = vectors.astype(kind)
        all_ = np.stack([((x - np.array(c, kind)) ** 2).sum(1) for c in centroids], 1)
    at = all_.argmin(1)
    return at.astype(np.int64), all_[np.arange(len(vectors)), at]


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def _sums(distinct: DataFrame, centroids: Centroids, components: int) -> dict[int, tuple[int, list[int]]]:
    """Multiplicity and componentwise sum of each cluster's vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            x, n = _matrix(batch.column(0), components), batch.column(1).to_numpy()
            at, _ = nearest(x, centroids)
            largest = int(n.sum()) * max(1, -int(x.min()), int(x.max())) if len(n) else 0
            x, n = (x, n) if largest < LARGEST else (x.astype(object), n.astype(object))
            for k in np.unique(at).tolist():
                own = at == k
                new = [int(n[own].sum()), *map(int, (x[own] * n[own][:, None]).sum(0))]
                total[k] = [a + b for a, b in zip(total[k], new)] if k in total else new
        rows = [(k, i, str(v)) for k, values in total.items() for i, v in enumerate(values)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.string()))], ["cluster", "i", "s"])

    parts = distinct.select("v", "n").mapInArrow(run, "cluster int, i int, s string")
    rows = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters times components
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.cluster, r.i)):
        if r.i == 0:
            out[r.cluster] = (int(r.s), [])
        else:
            out[r.cluster][1].append(int(r.s))
    return out


def lloyd(distinct: DataFrame, centroids: Centroids, rounds: int = ROUNDS, components: int = COMPONENTS) -> Centroids:
    """Centroids after so many rounds over ``distinct`` (v, n); a cluster without vectors keeps its centroid."""
    for _ in range(rounds):
        sums = _sums(distinct, centroids, components)
        new = [[s // sums[k][0] for s in sums[k][1]] if k in sums else c for k, c in enumerate(centroids)]
        if new == centroids:  # no later round would change them
            break
        centroids = new
    return centroids


ASSIGNED = T.StructType([T.StructField("v", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def assigned(distinct: DataFrame, centroids: Centroids, components: int = COMPONENTS) -> DataFrame:
    """``distinct`` (v, n) with cluster and squared distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = nearest(_matrix(batch.column(0), components), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array([min(int(x), LARGEST) for x in far], pa.int64())], ["v", "n", "cluster", "distance"])

    return distinct.select("v", "n").mapInArrow(run, ASSIGNED)


def _cut(total: Column) -> Column:
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, prefix: str = "3:", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each vector (vec_id, embedding) that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    prefix: stands before the id in the hash that picks the first centroids.
    """
    spark = vectors.sparkSession
    kept = quantised(vectors, components, scale)
    distinct = materialize(kept.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "centroids-distinct")
    first = first_centroids(kept, clusters, prefix)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    last = lloyd(distinct, first, rounds, components)
    found = materialize(assigned(distinct, last, components), "centroids-assigned")
    far = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)")
    inertia = found.groupBy("cluster").agg(far.alias("s"), F.sum("n").alias("rows")).collect()  # a row for each cluster
    total, rows = sum(int(r.s) for r in inertia), sum(r.rows for r in inertia)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    of = spark.createDataFrame([(r.cluster, min(int(r.s), LARGEST), min(total, LARGEST), names[r.cluster]) for r in inertia],
                               "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    hot = F.col("n") > max(1, rows // HOT_SHARE)
    few = F.broadcast(found.filter(hot).select("v", F.col("cluster").alias("hot_cluster"), F.col("distance").alias("hot_distance")))
    split = kept.join(few, "v", "left")
    cold = split.filter(F.col("hot_cluster").isNull()).select("vec_id", "v").join(found.filter(~hot).select("v", "cluster", "distance"), "v")
    both = split.filter(F.col("hot_cluster").isNotNull()).select("vec_id", F.col("hot_cluster").alias("cluster"), F.col("hot_distance").alias("distance")).unionAll(
        cold.select("vec_id", "cluster", "distance"))
    return both.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` with 64 finite components in 8 clusters, after 10 rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (SELECT v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT q.v, c.cluster, list_sum(list_transform(list_zip(q.v, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM q, c{k} c) GROUP BY v),
""" + (f"""
s{k} AS (SELECT a.cluster, i, sum(q.v[i] * q.n)::HUGEINT AS s, sum(q.n)::HUGEINT AS n FROM a{k} a JOIN q USING (v), range(1, {COMPONENTS + 1}) r(i) GROUP BY ALL),
m{k} AS (SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m USING (cluster)),""" if k < ROUNDS else "")


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
q AS MATERIALIZED (SELECT v, count(*) AS n FROM kept GROUP BY v),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT v, sha256('3:' || vec_id::VARCHAR) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CLUSTERS})),
{"".join(_round(k) for k in range(ROUNDS + 1))}
f AS MATERIALIZED (SELECT a.v, a.cluster, a.distance, q.n FROM a{ROUNDS} a JOIN q USING (v)),
t AS (SELECT cluster, sum(distance * n)::BIGINT AS cluster_inertia FROM f GROUP BY cluster)
SELECT kept.vec_id, f.cluster, f.distance, t.cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM t) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM kept JOIN f USING (v) JOIN t USING (cluster) JOIN c{ROUNDS} c USING (cluster)
"""

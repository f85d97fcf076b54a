"""Centroid clustering: k-means on integer vectors with scalar lookup tables.

A round looks up distances instead of computing them: for each dimension, the squared differences of its occurring integer values
and all centroids are tabulated, and a vector's distances are the sums of its rows of these tables. Each task adds up its
vectors by cluster and dimension; k * dimensions sums, by Spark, reach the driver a round, and the centroids go with the next tasks
(both of a fixed size). Integer vectors are written once to the shared folder and read every round.

All arithmetic is exact: sums leave a task as 64-bit integers and are added as decimals.

Defined results: rows whose vector is null, of another length, or holds a null, NaN or infinite component are left out; ties go to
the smaller cluster; fewer vectors than k make as many centroids; equal vectors may start several centroids, of which
the later stay empty and unmoved; repeated rows count again; a null vec_id is ordered as the text "null"; rows of one
vec_id are ordered by their vectors; a component of 2^17 or more (its squared distances leave 64 bits) is refused by an error; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import materialize

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED, MOST = 8, 10, 64, 1024, 3, 1 << 17


def integer_vectors(table: DataFrame, dimensions: int = DIMENSIONS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the vector's components as integers, of the rows that are whole."""
    whole = F.col("_v").isNotNull() & (F.size("_v") == dimensions) & F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    number = lambda x: F.when(F.abs(x) < MOST, F.floor(SCALE * x).cast("int")).otherwise(F.raise_error(F.lit(f"a component is {MOST} or more")).cast("int"))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")).filter(F.coalesce(whole, F.lit(False)))
    return rows.select("vec_id", F.transform("_v", number).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(by.alias("by"), "v").orderBy("by", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), -1 if rows else DIMENSIONS)


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), np.int64).reshape(-1, dimensions)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and squared distance of each vector, by one table a dimension."""
    far = np.zeros((len(vectors), len(centroids)), np.int64)
    for column, place in zip(vectors.T, centroids.T, strict=True):
        values, code = np.unique(column, return_inverse=True)
        table = (values[:, None] - place) ** 2
        far += table[code]
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(far)), cluster]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dimensions = centroids.shape

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            rows = _matrix(batch, dimensions)
            cluster, _ = nearest(rows, centroids)
            np.add.at(n, cluster, 1)
            for c in np.unique(cluster):
                sums[c] += rows[cluster == c].sum(axis=0)
        c, d = np.divmod(np.arange(k * dimensions), dimensions)
        yield pa.record_batch({"c": pa.array(c), "d": pa.array(d), "total": pa.array(sums.ravel()), "n": pa.array(n[c])})

    parts = vectors.select("v").mapInArrow(add_up, "c long, d long, total long, n long")
    out = centroids.copy()
    for r in parts.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n")).collect():
        if r.n:
            out[r.c, r.d] = int(r.total) // r.n
    return out


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of each of `vectors` (integer_vectors)."""
    kind = "vec_id long, cluster int, distance long"
    vectors = materialize(vectors, "op13-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"{kind}, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    dimensions = centroids.shape[1]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch, dimensions), centroids)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)})

    assigned = vectors.mapInArrow(assign, kind)
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    return assigned.withColumns(
        {
            "cluster_inertia": of(F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))),
            "inertia": F.lit(sum(inertia.values())).cast("long"),
            "centroid_sha256": of(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()),
            "centroid": of(F.array(*(F.lit(x).cast("long") for x in c)) for c in centroids.tolist()),
        }
    )


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).drop("centroid")


def _sql() -> str:
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT k, min(far * {CLUSTERS} + c) AS m FROM (SELECT k, c, sum((v.x - c.x) * (v.x - c.x)) AS far FROM v JOIN c{i} c USING (dim) GROUP BY k, c) GROUP BY k)""")
        if i < ROUNDS:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (SELECT c.c, dim, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x
  FROM c{i} c LEFT JOIN (SELECT m % {CLUSTERS} AS c, dim, sum(x) AS s, count(*) AS n FROM a{i} JOIN v USING (k) GROUP BY ALL) USING (c, dim))""")
    return f"""
WITH e AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {DIMENSIONS}),
v AS MATERIALIZED (SELECT k, unnest(range(1, {DIMENSIONS + 1})) AS dim, unnest(v) AS x FROM e),
f AS (SELECT k, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT c, dim, x FROM f JOIN v USING (k) WHERE c < {CLUSTERS}),{','.join(steps)},
h AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c),
z AS (SELECT vec_id, m % {CLUSTERS} AS cluster, m // {CLUSTERS} AS distance FROM a{ROUNDS} JOIN e USING (k))
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM z JOIN h ON h.c = z.cluster"""


SQL = _sql()

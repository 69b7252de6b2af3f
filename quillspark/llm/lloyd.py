"""Plain Lloyd clustering over integer vectors, so that every result is exact.

Centroids are broadcast; each partition takes the squared differences of its vectors to every
centroid in NumPy, and the least (of equal ones the lowest number) wins. What goes back are
integer sums and counts for each centroid and partition, which Spark adds up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace

#: Components are held between minus and plus this, so that distances of 64 of them fit 64 bits.
REACH = 1 << 27
#: Vectors of one step of numpy work.
STEP = 4096


def kept_vectors(embeddings: DataFrame, dimensions: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v (array of long, floor(scale * x)) of rows with so many components, none null or non-finite.

    Components beyond REACH are held there.
    """
    x = F.col("embedding").cast("array<double>")
    sound = (F.size("embedding") == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(REACH))), F.lit(float(-REACH)))).cast("long"))
    return embeddings.filter(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: str = "2") -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256, in that order; rows without vec_id come last, equal ones by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return np.array([r["v"] for r in chosen.collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (of equal ones the lowest), and the squared distance."""
    squares = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        apart = x - centroid
        squares[:, c] = np.einsum("ij,ij->i", apart, apart)
    at = squares.argmin(1)
    return at, squares[np.arange(len(x)), at]


def _steps(batches, *columns):
    for b in batches:
        for at in range(0, len(b), STEP):
            part = b.iloc[at : at + STEP]
            yield part, np.stack(part["v"].to_numpy())


def partial_sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and a column of sums for each component: a row for each partition and centroid with vectors."""
    spark, (k, d) = kept.sparkSession, centroids.shape
    shared = spark.sparkContext.broadcast(centroids)
    names = ["cluster", "n", *(f"s{i}" for i in range(d))]

    def run(batches):
        total, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for _, x in _steps(batches):
            at, _ = nearest(x, shared.value)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=k)
        has = np.flatnonzero(n)
        yield pd.DataFrame(np.concatenate([has[:, None], n[has, None], total[has]], 1), columns=names)

    return kept.select("v").mapInPandas(run, ", ".join(f"{c} long" for c in names))


def lloyd_round(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    sums = [c for c in (f"s{i}" for i in range(centroids.shape[1]))]
    merged = partial_sums(kept, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
    out = centroids.copy()
    for r in merged.collect():  # a row for each centroid at most
        out[r["cluster"]] = [r[c] // r["n"] for c in sums]
    return out


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for part, x in _steps(batches):
            at, far = nearest(x, shared.value)
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64").to_numpy(), "cluster": at.astype(np.int32), "distance": far})

    return kept.select("vec_id", "v").mapInPandas(run, "vec_id long, cluster int, distance long")


def lloyd(spark: SparkSession, embeddings: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors that are null, of other dimensions, or that hold null or non-finite components take
    no part. Fewer vectors than k give as many centroids; none give no rows. Rows with null or
    repeated vec_id, and copies by the million, each count. Other columns are not read. Inertias
    beyond 64 bits stand at the largest number. Only centroids and a row for each of them reach
    the driver.
    """
    ws = Workspace(spark)
    kept = ws.table("kept", kept_vectors(embeddings, dimensions, scale))
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = lloyd_round(kept, centroids)
    found = ws.table("found", assign(kept, centroids))
    top = (1 << 63) - 1
    inertia = {r["cluster"]: int(r["i"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("i")).collect()}
    total = min(sum(inertia.values()), top)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, min(i, top), total, digest[c]) for c, i in inertia.items()]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters, after five rounds."""
    return lloyd(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The same in SQL: a step for each round, all distances by a join with the k centroids."""
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS cluster, v FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED (SELECT vec_id, v, n.cluster AS cluster, n.d AS distance FROM (SELECT x.vec_id, x.v, arg_min({{'cluster': c.cluster, 'd': {square}}}, {{'d': {square}, 'cluster': c.cluster}}) AS n FROM (SELECT *, row_number() OVER () AS r FROM kept) x, c{i} c GROUP BY x.r, x.vec_id, x.v))")
        if i < rounds:
            floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
            steps.append(f"dims{i} AS MATERIALIZED (SELECT cluster, dim, {floor} AS m FROM (SELECT cluster, dim, sum(v[dim]) AS s, count(*) AS n FROM near{i}, range(1, 65) t(dim) GROUP BY cluster, dim))")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(m ORDER BY dim) AS v FROM dims{i} GROUP BY cluster) m USING (cluster))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} c USING (cluster)"""


OP12_SQL = _sql()

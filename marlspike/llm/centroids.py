"""Centroid clustering by sort-means.

Each round knows the distances between all centroids, and for each centroid the others in their order. A vector starts
from the centroid that it was assigned to before: with distance d to it, a centroid further than 2 d from that one is
further than d from the vector, so the scan along the order stops strictly beyond 2 d. A tie at exactly 2 d is still
seen. All numbers are integers, so that sums, means and ties are exact and don't depend on how rows are dealt.

A round is a map over the vectors, which are written with their assignment, and one sum per cluster. Only the centroids
pass through the driver: k rows, whatever the number of vectors. Nothing is shuffled but partial sums of clusters.

Vectors that are null, of another length, or hold null or non-finite components are left out. Integer components beyond
2**26 count as that bound, so that squared distances fit into a long. Repeated rows count as often as they occur. Rows
without a vec_id are clustered but start no centroid. With fewer vectors than k there are as many centroids; ties go to
the smaller number. An empty table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, schema

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2
#: Largest absolute integer component; below EXACT all arithmetic is exact in doubles, too.
LARGEST = 1 << 26
EXACT = 1 << 20


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by squared distance (ties by number), and these distances."""
    gaps = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids])
    order = np.argsort(gaps, axis=1, kind="stable")
    others = np.array([row[row != i] for i, row in enumerate(order)]).reshape(len(centroids), -1)
    return others, np.take_along_axis(gaps, others, axis=1)


def assign(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, others: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each integer vector, and how many distances that took."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        vectors, centroids, gaps = (x.astype(np.float64) for x in (vectors, centroids, gaps))
    clusters, distances, looked = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64), 0
    norms = np.einsum("ij,ij->i", centroids, centroids)
    for start in np.unique(before).tolist():
        mine = np.flatnonzero(before == start)
        rows = vectors[mine]
        own = np.einsum("ij,ij->i", rows, rows)
        first = own + norms[start] - 2 * (rows @ centroids[start])
        far = np.argsort(-first, kind="stable")  # the furthest first: who still scans is a prefix
        mine, rows, own, first = mine[far], rows[far], own[far], first[far]
        best, who = first.copy(), np.full(len(mine), start, np.int32)
        looked += len(mine)
        for other, gap in zip(others[start].tolist(), gaps[start]):
            live = int(np.searchsorted(-4 * first, -gap, side="right"))
            if not live:
                break
            looked += live
            found = own[:live] + norms[other] - 2 * (rows[:live] @ centroids[other])
            nearer = (found < best[:live]) | ((found == best[:live]) & (other < who[:live]))
            best[:live][nearer], who[:live][nearer] = found[nearer], other
        clusters[mine], distances[mine] = who, best.astype(np.int64)
    return clusters, distances, looked


def _assigned(rows: DataFrame, centroids: np.ndarray, last: bool) -> DataFrame:
    """rows (vec_id, v, cluster) with their clusters by these centroids; the last time with distances in place of vectors."""
    others, gaps = neighbours(centroids)
    k, dim = centroids.shape

    def run(batches):
        for batch in batches:
            vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)
            clusters, distances, _ = assign(vectors, batch.column("cluster").to_numpy(), centroids, others, gaps)
            found = {"vec_id": batch.column("vec_id")} | ({"distance": pa.array(distances)} if last else {"v": batch.column("v")})
            yield pa.RecordBatch.from_pydict(found | {"cluster": pa.array(clusters)})

    return rows.mapInArrow(run, schema("vec_id long, distance long, cluster int" if last else "vec_id long, v array<int>, cluster int"))


def sort_means(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector of rows (vec_id, embedding), and the centroids.

    Vectors become integers, floor(scale * x). The first centroids are the vectors with the smallest sha256 of
    ``seed:vec_id``; a round assigns all vectors and moves each centroid that has any to the floor of their mean.
    """
    scratch = Scratch(rows.sparkSession, "centroids")
    wide = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = (F.size("e") == dimensions) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.least(scale * x, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    now = scratch.keep(wide.where(F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("v"), F.lit(0).alias("cluster")), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = now.where("vec_id IS NOT NULL").orderBy(digest, "v").limit(clusters).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return now.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")).limit(0), []
    for _ in range(rounds):
        after = scratch.keep(_assigned(now, centroids, False), "round")
        scratch.drop(now)
        now = after
        sums = now.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dimensions))).collect()
        for r in sums:
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dimensions)]
    out = scratch.keep(_assigned(now, centroids, True), "clusters")
    scratch.drop(now)
    return out.select("vec_id", "cluster", "distance"), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignments with the sum of distances of their cluster and of all, and each centroid's digest; one row per cluster is broadcast."""
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = assigned.agg(F.sum("distance").alias("inertia"))
    each = sums.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").join(F.broadcast(total))
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

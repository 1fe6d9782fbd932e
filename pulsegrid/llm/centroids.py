"""Clustering of integer vectors by centroids, with partial-distance search.

A vector's components are floor(64 * x). A round sends the centroids (``k`` by 64 integers,
whatever the size of the table) to the tasks; each batch adds squared differences up a block
of components at a time, those of high variance first, and drops a centroid for a vector as
soon as its sum is strictly above the vector's best distance. What is left after all 64
components is that centroid's exact distance. Batches return sums and counts by cluster, which
Spark adds up; only one row per centroid reaches the driver. The prepared vectors and the last
assignment are tables in the shared folder, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import fresh_dir

DIMENSIONS = 64
#: Components per step of the search.
BLOCK = 8
#: Integer components are below this, so that a squared distance fits in 63 bits.
COMPONENT_LIMIT = 1 << 27
#: Vectors that are compared at a time.
BATCH_ROWS = 8192


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, x): vectors of exactly 64 components, none null or non-finite, as integers.

    A null vector and one of another length go. A component at or beyond ``COMPONENT_LIMIT``
    raises, for its distances would not fit in a long. Null and repeated ids stay, row by row;
    other columns, whatever their names, are not read.
    """
    v = F.col("v")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    whole = F.transform(v, lambda e: F.floor(e * 64.0))
    fits = F.forall(v, lambda e: F.abs(e * 64.0) < float(COMPONENT_LIMIT))
    rows = vectors.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == DIMENSIONS) & ~F.exists("v", bad))
    return rows.select(id_col, F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component of 64 * x is {COMPONENT_LIMIT} or more"))).alias("x"))


def nearest(x: np.ndarray, centers: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance) of each row of ``x``; ties: the smaller number.

    Columns of both must be in the order in which they are to be searched.
    """
    which = np.zeros(len(x), np.int64)
    best = ((x - centers[0]) ** 2).sum(axis=1)
    for c in range(1, len(centers)):
        alive, partial = np.arange(len(x)), np.zeros(len(x), np.int64)
        for lo in range(0, x.shape[1], block):
            partial = partial + ((x[alive, lo : lo + block] - centers[c, lo : lo + block]) ** 2).sum(axis=1)
            stays = partial <= best[alive]
            alive, partial = alive[stays], partial[stays]
            if not alive.size:
                break
        closer = partial < best[alive]
        which[alive[closer]], best[alive[closer]] = c, partial[closer]
    return which, best


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            part = b.slice(at, BATCH_ROWS)
            yield part, part.column("x").flatten().to_numpy().reshape(-1, DIMENSIONS)


def _sums(vectors: DataFrame, centers: np.ndarray, order: np.ndarray) -> DataFrame:
    """(cluster, n, s): by batch and cluster, the count and the componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches):
            which, _ = nearest(x[:, order], centers[:, order])
            found, n = np.unique(which, return_counts=True)
            s = np.add.reduceat(x[np.argsort(which, kind="stable")], np.r_[0, np.cumsum(n)[:-1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), pa.array(list(s), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return vectors.select("x").mapInArrow(run, "cluster long, n long, s array<long>")


def _assigned(vectors: DataFrame, centers: np.ndarray, order: np.ndarray, id_col: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches):
            which, d = nearest(x[:, order], centers[:, order])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(which.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), "x").mapInArrow(run, f"id {kind}, cluster int, distance long")


def _exact(c: Column) -> Column:
    """A sum that no table can make overflow."""
    return F.sum(c.cast("decimal(19,0)"))


def _variance_order(vectors: DataFrame) -> np.ndarray:
    """The components, that of the highest variance first: two moments each, in one aggregation."""
    row = vectors.agg(*[F.var_pop(F.get("x", F.lit(i)).cast("double")).alias(f"v{i}") for i in range(DIMENSIONS)]).first()
    return np.argsort(-np.array([v or 0.0 for v in row]), kind="stable")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id_col, cluster, distance) of every kept vector, the final centroids).

    Centroids start as the ``k`` kept vectors of the smallest sha256 of ``seed:id``, in that
    order (null ids last, equal hashes by components); of fewer vectors each is one. A round
    moves each non-empty centroid to the exact floor of its vectors' mean; an empty one stays.

    * null vectors and those with null or non-finite components or another length are left out
    * null and repeated ids: a result row for each row; ties go to the smaller centroid number
    * an empty table (or one with no kept vector): no rows and no centroids
    * vectors have a fixed length, so no row is long; extra columns are not read
    """
    spark = vectors.sparkSession
    folder = fresh_dir(spark, "vectors")
    kept_vectors(vectors, id_col, vector_col).write.parquet(folder)
    kept = spark.read.parquet(folder)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    start = kept.select(digest.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not start:
        return kept.select(id_col, F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    centers, order = np.array([r.x for r in start], np.int64), _variance_order(kept)
    for _ in range(rounds):
        rows = _sums(kept, centers, order).groupBy("cluster").agg(_exact(F.col("n")).alias("n"), *[_exact(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(DIMENSIONS)])
        for r in rows.collect():
            centers[r.cluster] = [int(r[f"s{i}"]) // int(r.n) for i in range(DIMENSIONS)]
    done = fresh_dir(spark, "assigned")
    _assigned(kept, centers, order, id_col).write.parquet(done)
    return spark.read.parquet(done).withColumnRenamed("id", id_col), centers.tolist()


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``clusters`` with each cluster's inertia, that of all, and the digest of the final centroid.

    Null, tied, repeated and missing rows are as in ``clusters``.
    """
    rows, centers = clusters(vectors, k, rounds, seed, id_col, vector_col)
    if not centers:
        nothing = F.lit(0).cast("long")
        return rows.select("*", nothing.alias("cluster_inertia"), nothing.alias("inertia"), F.lit("").alias("centroid_sha256"))
    own = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(_exact(F.col("distance")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    by_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return rows.select(
        "*",
        by_cluster([own.get(c, 0) for c in range(len(centers))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(own.values())).cast("long").alias("inertia"),
        by_cluster(digests).alias("centroid_sha256"),
    )

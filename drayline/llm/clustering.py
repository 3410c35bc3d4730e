"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, and a block of vectors keeps, for each dimension, the integers that occur in it and for each
component the place of its integer among them. A round tabulates, once per block, the squared difference of every
occurring integer of every dimension to every centroid's component; the distance of a vector to a centroid is then
a sum of table entries, one gather per dimension. All arithmetic is exact in 64-bit integers.

The blocks are written once and each round reads them: it returns sums and counts of the clusters, one row a cluster
and task, which Spark adds up. Only centroids (``clusters`` times ``dimensions`` numbers) pass through the driver.

Vectors with a NULL, a missing, non-finite or surplus component, or that are NULL, are left out. Repeated rows count as
often as they stand. A NULL vec_id is clustered like any other and comes last in the choice of the first centroids; among
repeated ids the smaller vector comes first. Fewer vectors than clusters give as many clusters; none give no rows.
Components whose squared distances could leave 64 bits (a spread of about 2^28 after scaling, in 64 dimensions) raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.session import workspace

BLOCK_ROWS = 2048
#: Integers beyond this are not exact as doubles, from which they come.
WIDEST = 1 << 53
BLOCKS = "vec_id array<long>, levels array<long>, level_bounds array<int>, places binary"
ASSIGNED = "vec_id long, cluster int, distance long"


def integer_components(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has all its components and each is a finite number; never NULL."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def integer_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, vector): the usable vectors as integers."""
    embedding = F.col("embedding")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding).where(usable(embedding, dimensions))
    return kept.select("vec_id", integer_components(embedding, scale).alias("vector"))


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hash of their id; a top-k, so each task sends as many rows."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select(order.alias("order"), "vector").orderBy(F.asc_nulls_last("order"), "vector").limit(clusters)
    return np.array([r.vector for r in chosen.collect()], dtype=np.int64)


def _blocks(dimensions: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimensions)
                levels, places, bounds = [], np.empty(values.shape, dtype=np.int32), [0]
                for d in range(dimensions):
                    occurring, where = np.unique(values[:, d], return_inverse=True)
                    places[:, d] = where + bounds[-1]
                    levels.append(occurring)
                    bounds.append(bounds[-1] + len(occurring))
                columns = [part.column(0).to_pylist()], [np.concatenate(levels)], [bounds], [places.tobytes()]
                types = pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], ["vec_id", "levels", "level_bounds", "places"])

    return run


def _nearest(block: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and distance of a block's vectors by table look-ups; also its levels and places. Ties fall to the smaller number."""
    levels, bounds = block["levels"], block["level_bounds"]
    dimensions = len(bounds) - 1
    places = np.frombuffer(block["places"], dtype=np.int32).reshape(-1, dimensions)
    dimension_of = np.repeat(np.arange(dimensions), np.diff(bounds))
    apart = levels[:, None].astype(np.float64) - centroids[:, dimension_of].T
    if (np.abs(apart).max(initial=0) ** 2) * dimensions >= 2.0**63:
        raise OverflowError("squared distances of these vectors do not fit in 64 bits; scale them down")
    table = (levels[:, None] - centroids[:, dimension_of].T) ** 2
    distances = np.zeros((len(places), len(centroids)), dtype=np.int64)
    for d in range(dimensions):
        distances += table[places[:, d]]
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(places)), cluster], levels, places


def _each_block(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {
                "vec_id": batch.column(0)[row].values,
                "levels": batch.column(1)[row].values.to_numpy(zero_copy_only=False),
                "level_bounds": batch.column(2)[row].values.to_numpy(zero_copy_only=False),
                "places": batch.column(3)[row].as_buffer(),
            }


def _sums(centroids: np.ndarray):
    """A task's clusters: size, and sum of every component, as whole numbers in text (they may outgrow 64 bits in all)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums = [0] * len(centroids), np.zeros(centroids.shape, dtype=object)
        for block in _each_block(batches):
            cluster, _, levels, places = _nearest(block, centroids)
            for c in np.unique(cluster):
                members = places[cluster == c]
                sizes[c] += len(members)
                sums[c] += levels[members].sum(axis=0)
        rows = [c for c, n in enumerate(sizes) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, type=pa.int32()), pa.array([sizes[c] for c in rows], type=pa.int64()), pa.array([[str(x) for x in sums[c]] for c in rows], type=pa.list_(pa.string()))],
            ["cluster", "size", "sums"],
        )

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each_block(batches):
            cluster, distance, _, _ = _nearest(block, centroids)
            yield pa.RecordBatch.from_arrays(
                [block["vec_id"], pa.array(cluster, type=pa.int32()), pa.array(distance, type=pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return run


def moved_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors stays. Spark adds up a row per cluster and task."""
    partial = blocks.mapInArrow(_sums(centroids), "cluster int, size long, sums array<string>")
    by_component = partial.select("cluster", "size", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
    moved = centroids.copy()
    for r in by_component.agg(F.sum("size").alias("size"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        moved[r.cluster, r.d] = int(r.s) // r.size
    return moved


def cluster(
    spark: SparkSession, vectors: DataFrame, clusters: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: str = "3:"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector after ``rounds`` rounds and a last assignment, and the centroids."""
    path = workspace(spark, "vector-blocks")
    integers = integer_vectors(vectors, dimensions, scale)
    too_wide = F.exists("vector", lambda x: (x > F.lit(WIDEST)) | (x < F.lit(-WIDEST)))
    checked = integers.select("vec_id", F.when(too_wide, F.raise_error(F.lit("a component is too large to be exact"))).otherwise(F.col("vector")).alias("vector"))
    checked.mapInArrow(_blocks(dimensions), BLOCKS).write.parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    centroids = first_centroids(integers, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], T.StructType.fromDDL(ASSIGNED)), centroids
    for _ in range(rounds):
        moved = moved_centroids(blocks, centroids)
        if np.array_equal(moved, centroids):  # every later round would give the same
            break
        centroids = moved
    return blocks.mapInArrow(_assign(centroids), ASSIGNED), centroids


def with_inertia(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the distance summed over the cluster and over all, and the hash of the cluster's centroid. The sums come from one
    aggregate of a row a cluster and task; they join as literals, at most one a cluster."""
    path = workspace(spark, "assigned")
    assigned.write.parquet(path)
    written = spark.read.schema(ASSIGNED).parquet(path)
    inertia = {r.cluster: int(r.inertia) for r in written.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values: dict, kind: str) -> Column:
        pairs = [F.lit(x) for c, v in sorted(values.items()) for x in (c, v)]
        return (F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(None)).cast(kind)

    return written.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster(dict(enumerate(digests)), "string").alias("centroid_sha256"),
    )

"""Centroid clustering by dimension-sharded Lloyd rounds.

Vectors are cut twice: by rows into chunks, by components into column blocks (shards). A written table
holds one packed row for each chunk and shard. In every round

1. a task meets a shard's rows with the slice of the centroids that belongs to that shard, and gets the
   exact partial squared distances of all vectors of the chunk to all centroids;
2. the partial distances of a chunk are dealt by chunk, added up over the shards, and the least total
   (ties: the smaller number) names each vector's cluster;
3. the shards' rows meet these clusters again; each task adds up its components by cluster, and each
   shard divides its own sums into its next slice.

No task sees whole vectors. The slices are the only thing that leaves the tasks: centroids x components
integers, bounded by the parameters and not by the data; they are handed to the next round by broadcast.
All sums are integers, so the result does not depend on the order of tasks or retries. No key is hot:
a chunk has as many rows as there are shards, and a cluster with most of the vectors is one partial sum
for each task.

Defined cases: rows whose vector is null, has another number of components, or holds a null or a
non-finite one are left out. Repeated rows count each and give a row each. A null id is kept; it becomes
a first centroid only after all others. Rows that are equal in id (so in hash) become first centroids in
the order of their components. With fewer vectors than centroids there are fewer centroids. An empty
table gives an empty result. Other columns are ignored. A component of 2**27 or more after scaling stops
the job with an error: its squared distances would not fit the 64-bit result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numberboard.llm.frames import spread, written

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Components of one shard.
SHARD_WIDTH = 32
#: Vectors of one chunk.
CHUNK_ROWS = 1024
#: Scaled components stay below this, so that squared distances over DIMENSIONS fit 64 bits.
LARGEST = 1 << 27
SHARDS_SCHEMA = "chunk long, shard int, rows int, width int, data binary, ids array<long>"


@dataclass(frozen=True)
class Lloyd:
    """Parameters: ``seed`` and the id, joined by a colon, are hashed to choose the first centroids."""

    dimensions: int = DIMENSIONS
    scale: int = SCALE
    centroids: int = CENTROIDS
    rounds: int = ROUNDS
    seed: str = "1"
    shard_width: int = SHARD_WIDTH
    chunk_rows: int = CHUNK_ROWS

    @property
    def bounds(self) -> list[tuple[int, int]]:
        """First and last component (exclusive) of every shard."""
        return [(a, min(a + self.shard_width, self.dimensions)) for a in range(0, self.dimensions, self.shard_width)]


def packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them; the type's size is the first byte."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    size = next(s for s in (1, 2, 4, 8) if -(1 << (8 * s - 1)) <= low and high < 1 << (8 * s - 1))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def kept_vectors(vectors: DataFrame, lloyd: Lloyd) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that count."""
    held = F.col("embedding").cast("array<double>")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("embedding")).where(
        (F.size("embedding") == lloyd.dimensions) & whole
    )


def first_centroids(kept: DataFrame, lloyd: Lloyd) -> np.ndarray:
    """The scaled vectors with the smallest hashes: at most ``centroids`` rows reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{lloyd.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.orderBy(name.asc_nulls_last(), "embedding").limit(lloyd.centroids).collect()
    return scaled(np.array([r["embedding"] for r in rows], float).reshape(-1, lloyd.dimensions), lloyd)


def scaled(x: np.ndarray, lloyd: Lloyd) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(lloyd.scale * x)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling; its squared distances don't fit 64 bits")
    return x.astype(np.int64)


def shard_table(kept: DataFrame, lloyd: Lloyd) -> DataFrame:
    """Written table: a packed row for each chunk of vectors and each shard; the ids stand with the first shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, lloyd.chunk_rows):
                part = batch.slice(at, lloyd.chunk_rows)
                x = scaled(part.column("embedding").flatten().to_numpy().reshape(-1, lloyd.dimensions), lloyd)
                ids = part.column("vec_id").to_pylist()
                rows = [(chunk, k, len(x), b - a, packed(x[:, a:b]), ids if k == 0 else None) for k, (a, b) in enumerate(lloyd.bounds)]
                chunk += 1
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                names = [f.split()[0] for f in SHARDS_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return written(kept.select("vec_id", "embedding").mapInArrow(cut, SHARDS_SCHEMA), "lloyd-shards")


def nearest(shards: DataFrame, centroids: np.ndarray, lloyd: Lloyd, parts: int) -> DataFrame:
    """(chunk, clusters, distances), packed, of every chunk: partial distances by shard, added by chunk."""
    spark, k = shards.sparkSession, len(centroids)
    slices = spark.sparkContext.broadcast([centroids[:, a:b] for a, b in lloyd.bounds])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("chunk", "shard", "rows", "width", "data"))
            for chunk, shard, rows, width, data in zip(*columns):
                x, c = unpacked(data).reshape(rows, width), slices.value[shard]
                apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([shard], pa.int32()), pa.array([packed(apart)])], ["chunk", "shard", "partial"]
                )

    def closed(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        total = total.reshape(-1, k)
        best = total.argmin(axis=1)
        least = total[np.arange(len(total)), best]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.array([packed(best)]), pa.array([packed(least)])], ["chunk", "clusters", "distances"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("partial").to_pylist()):
                if chunk == now:
                    total += unpacked(data)
                    continue
                if now is not None:
                    yield closed(now, total)
                now, total = chunk, unpacked(data)
        if now is not None:
            yield closed(now, total)

    partials = shards.select("chunk", "shard", "rows", "width", "data").mapInArrow(partial, "chunk long, shard int, partial binary")
    dealt = partials.repartition(parts, "chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(add, "chunk long, clusters binary, distances binary")


def moved(shards: DataFrame, assigned: DataFrame, centroids: np.ndarray, lloyd: Lloyd) -> np.ndarray:
    """The next centroids: each shard divides the sums of its own components by the clusters' sizes."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # of each shard: sums by cluster, the cluster's size last
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "rows", "width", "data", "clusters"))
            for shard, rows, width, data, clusters in zip(*columns):
                x = np.hstack((unpacked(data).reshape(rows, width), np.ones((rows, 1), np.int64)))
                total = held.setdefault(shard, np.zeros((k, width + 1), np.int64))
                np.add.at(total, unpacked(clusters), x)
        rows = [(s, c, t[c].tolist()) for s, t in held.items() for c in range(k) if t[c, -1]]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()))
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "cluster", "sums"])

    met = shards.select("chunk", "shard", "rows", "width", "data").join(assigned.select("chunk", "clusters"), "chunk")
    added = met.select("shard", "rows", "width", "data", "clusters").mapInArrow(sums, "shard int, cluster int, sums array<long>")
    places = added.select("shard", "cluster", F.posexplode("sums").alias("place", "v"))
    totals = places.groupBy("shard", "cluster", "place").agg(F.sum("v").alias("v"))
    out = centroids.copy()
    slices = totals.groupBy("shard", "cluster").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("v"))
    for shard, cluster, v in slices.collect():  # centroids x components integers
        a, b = lloyd.bounds[shard]
        out[cluster, a:b] = [v[i] // v[b - a] for i in range(b - a)]
    return out


def cluster(vectors: DataFrame, lloyd: Lloyd | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, and the final centroids."""
    lloyd = lloyd or Lloyd()
    kept = kept_vectors(vectors, lloyd)
    centroids = first_centroids(kept, lloyd)
    shards = shard_table(kept, lloyd)
    ids = shards.where("shard = 0").select("chunk", "ids")
    parts = spread(vectors)
    if not len(centroids):
        return ids.select(F.explode("ids").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(lloyd.rounds):
        centroids = moved(shards, nearest(shards, centroids, lloyd, parts), centroids, lloyd)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names = batch.column("ids")[k].values
                clusters, distances = (unpacked(batch.column(c)[k].as_py()) for c in ("clusters", "distances"))
                columns = [names, pa.array(clusters.astype(np.int32)), pa.array(distances)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    last = nearest(shards, centroids, lloyd, parts).join(ids, "chunk")
    return last.mapInArrow(rows, "vec_id long, cluster int, distance long"), centroids


def cluster_vectors(vectors: DataFrame, lloyd: Lloyd | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, lloyd)
    found = written(found, "lloyd-clusters")
    named = spark.createDataFrame([(k, ",".join(map(str, c))) for k, c in enumerate(centroids.tolist())], "cluster int, numbers string")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    sums = by_cluster.agg(F.sum("total").cast("long").alias("inertia"))
    by_cluster = by_cluster.join(named, "cluster").select(  # a row for each centroid: safe to broadcast
        "cluster",
        F.col("total").cast("long").alias("cluster_inertia"),
        sums.scalar().alias("inertia"),
        F.sha2(F.col("numbers").cast("binary"), 256).alias("centroid_sha256"),
    )
    return found.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

"""Clusters of vectors by k-means, with bounds in heaps: a round looks again only at vectors that may have changed sides.

When a vector is assigned, the gap between its distance to its own centroid and that to the second nearest tells how far centroids
may move before another could be nearer. In a round, a cluster spends what its own centroid moved and the most that any other did. A vector
expires once its cluster has spent its gap since it was assigned, so a heap of gaps, each plus what the cluster had spent until then,
has the expired on top: these are popped and compared with all centroids again, exactly, and no other vector is touched.

Vectors lie in blocks of a fixed number, a row each, with a heap for each cluster. A round is a map over the blocks, without an exchange: it writes them
with their heaps, and what moved from each cluster to another, as sums. Only the centroids and these sums, added up, go
through the driver: as many numbers as there are clusters, times the components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a block; numbers that a step of comparing holds at once.
BLOCK, HELD = 8192, 1 << 20
#: Whole components of a larger amount have distances that may not fit 64 bits.
LARGEST = 1 << 27
#: Of a bound's size, what rounding may take from it.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, x): the rows whose vector has exactly ``components`` components, none null or non-finite, each as floor(scale * component)."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(vector.isNotNull() & (F.size(vector) == components) & fine)
    return kept.select(F.col(f"`{id_col}`").alias("id"), F.transform(vector, lambda v: F.floor(scale * v)).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, salt: str = "1:") -> np.ndarray:
    """The vectors with the least hashes of their ids, in that order; a null id comes last, equal ids go by their vectors."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    top = vectors.orderBy(F.col("id").isNull(), hashed, "x").limit(clusters).collect()
    return np.array([r["x"] for r in top], np.int64)


def _top(x: np.ndarray) -> int:
    """The largest amount; an amount of -2**63 isn't an integer of 64 bits."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of whole vectors, exact."""
    top = max(_top(x), _top(centroids))
    if x.shape[1] * (2 * top) ** 2 < 1 << 52:  # products of these are exact as floating-point numbers
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for c, center in enumerate(centroids.astype(np.int64)):
        out[:, c] = ((x.astype(np.int64) - center) ** 2).sum(axis=1)
    return out


class Block:
    """Vectors of a block, the cluster of each (-1: none yet), its key, and for each cluster a heap of (key, vector)."""

    def __init__(self, x: np.ndarray, own: np.ndarray, keys: np.ndarray, heaps: list[list[tuple[float, int]]]) -> None:
        self.x, self.own, self.keys, self.heaps = x, own, keys, heaps

    def expired(self, spent: np.ndarray) -> np.ndarray:
        """Pops the vectors whose cluster has spent their gap."""
        out = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= spent[c]:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def assigned(self, centroids: np.ndarray, spent: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compares ``some`` vectors with all centroids and pushes them on their clusters' heaps; (sums, counts) of what each cluster gained."""
        k = len(centroids)
        sums, counts = np.zeros((k, self.x.shape[1]), np.int64), np.zeros(k, np.int64)
        step = max(1, HELD // (k * self.x.shape[1]))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            x, before = self.x[part].astype(np.int64), self.own[part]
            apart = distances(x, centroids)
            now = apart.argmin(axis=1)  # of equal ones the least number
            near = np.sqrt(apart[np.arange(len(part)), now].astype(np.float64))
            apart[np.arange(len(part)), now] = np.iinfo(np.int64).max
            second = np.sqrt(apart.min(axis=1).astype(np.float64)) if k > 1 else np.full(len(part), np.inf)
            keys = second - near + spent[now]
            if k > 1:
                keys -= SLACK * (second + near + spent[now] + 1)
            for i, c, key in zip(part.tolist(), now.tolist(), keys.tolist()):
                heapq.heappush(self.heaps[c], (key, i))
            moved = now != before
            left = moved & (before >= 0)
            np.add.at(sums, now[moved], x[moved])
            np.subtract.at(sums, before[left], x[left])
            counts += np.bincount(now[moved], minlength=k) - np.bincount(before[left], minlength=k)
            self.own[part], self.keys[part] = now, keys
        return sums, counts

    def row(self) -> tuple[bytes, bytes, bytes, bytes]:
        """``own``, keys, the heaps' vectors one heap after the other, and the heaps' sizes."""
        order = np.array([i for heap in self.heaps for _, i in heap], np.int32)
        return self.own.tobytes(), self.keys.tobytes(), order.tobytes(), np.array([len(h) for h in self.heaps], np.int32).tobytes()

    @staticmethod
    def of(x: np.ndarray, own: bytes, keys: bytes, order: bytes, sizes: bytes) -> Block:
        key, at = np.frombuffer(keys, np.float64).copy(), 0
        vectors, heaps = np.frombuffer(order, np.int32).tolist(), []
        for size in np.frombuffer(sizes, np.int32).tolist():
            heaps.append([(float(key[i]), i) for i in vectors[at : at + size]])
            at += size
        return Block(x, np.frombuffer(own, np.int32).copy(), key, heaps)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the least bytes."""
    top = _top(x)
    if top > LARGEST:
        raise ValueError(f"a component is {top} as a whole number; more than {LARGEST} isn't supported")
    return x.astype(np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int32)


_FIELDS = "ids array<{}>, width int, x binary, own binary, keys binary, heap binary, sizes binary, sums array<bigint>, counts array<bigint>"


def _row(ids: pa.Array, block: Block, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    binary = [pa.array([v], pa.binary()) for v in (block.x.tobytes(), *block.row())]
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([block.x.itemsize], pa.int32()), *binary, pa.array([sums.ravel()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["ids", "width", "x", "own", "keys", "heap", "sizes", "sums", "counts"])


def _vectors(width: int, x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"<i{width}").reshape(n, -1)


def _begun(vectors: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """The blocks of ``vectors``, each vector assigned."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            x = _narrow(table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
            n, k = len(x), len(centroids)
            own = Block(x, np.full(n, -1, np.int32), np.zeros(n), [[] for _ in range(k)])
            return _row(table.column("id").combine_chunks(), own, *own.assigned(centroids, np.zeros(k), np.arange(n)))

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - sum(b.num_rows for b in waiting))
                waiting.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in waiting) == block:
                    yield made(waiting)
                    waiting = []
        if waiting:
            yield made(waiting)

    return vectors.mapInArrow(of, _FIELDS.format(id_type))


def _round(blocks: DataFrame, centroids: np.ndarray, spent: np.ndarray) -> DataFrame:
    """``blocks`` after their expired vectors are assigned anew."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                width, x, *rest = (batch.column(c)[i].as_py() for c in ("width", "x", "own", "keys", "heap", "sizes"))
                block = Block.of(_vectors(width, x, len(ids)), *rest)
                yield _row(ids, block, *block.assigned(centroids, spent, block.expired(spent)))

    return blocks.mapInArrow(of, _FIELDS.format(blocks.schema["ids"].dataType.elementType.simpleString()))


def _added(blocks: DataFrame, k: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """What all blocks gained: a row for each component of each cluster, and for each cluster, comes to the driver."""

    def total(name: str, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for r in blocks.select(F.posexplode(name)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
            out[r["pos"]] = r["n"]
        return out

    return total("sums", k * components).reshape(k, components), total("counts", k)


def clustered(
    rows: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) for each kept vector, the last centroids): k-means over whole vectors.

    Rows whose vector is null, of another length, or has a null or non-finite component are left out. Repeated rows count as often as they
    stand there. Fewer vectors than clusters make fewer clusters; a table without any gives an empty table. A null id stays null.
    Other columns are left out, whatever their names. Components beyond 2**27 as whole numbers are an error.
    """
    vectors = whole_vectors(rows, id_col, vector_col, components, scale)
    centroids = first_centroids(vectors, clusters)
    k = len(centroids)
    id_type = vectors.schema["id"].dataType.simpleString()
    if not k:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    _narrow(centroids)
    blocks, spent = written(_begun(vectors, centroids, block), "blocks"), np.zeros(k)
    sums, counts = _added(blocks, k, components)
    for _ in range(rounds):
        some = counts > 0
        moved = centroids.copy()
        moved[some] = sums[some] // counts[some][:, None]
        drift = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        centroids = moved
        spent = spent + drift + [np.delete(drift, c).max(initial=0) for c in range(k)]
        blocks = written(_round(blocks, centroids, spent), "blocks")
        more, gained = _added(blocks, k, components)
        sums, counts = sums + more, counts + gained

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                x, own = _vectors(batch.column("width")[i].as_py(), batch.column("x")[i].as_py(), len(ids)), np.frombuffer(batch.column("own")[i].as_py(), np.int32)
                apart = ((x.astype(np.int64) - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(apart)], names=["id", "cluster", "distance"])

    return blocks.select("ids", "width", "x", "own").mapInArrow(of, f"id {id_type}, cluster int, distance bigint"), centroids


def digest(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Each vector's cluster and distance, the sums of distances over its cluster and over all, and the hash of its centroid's components."""
    found, centroids = clustered(rows, id_col, vector_col)
    found = written(found, "clustered")
    sums = dict(found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect())  # a row for each cluster, as in what follows
    told = [(c, n, sum(sums.values()), ",".join(map(str, centroids[c].tolist()))) for c, n in sums.items()]
    of = rows.sparkSession.createDataFrame(told, "of int, cluster_inertia bigint, inertia bigint, centroid string")
    joined = found.join(F.broadcast(of), F.col("cluster") == F.col("of"))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))

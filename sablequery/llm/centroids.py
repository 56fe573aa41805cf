"""Centroid clustering over a VA-file.

Vectors are whole numbers, floor(64 * x) of each component. Beside each stands its approximation: of every dimension one
of 16 cells (4 bits), whose edges come from the corpus's mean, deviation, least and greatest value of that dimension. For
a set of centroids, a table gives the least and the greatest squared distance that a pair of cells can have to each of
them; sums over the tables give every vector an interval for every centroid. Where one interval lies below all others
the nearest centroid is known without the vector. The others' full vectors are fetched by row number and compared with
those centroids only whose intervals overlap the best.

Sums of clusters are kept exactly: the first round reads every vector, a later one fetches those whose centroid changed
or may have changed, and moves them from one sum to the other. What reaches the driver is one row a dimension or a
centroid and dimension.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out; components
beyond 2**27 either way count as that, so that a squared distance fits a long; a null vec_id hashes as the empty text and
keeps its row; repeated rows are clustered each, and of equal hashes the smaller vector is the earlier seed; fewer vectors
than centroids give fewer centroids, none give no rows; ties go to the smaller centroid; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CENTROIDS, DIMENSIONS, ROUNDS, SCALE = 16, 64, 3, 64.0
CELLS = 16
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, v: whole components of every vector that can be compared."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = (F.size("embedding") == dimensions) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * F.lit(SCALE), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("v"))


def seeds(rows: DataFrame, k: int = CENTROIDS, salt: int = 1) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return np.array([r["v"] for r in rows.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()], "int64")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(-1, dimensions)


def cell_edges(rows: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Of each dimension the first value of every cell, and one more than the greatest value; a normal law fills cells evenly."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        least, most = np.full(dimensions, LARGEST), np.full(dimensions, -LARGEST)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), dimensions)
                n, total, squares = n + len(v), total + v.sum(axis=0), squares + (v.astype("float64") ** 2).sum(axis=0)
                least, most = np.minimum(least, v.min(axis=0)), np.maximum(most, v.max(axis=0))
        if n:
            yield pa.record_batch({"d": pa.array(range(dimensions), pa.int32()), "n": pa.array([n] * dimensions), "total": pa.array(total), "squares": pa.array(squares), "least": pa.array(least, pa.int64()), "most": pa.array(most, pa.int64())})

    parts = rows.select("v").mapInArrow(measure, "d int, n long, total double, squares double, least long, most long")
    found = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()
    n, total, squares, least, most = (np.array([r[c] for r in found], "float64") for c in ("n", "total", "squares", "least", "most"))
    spread = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    inner = [np.ceil(total / n + spread * NormalDist().inv_cdf(k / CELLS)) for k in range(1, CELLS)]
    return np.clip(np.stack([least, *inner, most + 1], axis=1), least[:, None], most[:, None] + 1).astype("int64")


def approximations(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Two dimensions' cells in a byte."""
    cells = np.stack([np.searchsorted(edges[d, 1:-1], v[:, d], side="right") for d in range(v.shape[1])], axis=1)
    return (cells[:, 0::2] << 4 | cells[:, 1::2]).astype("uint8")


def build(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """The VA-file: row, vec_id, cells, v, stored, so that row numbers stay and each scan reads only its columns."""
    dimensions = len(edges)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cells", pa.array([c.tobytes() for c in approximations(_matrix(batch.column(2), dimensions), edges)], pa.binary()))

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    return stored(numbered.mapInArrow(add, "row long, vec_id long, v array<int>, cells binary"), "va-file")


class Intervals:
    """Distance intervals of approximations to a set of centroids, by tables over bytes of two cells."""

    def __init__(self, centroids: np.ndarray, edges: np.ndarray):
        self.centroids = centroids
        low, high = edges[:, :-1][None], edges[:, 1:][None] - 1
        c = centroids[:, :, None]
        ends = np.stack([(c - low) ** 2, (c - high) ** 2])
        least, most = np.where((low <= c) & (c <= high), 0, ends.min(axis=0)), ends.max(axis=0)
        both = np.concatenate([least, most]).transpose(1, 2, 0)  # dimension, cell, centroid's least and most
        self.tables = (both[0::2, :, None, :] + both[1::2, None, :, :]).reshape(len(edges) // 2, CELLS * CELLS, -1)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which centroids each vector may be nearest to."""
        total = np.zeros((len(cells), 2 * len(self.centroids)), "int64")
        for at, table in enumerate(self.tables):
            total += table[cells[:, at]]
        least, most = np.split(total, 2, axis=1)
        return least <= most.min(axis=1, keepdims=True)

    def nearest(self, may: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector; distances only to the candidates of vectors that have several."""
        found, several = may.argmax(axis=1), np.flatnonzero(may.sum(axis=1) > 1)
        distance = np.full((len(several), len(self.centroids)), np.iinfo("int64").max)
        for c, centroid in enumerate(self.centroids):
            own = np.flatnonzero(may[several, c])
            distance[own, c] = ((v[several[own]] - centroid) ** 2).sum(axis=1)
        found[several] = distance.argmin(axis=1)
        return found


def _cells(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "uint8").reshape(len(column), -1)


def _cluster_sums(rows: DataFrame, k: int, dimensions: int, moves: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of clusters over rows; ``moves`` gives clusters, vectors and a sign. A task sends one row a centroid and dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dimensions + 1), "int64")
        for batch in batches:
            if batch.num_rows:
                for cluster, v, sign in moves(batch):
                    sums[:, 0] += sign * np.bincount(cluster, minlength=k)
                    for c in np.unique(cluster):
                        sums[c, 1:] += sign * v[cluster == c].sum(axis=0)
        if sums.any():
            place = np.arange(sums.size)
            yield pa.record_batch({"place": pa.array(place), "part": pa.array(sums.ravel())})

    out = np.zeros(k * (dimensions + 1), "int64")
    for r in rows.mapInArrow(partial, "place long, part long").groupBy("place").agg(F.sum("part").alias("part")).collect():
        out[r["place"]] = r["part"]
    out = out.reshape(k, -1)
    return out[:, 0], out[:, 1:]


def _moved(old: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means rounded down; a centroid without vectors stays."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], old)


def train(va: DataFrame, edges: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` of assigning all vectors and taking means."""
    if not rounds:
        return first
    k, dimensions = first.shape
    start = Intervals(first, edges)

    def all_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        v = _matrix(batch.column(1), dimensions)
        yield start.nearest(start.candidates(_cells(batch.column(0))), v), v, 1

    counts, sums = _cluster_sums(va.select("cells", "v"), k, dimensions, all_of)
    before, now = start, Intervals(_moved(first, counts, sums), edges)
    for _ in range(rounds - 1):

        def unsure(batches: Iterator[pa.RecordBatch], before: Intervals = before, now: Intervals = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = _cells(batch.column(1))
                    may = before.candidates(cells) | now.candidates(cells)  # one centroid in all: known, and unchanged
                    yield batch.select(["row"]).filter(pa.array(may.sum(axis=1) > 1))

        def changed(batch: pa.RecordBatch, before: Intervals = before, now: Intervals = now) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            cells, v = _cells(batch.column(0)), _matrix(batch.column(1), dimensions)
            old, new = (x.nearest(x.candidates(cells), v) for x in (before, now))
            other = old != new
            yield old[other], v[other], -1
            yield new[other], v[other], 1

        fetched = va.select("row", "cells").mapInArrow(unsure, "row long").join(va.select("row", "cells", "v"), "row").select("cells", "v")
        more, moved = _cluster_sums(fetched, k, dimensions, changed)
        counts, sums = counts + more, sums + moved
        before, now = now, Intervals(_moved(now.centroids, counts, sums), edges)
    return now.centroids


def assign(va: DataFrame, edges: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    final = Intervals(centroids, edges)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(2), centroids.shape[1])
                cluster = final.nearest(final.candidates(_cells(batch.column(1))), v)
                distance = ((v - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.record_batch({"vec_id": batch.column(0), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return va.select("vec_id", "cells", "v").mapInArrow(measure, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, *, k: int = CENTROIDS, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector. An even number of dimensions."""
    rows = quantised(vectors, dimensions)
    first = seeds(rows, k)
    if not len(first):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    edges = cell_edges(rows, dimensions)
    va = build(rows, edges)
    centroids = train(va, edges, first, rounds)
    found = stored(assign(va, edges, centroids), "va-assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    return found.join(F.broadcast(vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

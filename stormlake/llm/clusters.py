"""Centroid clustering of integer vectors with Drake's adaptive bounds: exactly Lloyd's result, with few distances worked out.

Each vector keeps the centroid it is assigned to, an upper bound of its distance to it, lower bounds of its distances to
several next nearest centroids, and one lower bound for all the rest. After centroids have moved, the upper bound grows by the own
centroid's move, the others shrink by theirs, the rest's by the largest move. Then, in this order and each only where the one
before certifies nothing:

1. the upper bound is under all lower bounds: the assignment stands;
2. the exact distance to the own centroid takes the upper bound's place;
3. exact distances to the several kept centroids, if the nearest of them is certainly nearer than the rest;
4. a rescan of all centroids, which makes all bounds anew.

How many bounds are kept adapts: each round keeps as many as the last one needed, at least two and an eighth of the centroids.

Distances are exact integers; bounds are doubles, widened by 1e-12 of themselves, and certify only strict order, so ties always are
decided by exact distances and go to the lower number. Sums of clusters change only by the vectors that change clusters; they are added up
in tasks, then by Spark as decimals, and centroids are exact floors. The driver holds centroids and their sums, nothing
that grows with the rows. Vectors and bounds stay in the executors between rounds (on their disks); a lost executor's partitions are made
again from the table by replaying their own rounds, whose centroids travel with the plan.

Defined cases: rows with a null vector, another number of components than asked for, or a null or non-finite component aren't kept; a component
of over 131,072 in size, whose squared distances would leave 64 bits, raises an error; with fewer rows kept than clusters, each
is a centroid; repeated rows are vectors of their own, and of rows with equal ids the first in order of their components starts a
cluster first; a null id is hashed as ``null``; no kept rows give no rows. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlake.llm.base import checkpointed

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Sizes of components up to which squared distances fit in 64 bits; relative width added to bounds.
LARGEST, SLACK = 1 << 27, 1e-12

STATE = "vec_id long, v binary, was int, a int, u double, near binary, low binary, needed int"


class Bounds(NamedTuple):
    """Of each vector: assignment, upper bound, kept centroids, their lower bounds with the rest's last, bounds needed."""

    a: np.ndarray
    u: np.ndarray
    near: np.ndarray
    low: np.ndarray
    needed: np.ndarray


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to rows c, one to one or all to one."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([squared(x, row) for row in c], axis=1)


def scanned(x: np.ndarray, c: np.ndarray, kept: int) -> Bounds:
    """Bounds from all distances, ``kept`` centroids beside the own one; ties go to the lower number."""
    d = _all_squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    away = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    kept = min(kept, len(c) - 1)
    rest = away[:, kept + 1] if len(c) > kept + 1 else np.full(len(x), np.inf)
    low = np.column_stack([away[:, 1 : kept + 1], rest]) * (1 - SLACK)
    return Bounds(order[:, 0].astype(np.int32), away[:, 0] * (1 + SLACK), order[:, 1 : kept + 1].astype(np.int32), low, np.zeros(len(x), np.int32))


def moved(c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(c0, c1).astype(np.float64)) * (1 + SLACK)


def shifted(b: Bounds, move: np.ndarray, kept: int) -> Bounds:
    """Bounds after centroids have moved, cut down to ``kept`` of them."""
    low = b.low - np.column_stack([move[b.near], np.full(len(b.a), move.max(initial=0.0))])
    low = np.where(np.isinf(low), low, low * np.where(low > 0, 1 - SLACK, 1 + SLACK))
    u = (b.u + move[b.a]) * (1 + SLACK)
    if kept < b.near.shape[1]:
        low = np.column_stack([low[:, :kept], low[:, kept:].min(axis=1)])
    return Bounds(b.a, u, b.near[:, :kept], low, b.needed)


def assigned(x: np.ndarray, c: np.ndarray, b: Bounds) -> Bounds:
    """The nearest centroid of each vector by its bounds; distances only where they certify nothing. ``needed`` says how many bounds
    a vector failed: 0 none, else its last failing place from 1."""
    a, u, near, low = b.a.copy(), b.u.copy(), b.near.copy(), b.low.copy()
    needed = np.zeros(len(x), np.int32)
    kept = near.shape[1]
    open_ = np.flatnonzero(~(u < low.min(axis=1)))
    if len(open_):
        u[open_] = np.sqrt(squared(x[open_], c[a[open_]]).astype(np.float64)) * (1 + SLACK)
        failed = ~(u[open_, None] < low[open_])
        open_, failed = open_[failed.any(axis=1)], failed[failed.any(axis=1)]
        needed[open_] = kept + 1 - np.argmax(failed[:, ::-1], axis=1)
    if len(open_):
        # the own centroid and the kept ones, in exact order
        some = np.column_stack([a[open_], near[open_]])
        d = np.stack([squared(x[open_], c[some[:, j]]) for j in range(kept + 1)], axis=1)
        order = np.lexsort((some, d), axis=1)
        some, d = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
        away = np.sqrt(d.astype(np.float64))
        sure = away[:, 0] * (1 + SLACK) < low[open_, kept]
        rows = open_[sure]
        a[rows], u[rows], near[rows] = some[sure, 0], away[sure, 0] * (1 + SLACK), some[sure, 1:]
        low[rows, :kept] = away[sure, 1:] * (1 - SLACK)
        rows = open_[~sure]
        if len(rows):
            new = scanned(x[rows], c, kept)
            a[rows], u[rows], near[rows], low[rows] = new.a, new.u, new.near, new.low
    return Bounds(a, u, near, low, needed)


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<double>) of rows that are kept, components scaled and floored."""
    e = F.col("e")
    kept = (F.size(e) == dimensions) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("e")).filter(e.isNotNull()).filter(kept)
    too_large = F.raise_error(F.lit(f"components of over {LARGEST // scale} have no 64-bit distances"))
    whole = lambda x: F.when(F.abs(x) <= LARGEST / scale, F.floor(x * scale).cast("double")).otherwise(too_large.cast("double"))
    return rows.select("vec_id", F.transform(e, whole).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids hash lowest: a few rows."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(name.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.float64).astype(np.int64)


def _packed(columns: list, b: Bounds, was: np.ndarray) -> pa.RecordBatch:
    rows = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    made = [*columns, pa.array(was, pa.int32()), pa.array(b.a, pa.int32()), pa.array(b.u, pa.float64()), rows(b.near.astype(np.int32)), rows(b.low), pa.array(b.needed, pa.int32())]
    return pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in STATE.split(", ")])


def _unpacked(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _first_round(vectors: DataFrame, c: np.ndarray, kept: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(n, -1).astype(np.int64)
                raw = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
                yield _packed([batch.column(0), raw], scanned(x, c, kept), np.full(n, -1))

    return vectors.mapInArrow(each, STATE)


def _next_round(state: DataFrame, c: np.ndarray, move: np.ndarray, kept: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                held = Bounds(batch.column(3).to_numpy(), batch.column(4).to_numpy(), _unpacked(batch.column(5), np.int32, n), _unpacked(batch.column(6), np.float64, n), np.zeros(n, np.int32))
                x = _unpacked(batch.column(1), np.int32, n).astype(np.int64)
                yield _packed(batch.columns[:2], assigned(x, c, shifted(held, move, kept)), held.a)

    return state.mapInArrow(each, STATE)


def _changes(state: DataFrame, clusters: int) -> list:
    """(cluster, dim, total) of what vectors that changed clusters add and take away; dim -1 counts them. At most clusters x (dimensions + 1)
    rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            x = np.column_stack([np.ones(n, np.int64), _unpacked(batch.column(0), np.int32, n).astype(np.int64)])
            total = np.zeros((clusters, x.shape[1]), np.int64)
            np.add.at(total, batch.column(2).to_numpy(), x)
            was = batch.column(1).to_numpy()
            np.subtract.at(total, was[was >= 0], x[was >= 0])
            k, dim = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(dim - 1, pa.int32()), pa.array(total[k, dim], pa.int64())], names=["cluster", "dim", "part"])

    parts = state.filter("was != a").select("v", "was", "a").mapInArrow(each, "cluster int, dim int, part long")
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()


def _distances(state: DataFrame, c: np.ndarray) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                d = squared(_unpacked(batch.column(1), np.int32, n).astype(np.int64), c[batch.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "a").mapInArrow(each, "vec_id long, cluster int, distance long")


def least_kept(clusters: int) -> int:
    return max(2, -(-clusters // 8))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept vector, final centroids) after ``rounds`` moves of the centroids."""
    rows = integer_vectors(vectors, dimensions, scale)
    c = first_centroids(rows, clusters, seed)
    if not len(c):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), c
    kept = max(least_kept(len(c)), -(-len(c) // 4) + 1)
    state = _first_round(rows, c, kept).persist(StorageLevel.DISK_ONLY)
    sums, before = [[0] * (dimensions + 1) for _ in c], None
    for at in range(rounds):
        for cluster_id, dim, total in _changes(state, len(c)):
            sums[cluster_id][dim + 1] += int(total)
        new = np.array([[x // s[0] for x in s[1:]] if s[0] else old.tolist() for s, old in zip(sums, c, strict=True)], np.int64)
        if at:
            kept = max(least_kept(len(c)), min(kept, state.agg(F.max("needed")).first()[0]))
        if before is not None:
            before.unpersist()
        before, state = state, _next_round(state, new, moved(c, new), kept).persist(StorageLevel.DISK_ONLY)
        c = new
    found = checkpointed(_distances(state, c))
    for held in (before, state):
        if held is not None:
            held.unpersist()
    return found, c


def _by_cluster(values: list, kind: str) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster")).cast(kind)


def report(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    found, c = cluster(vectors, clusters, rounds, dimensions, scale, seed)
    totals = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    of = [totals.get(k, 0) for k in range(len(c))] or [0]
    names = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c] or [""]
    return found.select("vec_id", "cluster", "distance", _by_cluster(of, "long").alias("cluster_inertia"), F.lit(sum(of)).cast("long").alias("inertia"), _by_cluster(names, "string").alias("centroid_sha256"))


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """Lloyd's rounds as SQL over long rows (vector, dimension), without bounds."""
    text = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x AS double)) AS bigint)) AS x
    FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
    comps AS MATERIALIZED (SELECT i, unnest(range({dimensions})) AS d, unnest(x) AS x FROM kept),
    c0 AS MATERIALIZED (SELECT k, unnest(range({dimensions})) AS d, unnest(x) AS c FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(cast(vec_id AS varchar), 'null')), x) - 1 AS k, x FROM kept ORDER BY k LIMIT {clusters}) q)"""
    for r in range(rounds + 1):
        text += f""",
    a{r} AS MATERIALIZED (SELECT i, min_by(k, (dist, k)) AS k, min(dist) AS dist FROM (SELECT v.i, m.k, cast(sum((v.x - m.c) * (v.x - m.c)) AS bigint) AS dist FROM comps v JOIN c{r} m ON m.d = v.d GROUP BY v.i, m.k) q GROUP BY i)"""
        if r < rounds:
            text += f""",
    c{r + 1} AS MATERIALIZED (SELECT o.k, o.d, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT a.k, v.d, cast((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS bigint) AS c FROM a{r} a JOIN comps v ON v.i = a.i GROUP BY a.k, v.d) n ON n.k = o.k AND n.d = o.d)"""
    return text + f""",
    names AS (SELECT k, sha256(string_agg(cast(c AS varchar), ',' ORDER BY d)) AS name FROM c{rounds} GROUP BY k)
    SELECT t.vec_id, cast(a.k AS int) AS cluster, a.dist AS distance, cast(sum(a.dist) OVER (PARTITION BY a.k) AS bigint) AS cluster_inertia, cast(sum(a.dist) OVER () AS bigint) AS inertia, n.name AS centroid_sha256
    FROM a{rounds} a JOIN kept t ON t.i = a.i JOIN names n ON n.k = a.k"""


ORACLE = oracle()

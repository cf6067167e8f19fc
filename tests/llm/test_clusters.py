"""Centroid clustering against plain Lloyd rounds in whole numbers, and its SQL; bounds that adapt."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlake.llm import clusters

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    away = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (away(v, c[j]), j))
    for _ in range(rounds):
        members = [[] for _ in c]
        for _, v in kept:
            members[nearest(v)].append(v)
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(members, c, strict=True)]
    found = [(i, j := nearest(v), away(v, c[j])) for i, v in kept]
    total = [sum(d for _, j, d in found if j == k) for k in range(len(c))]
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((-1 if i is None else i, j, d, total[j], sum(total), names[j]) for i, j, d in found)


def got(frame):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def some_vectors(seed, n, dims=64, spread=0.1):
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.3, 0.3) for _ in range(dims)] for _ in range(9)]
    f32 = lambda x: float(np.float32(x))
    return [(i, [f32(rng.gauss(m, spread)) for m in rng.choice(centres)]) for i in range(n)]


def test_equals_lloyd_with_odd_rows(spark):
    rows = some_vectors(1, 250)
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (900, None), (901, []), (902, rows[0][1][:63]), (903, [*rows[0][1], 0.0]), (904, [None, *rows[0][1][1:]]), (905, [math.nan, *rows[0][1][1:]]), (906, [math.inf, *rows[0][1][1:]])]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE).repartition(4)
    want = brute(rows)
    assert got(clusters.report(table)) == want
    clashing = table.withColumns({c: F.lit(1) for c in ("x", "e", "v", "was", "a", "u", "cluster", "distance", "h", "near")})
    assert got(clusters.report(clashing)) == want


@pytest.mark.parametrize("n", [0, 1, 5, 8])
def test_few_rows(spark, n):
    rows = some_vectors(2, n)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)
    assert got(clusters.report(table)) == brute(rows)


def test_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [0.5] * 64) for i in range(40)] + [(i + 40, [0.25] * 64) for i in range(3)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE)
    assert got(clusters.report(table)) == brute(rows)


def test_too_large_is_an_error(spark):
    table = spark.createDataFrame([(1, [2e5] * 64, 0)], SHAPE)
    with pytest.raises(Exception, match="64-bit distances"):
        clusters.report(table).collect()


@pytest.mark.parametrize(("k", "kept"), [(30, 2), (30, 8), (5, 4), (2, 1), (1, 1)])
def test_bounds_certify_only_what_is_so(k, kept):
    rng = np.random.default_rng(k + kept)
    x = rng.integers(-60, 60, (4000, 3))
    x[:200] = x[0]
    c = x[rng.choice(len(x), k, replace=False)].astype(np.int64)
    state, scans = clusters.scanned(x, c, kept), 0
    for step in range(8):
        d = clusters._all_squared(x, c)
        assert (state.a == np.argmin(d, axis=1)).all()
        real = np.sqrt(d.astype(float))
        rows = np.arange(len(x))
        assert (state.u >= real[rows, state.a]).all()
        for j in range(state.near.shape[1]):
            assert (state.low[:, j] <= real[rows, state.near[:, j]]).all()
        others = real.copy()
        others[rows, state.a] = np.inf
        for j in range(state.near.shape[1]):
            others[rows, state.near[:, j]] = np.inf
        assert (state.low[:, -1] <= others.min(axis=1)).all()
        new = np.array([x[state.a == j].sum(axis=0) // max(1, (state.a == j).sum()) if (state.a == j).any() else c[j] for j in range(k)], np.int64)
        state = clusters.assigned(x, new, clusters.shifted(state, clusters.moved(c, new), max(1, kept - (step > 3))))
        scans += int((state.needed > 0).sum())
        c = new
    assert k == 1 or scans < 8 * len(x) * 0.9


def test_sql_twin(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = some_vectors(4, 60) + [(70, None), (71, [0.0] * 3), (3, some_vectors(4, 60)[9][1])]
    spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE).write.parquet(str(tmp_path / "e.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e.parquet/*.parquet'")
    found = connection.execute(clusters.ORACLE)
    place = {d[0]: i for i, d in enumerate(found.description)}
    said = sorted(tuple(r[place[c]] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in found.fetchall())
    assert said == brute(rows)

"""Chains between junctions and their simplification, against walking and recursion."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stormlake.operators import lines
from stormlake.sources import store


def walked(edges):
    """Chains of a set of pairs, by walking; each as its vertices from the end whose first two are less."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, out = {frozenset(e) for e in edges}, set()

    def walk(u, v, cut):
        path = [u, v]
        left.discard(frozenset((u, v)))
        while len(near[path[-1]]) == 2 and path[-1] not in cut:
            path.append(next(iter(near[path[-1]] - {path[-2]})))
            left.discard(frozenset(path[-2:]))
        out.add(min(tuple(path), tuple(reversed(path)), key=lambda p: p[:2]))

    for u in sorted(near):
        if len(near[u]) != 2:
            for v in sorted(near[u]):
                if frozenset((u, v)) in left:
                    walk(u, v, ())
    while left:
        u = min(min(e) for e in left)
        walk(u, min(near[u]), (u,))
    return out


def got_chains(spark, edges):
    rows = spark.createDataFrame(list(edges), "a long, b long")
    held = {}
    for r in lines.chains(rows).orderBy("pos").collect():
        held.setdefault((r["first"], r["second"]), []).append(r["vertex"])
    assert all(k == tuple(v[:2]) for k, v in held.items())
    return {tuple(v) for v in held.values()}


def test_chains_of_odd_graphs(spark):
    ring = [(i, i % 37 + 1) for i in range(1, 38)]
    path = [(100 + i, 101 + i) for i in range(70)]
    lollipop = [(200, 201), (201, 202), (202, 203), (203, 201)]
    two = [(300, 301)]
    again = [(301, 300), (300, 301), (400, 400)]
    edges = [*ring, *path, *lollipop, *two, *again]
    assert got_chains(spark, edges) == walked([e for e in edges if e[0] != e[1]])
    assert lines.chains(spark.createDataFrame([], "a long, b long")).collect() == []


def test_chains_of_random_graphs(spark):
    rng = random.Random(4)
    names = rng.sample(range(1000), 120)
    edges = {tuple(sorted((names[i], names[i + 1]))) for i in range(119) if rng.random() > 0.1} | {tuple(sorted(rng.sample(names, 2))) for _ in range(12)}
    assert got_chains(spark, edges) == walked(edges)


def peucker(points, tolerance):
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        length = math.hypot(bx - ax, by - ay)
        d = [(math.hypot(x - ax, y - ay) if length == 0 else abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / length, -i) for i, (x, y) in enumerate(points[a + 1 : b], a + 1)]
        if d and (max(d)[0] > tolerance or length == 0):
            k = -max(d)[1]
            keep.add(k)
            todo += [(a, k), (k, b)]
    return sorted(keep)


@pytest.mark.parametrize("tolerance", [0.0, 0.05, 0.4, 100.0])
def test_simplified_equals_recursion(spark, tolerance):
    rng = random.Random(8)
    held = {"a": [(i / 10, math.sin(i / 5) + rng.gauss(0, 0.05)) for i in range(150)], "b": [(math.cos(i * math.pi / 20), math.sin(i * math.pi / 20)) for i in range(40)] + [(1.0, 0.0)], "c": [(0.0, 0.0), (1.0, 1.0)], "d": [(2.0, 2.0)], "e": [(float(i), 0.0) for i in range(30)], "f": [(0.0, 0.0)] * 4}
    rows = spark.createDataFrame([(k, i, x, y) for k, ps in held.items() for i, (x, y) in enumerate(ps)], "k string, pos long, x double, y double").repartition(3)
    got = {}
    for r in lines.simplified(rows, ["k"], tolerance).collect():
        got.setdefault(r["k"], []).append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {k: peucker(ps, tolerance) for k, ps in held.items()}


def test_squares_keep_their_shared_border(spark):
    """Two unit squares with a common side, ten points a side: six corners and seven sides stay."""

    def square(x0):
        grid = [(10 * x0 + k, 0) for k in range(10)] + [(10 * x0 + 10, k) for k in range(10)] + [(10 * x0 + 10 - k, 10) for k in range(10)] + [(10 * x0, 10 - k) for k in range(11)]
        return [(x / 10, y / 10) for x, y in grid]

    rings = spark.createDataFrame([(r, k, x, y) for r in range(2) for k, (x, y) in enumerate(square(r))], "ring_id int, seq int, x double, y double")
    vertices, segments = store.line_tables(store.border_segments(rings))
    out = lines.simplified_lines(vertices, segments, 0.001)
    used = vertices.join(out.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "vertex")
    assert out.count() == 7 and sorted((r["x"], r["y"]) for r in used.collect()) == [(x, y) for x in (0.0, 1.0, 2.0) for y in (0.0, 1.0)]
    assert lines.simplified_lines(vertices, segments, 0.0).count() >= 7 and segments.count() == 70

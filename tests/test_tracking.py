"""Links of cells against taking the nearest pair again and again; gates around places against their distances."""

from __future__ import annotations

import math
import random

import pytest

from stormlake.operators import tracking


def greedy(before, after):
    pairs = []
    for j, px, py, reach in before:
        for i, x, y in after:
            d = math.hypot(x - px, y - py)
            if d <= reach:
                pairs.append((d, i, j))
    out, ii, jj = set(), set(), set()
    for d, i, j in sorted(pairs):
        if i not in ii and j not in jj:
            ii.add(i)
            jj.add(j)
            out.add((j, i))
    return out


@pytest.mark.parametrize("crowd", [4.0, 40.0, 400.0])
def test_links_equal_greedy(spark, crowd):
    rng = random.Random(int(crowd))
    # whole numbers, so that many distances are the same
    spot = lambda: (float(rng.randint(0, int(crowd))), float(rng.randint(-int(crowd), 0)))
    before = {f: [(j, *spot(), rng.choice([10.0, 15.0])) for j in range(40)] for f in range(3)}
    after = {f: [(i, *spot()) for i in range(100, 145)] for f in range(3)}
    b = spark.createDataFrame([(f, *r) for f, rs in before.items() for r in rs], "frame int, id long, px double, py double, reach_km double")
    a = spark.createDataFrame([(f, *r) for f, rs in after.items() for r in rs], "frame int, id long, x double, y double")
    got = {}
    for r in tracking.links(b, a, ["frame"]).collect():
        got.setdefault(r["frame"], set()).add((r["before_id"], r["after_id"]))
    assert got == {f: greedy(before[f], after[f]) for f in range(3)}


def test_predicted_places(spark):
    cells = spark.createDataFrame([(1, 10.0, 5.0, 20.0, -10.0, 300), (2, 1.0, 2.0, None, None, 300), (3, 0.0, 0.0, 1.0, None, 300)], "id int, x double, y double, u double, v double, dt_s int")
    assert [(r["px"], r["py"], r["reach_km"]) for r in tracking.predicted(cells).orderBy("id").collect()] == [(16.0, 2.0, 10.0), (1.0, 2.0, 15.0), (0.0, 0.0, 15.0)]
    none = cells.limit(0)
    assert tracking.links(tracking.predicted(none), none.select("id", "x", "y"), []).collect() == []


@pytest.mark.parametrize("n_az", [7, 36, 360])
def test_around_is_all_within_reach(spark, n_az):
    rng = random.Random(n_az)
    places = [(1, i, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(25)] + [(1, 100, 0.0, 0.0), (1, 101, 0.0, 8.0), (1, 102, 3.0, -2.0), (1, 103, -1e-9, -30.0), (1, 104, 300.0, 0.0)]
    rays = spark.createDataFrame([(1, a, [float(g) for g in range(45)]) for a in range(n_az) if a != 5], "vol int, az int, v array<double>")
    got = {}
    for r in tracking.around(spark.createDataFrame(places, "vol int, id int, x_km double, y_km double"), rays, ["vol"], n_az, 8.0, 0.5, 1.0).collect():
        assert (r["id"], r["az"]) not in got
        got[r["id"], r["az"]] = r["near"]
    for _, i, x, y in places:
        for a in range(n_az):
            t = (a + 0.5) * 2 * math.pi / n_az
            want = [g for g in range(45) if a != 5 and math.hypot((0.5 + g) * math.sin(t) - x, (0.5 + g) * math.cos(t) - y) <= 8.0]
            assert got.get((i, a), []) == want


def test_debris_near_the_strongest_rotation(spark):
    near = lambda a, g: a in (88, 89, 90, 91) and 28 <= g <= 30
    rays = [(1, a, [12.0 if (a, g) == (90, 29) else 5.0 if a == 91 else None for g in range(60)], [50.0 if near(a, g) else 20.0 for g in range(60)], [0.7 if near(a, g) else 0.99 for g in range(60)], [0.2 if near(a, g) else None for g in range(60)]) for a in range(360)]
    table = spark.createDataFrame(rays, "vol int, az int, rot array<double>, z array<double>, rho array<double>, zdr array<double>")
    places = spark.createDataFrame([(1, 1, 28.0, 0.0), (1, 2, 40.0, 0.0), (1, 3, -30.0, 0.0), (1, 4, 24.0, -3.0)], "vol int, id int, x_km double, y_km double")
    got = {r["id"]: r for r in tracking.rotation(places, table, ["vol"], 360).collect()}
    assert [(i, r["rot"], r["peak_az"], r["peak_gate"], r["n_debris"], r["debris"]) for i, r in sorted(got.items())] == [(1, 12.0, 90, 29, 12, True), (2, 5.0, 91, 46, 0, False), (3, 0.0, None, None, 0, False), (4, 12.0, 90, 29, 12, True)]

"""Echo regions, cells, shear, specific phase and bright band on fields of known truth, and their plans."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stormlake.operators import echoes, rays
from stormlake.plans import sweeps
from tests.test_queries import SF, plan

KEYS = ["vol"]
SHAPE = "vol long, az long, v array<double>"


def sweep(spark, field, n_az, gates, shape=SHAPE, missing=()):
    return spark.createDataFrame([(1, a, [field(a, g) for g in range(gates)]) for a in range(n_az) if a not in missing], shape)


def flooded(field, n_az, gates, level, missing=()):
    """Regions as sets of (az, gate)."""
    on = {(a, g) for a in range(n_az) for g in range(gates) if a not in missing and field(a, g) is not None and field(a, g) >= level}
    out = []
    while on:
        todo, seen = [min(on)], set()
        on.discard(todo[0])
        while todo:
            a, g = todo.pop()
            seen.add((a, g))
            for x in (((a + 1) % n_az, g), ((a - 1) % n_az, g), (a, g - 1), (a, g + 1)):
                if x in on:
                    on.discard(x)
                    todo.append(x)
        out.append(frozenset(seen))
    return out


@pytest.mark.parametrize(("n_az", "share", "missing"), [(12, 0.45, ()), (12, 0.62, (3, 4)), (3, 0.6, ()), (2, 0.5, ()), (1, 0.5, ()), (25, 0.58, (0,))])
def test_regions_are_floods(spark, n_az, share, missing):
    rng = random.Random(n_az)
    held = {(a, g): rng.choice([None, 10.0, 45.0, 55.0, 65.0][:3]) if rng.random() > share else rng.choice([45.0, 55.0, 65.0]) for a in range(n_az) for g in range(30)}
    field = lambda a, g: held[a, g]
    found = echoes.regions(sweep(spark, field, n_az, 30, missing=missing), KEYS, n_az).collect()
    for place, level in enumerate((40.0, 50.0, 60.0)):
        want = sorted((min(a * echoes.RAY + g for a, g in r), len(r), max(field(*x) for x in r)) for r in flooded(field, n_az, 30, level, missing))
        assert sorted((r["root"], r["n_gates"], r["max_dbz"]) for r in found if r["level"] == place) == want
        if place:
            of = {x: min(a * echoes.RAY + g for a, g in r) for r in flooded(field, n_az, 30, level - 10, missing) for x in r}
            assert all(r["parent"] == of[divmod(r["root"], echoes.RAY)] for r in found if r["level"] == place)


def blobs(a, g):
    """Two peaks of 62 and 58 dBZ on one ridge, one of 55 that lies over north, one too small."""
    out = 5.0
    for az, r, top, size in ((100, 60, 62.0, 5.0), (130, 60, 58.0, 5.0), (0, 90, 55.0, 6.0), (200, 40, 65.0, 0.45)):
        away = min(abs(a - az), 360 - abs(a - az)) * math.pi / 180 * r
        out = max(out, top - 3 * (away**2 + (g + 1 - r) ** 2) / size**2)
    return max(out, 42.0 - (abs(g - 59) > 2) * 40) if 100 <= a <= 130 else out


def test_cells_split_and_wrap(spark):
    found = echoes.regions(sweep(spark, blobs, 360, 120), KEYS, 360)
    got = echoes.cells(found, KEYS).orderBy("rank").collect()
    assert [(r["rank"], r["level"], r["max_dbz"]) for r in got] == [(1, 1, 62.0), (2, 1, 58.0), (3, 0, 55.0)]
    for r, az in zip(got, (100.5, 130.5, 0.5), strict=True):
        assert abs(math.degrees(math.atan2(r["x_km"], r["y_km"])) % 360 - az) < 0.8 and abs(math.hypot(r["x_km"], r["y_km"]) - (90 if r["rank"] == 3 else 60)) < 0.5
    assert all(r["area_km2"] >= 8 for r in got)


def test_no_echo(spark):
    for rows in (sweep(spark, lambda a, g: 5.0 if g % 2 else None, 8, 10), spark.createDataFrame([], SHAPE), spark.createDataFrame([(1, 0, []), (1, 1, None)], SHAPE)):
        found = echoes.regions(rows, KEYS, 8)
        assert found.collect() == [] and echoes.cells(found, KEYS).collect() == []


def test_shear_of_a_solid_body(spark):
    """0.01 / s of rotation at 30 km: 10 within 0.3."""
    cx, cy = 30.0 * math.sin(math.radians(45.25)), 30.0 * math.cos(math.radians(45.25))

    def v(a, g):
        az, r = math.radians((a + 0.5) / 2), (2.125 + g * 0.25)
        x, y = r * math.sin(az), r * math.cos(az)
        near = math.hypot(x - cx, y - cy) < 4
        return (-10 * (y - cy) * math.sin(az) + 10 * (x - cx) * math.cos(az)) if near else 0.0

    rows = spark.createDataFrame([(1, a, [v(a, g) for g in range(200)]) for a in range(720)], SHAPE)
    out = {r["az"]: r["shear"] for r in rays.azimuthal_shear(rows, KEYS, 720, 200, 2125.0, 250.0).collect()}
    assert len(out) == 720 and abs(out[90][111] - 10) < 0.3 and out[300][111] == 0


def test_shear_edges(spark):
    field = lambda a, g: None if (a, g) == (5, 5) else 2.0 * a
    rows = sweep(spark, field, 60, 12, missing=(20,))
    out = {r["az"]: r["shear"] for r in rays.azimuthal_shear(rows, KEYS, 60, 12).collect()}
    reach = rays.shear_reach(60, 12, 1000.0, 1000.0)
    assert reach[:4] == [0, 4, 2, 2] and min(reach[1:]) == 1 and 20 not in out
    assert all(x[0] is None for x in out.values()) and out[5][5] is None and out[6][5] is not None
    # beyond reach of the missing ray slopes are whole; beside it at reach 1 a side is missing
    assert abs(out[40][8] - 2000 / (9000 * 2 * math.pi / 60)) < 1e-9 and out[19][11] is None and out[21][11] is None and out[19][1] is not None
    # where azimuth wraps the fall of 118 is no line
    assert out[0][8] is None and out[59][8] is None
    with pytest.raises(ValueError, match="too few"):
        rays.azimuthal_shear(rows, KEYS, 2, 4, 2000.0)


def test_specific_phase_of_a_ramp(spark):
    """3 degrees a km with a wrap and a spike: 1.5 within 0.05."""
    g = range(240)
    phi = [(300 + 0.75 * i) % 360 for i in g]
    phi[120] += 40
    weak = [30.0 if i < 200 else 10.0 for i in g]
    rows = spark.createDataFrame([(1, 0, phi, [0.99] * 240, weak), (1, 1, [None] * 240, [0.99] * 240, weak), (1, 2, phi, [0.5] * 240, [50.0] * 240), (1, 3, [], [], []), (1, 4, [10.0], [0.99], [50.0])], "vol long, az long, phi array<double>, rho array<double>, z array<double>")
    out = {r["az"]: r["kdp"] for r in rays.specific_phase(rows, KEYS, 250.0).collect()}
    assert all(abs(x - 1.5) < 0.05 for x in out[0][20:190]) and set(out[0][200:]) == {None}
    assert set(out[1]) == set(out[2]) == {None} and 3 not in out and out[4] == [None]


def test_phase_is_unwrapped_from_the_raw_one(spark):
    row = spark.createDataFrame([([350.0, None, 20.0, 200.0, 10.0],)], "t array<double>").select(F.expr(rays.unwrapped_phase("t")).alias("u"), F.expr(rays.sliding_median("t")).alias("m")).first()
    # after a turn a rise of 180 is a fall of 180 + 360 - 360: whole turns are added to the raw phase only as far as needed
    assert row["u"] == [350.0, None, 380.0, 200.0, 10.0] and row["m"] == [350.0, None, 200.0, 20.0, 20.0]


def test_bright_band_of_a_layer(spark):
    def moments(elev, g):
        r = 1000.0 + g * 250
        h = math.sqrt(r * r + 8494666.7**2 + 2 * r * 8494666.7 * math.sin(math.radians(elev))) - 8494666.7
        return 0.94 if 2500 <= h <= 3000 else 0.99

    rows = [(1, e, [35.0] * 320, [1.5] * 320, [moments(e, g) for g in range(320)]) for e in (2.5, 4.0, 6.0, 9.0) for _ in range(60)]
    rows += [(2, 4.0, [35.0] * 320, [1.5] * 320, [0.94] * 320)] * 3 + [(3, 4.0, [35.0] * 320, [1.5] * 320, [0.99] * 320), (4, 4.0, [], [], [])]
    out = {r["vol"]: r for r in rays.bright_band(spark.createDataFrame(rows, "vol long, elev double, z array<double>, zdr array<double>, rho array<double>"), KEYS, 1000.0, 250.0).collect()}
    assert abs(out[1]["bottom_m"] - 2500) < 150 and abs(out[1]["top_m"] - 3000) < 150 and out[1]["found"]
    assert not out[2]["found"] and out[2]["bottom_m"] is None and out[2]["n"] > 800 and set(out) == {1, 2}


@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
def test_nearest_rank_needs_no_sort(spark, width):
    rng = random.Random(9)
    held = {"a": [rng.gauss(0, 20) for _ in range(501)], "b": [3.0] * 40 + [rng.choice([1.0, 2.0, 9.0]) for _ in range(57)], "c": [-4.5]}
    rows = spark.createDataFrame([(k, x) for k, xs in held.items() for x in xs] + [("a", None), ("d", None)], "k string, y double").repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["k"], r["share"]): r["value"] for r in rays.nearest_rank(rows, ["k"], "y", shares, width).collect()}
    assert got == {(k, s): sorted(xs)[math.floor((len(xs) - 1) * s + 0.5)] for k, xs in held.items() for s in shares}


@pytest.mark.parametrize(("name", "exchanges"), [("azimuthal_shear", 1), ("specific_phase", 0), ("phase_texture", 0)])
def test_gates_are_never_shuffled(spark, name, exchanges):
    text = plan(sweeps.QUERIES[name](spark, SF)).split("== Physical Plan ==")[-1]
    assert text.count("Exchange hashpartitioning") == exchanges and "Python" not in text and "ArrowEval" not in text and "Join" not in text

"""Viewer operators and jobs."""

from __future__ import annotations

import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from stormlake.operators import views, volumes
from stormlake.plans import jobs
from stormlake.sources import bucket, level2


def test_sweeps_and_thresholds(spark):
    t = datetime(2024, 5, 1)
    sweeps = spark.createDataFrame([("A", t, k, ["REF", "VEL"] if k % 2 else ["REF"]) for k in range(5)], "icao string, scan_time timestamp, sweep int, fields array<string>")
    assert views.nearest_sweep_with(sweeps, "VEL", 2).first()["sweep"] == 1
    tilts = spark.createDataFrame([("A", t, k, 0.5 + k) for k in range(4)], "icao string, scan_time timestamp, tilt int, elev double")
    assert views.sweeps_for(tilts, 2.0, False).first()["tilt"] == 1 and views.isolate(tilts, 1.5, "below").count() == 2 and views.isolate(tilts, 0, "all").count() == 4
    with pytest.raises(ValueError):
        views.isolate(tilts, 0, "none")
    gates = spark.createDataFrame([(-12.0,), (5.0,), (-1000.0,)], "v double")
    assert gates.filter(views.over_threshold(F.col("v"), "VEL", 10)).count() == 1 and gates.filter(views.over_threshold(F.col("v"), "REF", 5)).count() == 1
    frames = spark.createDataFrame([("a", t), ("b", datetime(2024, 5, 2))], "name string, scan_time timestamp")
    assert views.live_target(frames, "a", False).count() == 1 and views.live_target(frames, "b", False).count() == 0 and views.live_target(frames, "a", True).count() == 0


def test_areas_with_holes(spark):
    square = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    areas = spark.createDataFrame([(1, square(0.0, 0.0, 4.0), [square(1.0, 1.0, 1.0)], 1), (2, square(3.0, 3.0, 4.0), [], 2)], "area_id int, outer array<array<double>>, holes array<array<array<double>>>, rank int")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.5, 3.5), (4, 9.0, 9.0)], "point_id int, lon double, lat double")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(views.in_areas(points, areas)) == [(1, 1), (3, 1), (3, 2)]
    assert rows(views.in_areas(points, areas, rank="rank")) == [(1, 1), (3, 2)] and (2, 1) in rows(views.in_areas(points, areas, holes=False))
    ring = views.project_rings(areas.filter("area_id = 1"), 0.0, 0.0).first()["ring"]
    assert abs(ring[1][0] - 4 * 111.195) < 0.5 and abs(ring[1][1]) < 1e-6


def test_nearest_and_moved(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "point_id int, x double, y double")
    cells = spark.createDataFrame([(1, 3.0, 4.0), (2, -3.0, -4.0), (3, 59.0, 0.0)], "cell_id int, x double, y double")
    assert [tuple(r) for r in views.nearest_within(points, cells).collect()] == [(1, 1, 5.0)]
    seen = spark.createDataFrame([("B", 1.0, 0.0, [(0.0, 1.0)])], "site string, x double, y double, track array<struct<x:double,y:double>>")
    offsets = spark.createDataFrame([("B", 10.0, 20.0, 90.0)], "other string, x0 double, y0 double, turn double")
    row = views.move_tracks(seen, offsets).first()
    assert abs(row["x"] - 10) < 1e-9 and abs(row["y"] - 19) < 1e-9 and abs(row["track"][0]["x"] - 11) < 1e-9
    place = spark.range(1).select(views.forecast(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("f")).first()["f"]
    assert [(p["minutes"], round(p["x"], 6)) for p in place] == [(15, 9.0), (30, 18.0), (45, 27.0)]
    cities = spark.createDataFrame([("near", 35.1, -97.0, 5), ("far", 45.0, -97.0, 9)], "name string, lat double, lon double, population int")
    assert [r["name"] for r in views.cities_around(cities, 35.0, -97.0, 50).collect()] == ["near"]


def test_section_is_split_where_radars_are_equally_near(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0)], "line_id int, ax double, ay double, bx double, by double")
    radars = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 50.0, 300.0)], "radar int, x double, y double")
    got = sorted(tuple(r) for r in views.section_pieces(lines, radars).collect())
    assert got == [(1, 0, 0.0, 0.5), (1, 1, 0.5, 1.0), (2, 0, 0.0, 1.0)]


RAY = "vol int, ray_id int, x double, y double, z double, dx double, dy double, dz double"


def _sweeps(spark, held, elevs=(0.5, 5.0), n_az=4, gates=200):
    rows = [(1, t, e, a, [held(t, a, g) for g in range(gates)]) for t, e in enumerate(elevs) for a in range(n_az)]
    return spark.createDataFrame(rows, "vol int, tilt int, elev double, az long, v array<double>")


def test_pick_takes_the_first_drawn_gate(spark):
    down = lambda i, x=50.0: (1, i, x, 0.0, 20.0, 0.0, 0.0, -1.0)
    rays = spark.createDataFrame([down(1), down(2, 80.0), down(3, 150.0), down(4, 250.0), (1, 5, 0.0, 10.0, 30.0, 0.0, 0.0, 1.0), (1, 6, 0.0, 40.0, 0.0, 0.0, 0.0, 1.0), (1, 7, 50.0, 0.0, -1.0, 0.0, 0.0, -1.0), (1, 8, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], RAY)
    held = lambda t, a, g: None if t == 1 and 75 < g < 85 else 3.0 if t == 1 and g > 140 else 30.0 + t
    got = {r["ray_id"]: r for r in views.pick(rays, _sweeps(spark, held), ["vol"], 4, least=5.0).collect()}
    # through a missing gate and through a weak one to the tilt below; beyond the last gate, off upwards and under the ground nothing
    assert {i: r["tilt"] for i, r in got.items()} == {1: 1, 2: 0, 3: 0, 6: 0} and abs(got[1]["t"] - (20 - 4.52)) < 0.05 and got[2]["value"] == 30.0
    for r in got.values():
        assert abs(r["height_km"] - (math.sqrt(r["slant_km"] ** 2 + 8494.67**2 + 2 * r["slant_km"] * 8494.67 * math.sin(math.radians((0.5, 5.0)[r["tilt"]]))) - 8494.67)) < 1e-9
    # a radar at 90 km east is nearer to what lies beyond 45 km
    other = spark.createDataFrame([(1, 90.0, 0.0)], "vol int, x double, y double")
    assert {r["ray_id"] for r in views.pick(rays, _sweeps(spark, held), ["vol"], 4, others=other).collect()} == {6}


def test_pick_finds_two_crossings_however_near(spark):
    # level rays that graze a tilt's surface from above near 100 km: in and out again
    height = 8494.67 * math.cos(math.radians(0.5)) / math.cos(math.radians(0.5) + 100 / 8494.67) - 8494.67
    slope = math.cos(math.radians(0.5)) * math.sin(math.radians(0.5) + 100 / 8494.67) / math.cos(math.radians(0.5) + 100 / 8494.67) ** 2
    rows = [(1, i, 0.0, 0.0, height - 100 * slope + lift, 0.0, 1.0, slope) for i, lift in enumerate((1e-7, 0.1, -1e-7))]
    tilts = spark.createDataFrame([(1, 0, 0.5, 190.0)], "vol int, tilt int, elev double, reach_km double")
    got = {}
    for r in views.crossings(spark.createDataFrame(rows, RAY), tilts, ["vol"]).collect():
        got.setdefault(r["ray_id"], []).append(r["t"])
    assert [len(got.get(i, [])) for i in range(3)] == [2, 2, 0]
    for i, lift in enumerate((1e-7, 0.1)):
        assert all(abs(abs(t - 100) - math.sqrt(2 * lift * 8494.67)) < 0.6 for t in got[i])


def test_pick_far_and_flat(spark):
    # a ray that meets the surface only beyond 300 km
    rays = spark.createDataFrame([(1, 1, 0.0, -400.0, 5.0, 0.0, 1.0, 0.0)], RAY)
    row = views.pick(rays, _sweeps(spark, lambda t, a, g: 20.0, elevs=(0.0,), gates=460), ["vol"], 4).first()
    assert abs(row["ground_km"] - math.acos(8494.67 / 8499.67) * 8494.67) < 1e-6 and row["t"] < 110


def _archive(tmp_path, times_ms, broken=()):
    for at in times_ms:
        stamp = datetime.fromtimestamp(at / 1000, UTC)
        path = tmp_path / f"bucket/{stamp:%Y/%m/%d}/KTST/KTST{stamp:%Y%m%d_%H%M%S}_V06"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"torn" if at in broken else level2.write_volume(level2.storm_scene(time_ms=at, sweeps=(1.5, 3.0))))
    return bucket.FolderBucket(str(tmp_path / "bucket"))


def test_backfill_writes_every_table_twice_alike(spark, tmp_path):
    t0 = 1_714_600_800_000
    source = _archive(tmp_path, [t0 - 300_000, t0, t0 + 300_000, t0 + 400_000], broken=[t0 + 400_000])
    run = lambda: jobs.backfill(spark, source, "KTST", datetime(2024, 5, 1, 22, tzinfo=UTC), datetime(2024, 5, 2, tzinfo=UTC), str(tmp_path / "raw"), str(tmp_path / "out"))
    assert len(run()) == 3
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    tables = ("product", "field", "cell", "cell_track", "hydrometeor", "melting_layer", "scan_index", "radial")
    first = {n: read(n).count() for n in tables}
    # the scan before the range leads into it and isn't written
    assert first["scan_index"] == 2 and first["cell"] == 2 and read("scan_index").filter("provisional").count() == 0
    assert {r["field"] for r in read("field").select("field").distinct().collect()} == {"DVEL", "AZSHR", "KDP", "HCA"}
    run()
    assert first == {n: read(n).count() for n in first}
    radials = read("radial").drop("name", "day")
    assert jobs.unfold_again(radials, str(tmp_path / "out")).count() == 0
    field = read("field")
    later = field.withColumn("v", F.when(F.col("scan_time") > F.timestamp_millis(F.lit(t0)), F.transform("v", lambda x: x + 1)).otherwise(F.col("v")))
    assert [r["scan_time"].timestamp() * 1000 for r in jobs.changed_volumes(field, later).collect()] == [t0 + 300_000]
    # a job over one scan leaves the other scans of its day
    one = volumes.read_archive(spark, str(tmp_path / "raw/KTST20240501_220000_V06"))
    jobs.process(one, str(tmp_path / "out"), provisional=True)
    assert first == {n: read(n).count() for n in first} and read("scan_index").filter("provisional").count() == 1


def test_backfill_fetches_on_executors_and_decodes_once(spark, tmp_path, monkeypatch):
    """Two jobs over what is fetched and decoded once; nothing is read back from the folder of fetched files, which may be another on each machine."""
    t0 = 1_714_600_800_000
    source = _archive(tmp_path, [t0, t0 + 300_000])
    made, passes = [], []
    decode, process = jobs.volumes.decode, jobs.process
    monkeypatch.setattr(jobs.volumes, "decode", lambda files: made.append(files.count()) or decode(files))
    monkeypatch.setattr(jobs, "process", lambda radials, *a, **k: passes.append((radials.select("scan_time").distinct().count(), k.get("provisional", False), radials._jdf.queryExecution().executedPlan().toString())) or process(radials, *a, **k))
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    keys = jobs.backfill(spark, source, "KTST", datetime(2024, 5, 1, 22, tzinfo=UTC), datetime(2024, 5, 2, tzinfo=UTC), str(raw), out)
    assert [k.rpartition("/")[2] for k in keys] == ["KTST20240501_220000_V06", "KTST20240501_220500_V06"] and len(list(raw.iterdir())) == 2
    assert made == [2, 0] and [p[:2] for p in passes] == [(2, True), (2, False)]
    assert not any("InArrow" in p[2] or str(raw) in p[2] for p in passes)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    assert jobs.backfill(spark, source, "KNON", datetime(2024, 5, 1, 22, tzinfo=UTC), datetime(2024, 5, 2, tzinfo=UTC), str(raw), out) == []


@pytest.mark.parametrize("categorical", [False, True])
@pytest.mark.parametrize("folded", [False, True])
def test_between_tilts_against_brute_force(spark, categorical, folded):
    rng = random.Random(5)
    gates = (None, -1000.0, -2000.0, 3.0, 8.0)
    rows = [(k, rng.choice(gates), rng.choice(gates), *rng.choice([(1.0, 1.5), (1.0, 4.0), (1.0, None), (1.0, 1.0)]), rng.random()) for k in range(400)]
    rows = [(k, a, b, e0, e1, e0 + t * ((e1 or e0) - e0)) for k, a, b, e0, e1, t in rows]

    def expected(a, b, e0, e1, e):
        a, b = -1000.0 if a is None else a, -1000.0 if b is None else b
        if e1 is None or e1 == e0:
            return a if a > -900 or (folded and a == -2000) else None
        w = (e - e0) / (e1 - e0)
        if a > -900 and b > -900:
            return [a, b][w >= 0.5] if categorical else a + (b - a) * w
        for v, d in ((a, e - e0), (b, e1 - e)):
            if v > -900 and d < 0.475:
                return v
        return -2000.0 if folded and [a, b][w >= 0.5] == -2000 else None

    made = spark.createDataFrame(rows, "k int, a double, b double, e0 double, e1 double, e double")
    got = {r["k"]: r["v"] for r in made.select("k", views.between_tilts(*map(F.col, ("a", "b", "e", "e0", "e1")), categorical, folded).alias("v")).collect()}
    want = {k: expected(a, b, e0, e1, e) for k, a, b, e0, e1, e in rows}
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()} and len(set(want.values())) >= 3
    assert all(v is None or abs(v - want[k]) < 1e-9 for k, v in got.items())

"""Registered queries: results equal their SQL twins, plans are the wanted ones."""

from __future__ import annotations

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stormlake.functions import geometry
from stormlake.operators import hydrometeors, tilts
from stormlake.plans import catalogue
from stormlake.plans.bindings import BINDINGS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def canonical(rows):
    plain = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else x
    return Counter(tuple(plain(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = canonical(frame.select(*columns).collect())
    found = duck.execute(catalogue.ORACLES[name])
    place = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(place) == columns
    assert got == canonical(tuple(r[place[c]] for c in columns) for r in found.fetchall())


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["scans_between"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text
    assert "embedding" not in plan(catalogue.QUERIES["key_times"](spark, SF))


def test_no_products_or_single_partitions_in_large_joins(spark):
    for name in ("mosaic_partners", "storm_motion_near", "scan_at_or_before", "prior_scans", "scan_sequences"):
        text = plan(catalogue.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "SinglePartition" not in text.split("Executed Plan")[-1], name


@pytest.mark.parametrize("name", ["column_products", "low_level_rotation", "storm_relative", "sweep_statistics", "range_windows", "phase_unwrap", "tilt_resample", "fold_check", "vad_ring_fits", "vad_refined_fits"])
def test_gates_are_no_rows_of_a_shuffle(spark, name):
    text = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text
    dealt = re.findall(r"(?:hashpartitioning|rangepartitioning|Sort \[|Window \[)[^\n]*", text)
    assert not any("bin#" in line for line in dealt), name


def test_ring_fits_in_two_passes(spark):
    """Gates a fold off come back, gates far off are left out, and a ring needs six of eight sectors."""
    import math

    from stormlake.operators import columns
    from stormlake.operators.sql import run

    def ray(tilt, az):
        true = 12 * math.sin(math.radians((az + 0.5) * 7.2)) - 7 * math.cos(math.radians((az + 0.5) * 7.2))
        v = [None if tilt == 1 and az < 19 else true - (20.0 if (az + g) % 17 == 0 else 0.0) for g in range(64)]
        return 0, tilt, 30.0 if tilt == 2 else 0.5, az, v, [None if x is None else x - 20 * math.floor((x + 10) / 20) for x in v]

    rows = spark.createDataFrame([ray(t, a) for t in range(3) for a in range(50)], "vol long, tilt long, elev double, az long, v array<double>, raw array<double>")
    first = {(r["tilt"], r["ring"]): r for r in run(columns.ring_fits(), radials=rows).collect()}
    found = {(r["tilt"], r["ring"]): r for r in run(columns.refined_fits(10.0), radials=rows).collect()}
    assert set(found) == {(0, k) for k in range(1, 15)} and {t for t, _ in first} == {0, 1, 2}
    cosine = math.cos(math.radians(0.5))
    assert all(r["n"] == 200 and r["rms"] == 0 and abs(r["u"] - 12 / cosine) < 1e-3 and abs(r["v"] + 7 / cosine) < 1e-3 for r in found.values())
    assert max(abs(first[k]["u"] - 12 / cosine) for k in found) > 0.02
    assert not run(columns.refined_fits(10.0), radials=rows.limit(0)).collect()


def test_fold_check_between_volumes(spark):
    from stormlake.operators import sections
    from stormlake.operators.sql import run

    values = {0: [0.0, 10.0, None, 10.0], 1: [0.0, 45.0, 5.0, None], 2: [1.0, 1.0, 1.0, 1.0]}
    rays = spark.createDataFrame([(vol, 0, az, v) for vol, v in values.items() for az in range(2 if vol == 0 else 4)], "vol long, tilt long, az long, v array<double>")
    sweeps = spark.createDataFrame([(0, 0, 0.5, 2, None, 1000.0, 1000.0), (1, 0, 0.6, 4, None, 1000.0, 1000.0), (2, 0, 0.9, 4, 1.0, 1000.0, 1000.0)], "vol long, tilt long, elev double, n_az int, nyquist double, first_m double, spacing_m double")
    loops = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "vol long, loop long")
    got = [tuple(r) for r in run(sections.fold_check(), radials=rays, sweeps=sweeps, loops=loops).collect()]
    assert got == [(1, 0, 0.6, 8, 4, 50.0)]  # 2's sweep is 0.3 degrees away; each ray of 0 meets two of 1, and two gates of each


def test_instants_as_columns(spark):
    """The column reads what the function reads, in any session time zone."""
    from stormlake.functions import times

    said = ["2024-05-20", " 2024-05-20T13:00 ", "2024-05-20 13:00:07", "2024-05-20T13:00:07Z", "2024-05-20T13:00:07.5+02:00", "2024-05-20T13:00:07.1234567-0530", "2024-05-20 13:00 Z", "2024-02-30", "2024-05-20T24:00", "2024-05-20T13:00:60", "2024-5-20", "", "now", "2024-05-20T13", "0000-01-01", "1969-12-31T23:59:59.999999Z", None]
    epoch = times.parse_iso("1970-01-01")
    want = [None if x is None or (at := times.parse_iso(x)) is None else round((at - epoch).total_seconds() * 1_000_000) for x in said]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Chicago"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r["us"] for r in rows.select("i", times.instant_us(F.col("x")).alias("us")).orderBy("i").collect()] == want, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_window_files_that_are_not_valid(spark):
    from stormlake.functions import times

    texts = ["", "[]", "12", "{", '{"from": 5, "to": "2024-01-02", "written": "2024-01-01"}', '{"from": "2024-01-01", "to": "2024-01-02"}', '{"from": "2024-01-03", "to": "2024-01-02", "written": "2024-01-01"}', '{"from": "2024-01-01", "to": "2024-01-02", "written": "2024-01-01", "live": 1}', None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert all(r["w"] is None for r in rows.select(times.window_in_force(F.col("x"), F.lit(1_704_067_200_000_000)).alias("w")).collect())
    assert times.window_is_stale(0, 86_400_001) and times.window_is_stale(86_400_001, 0) and not times.window_is_stale(86_400_000, 0)


def test_nearest_profiles_across_buckets(spark):
    """Own site first, however far within the hour; ties by id; profiles on the other side of a bucket's edge."""
    from stormlake.operators import scans
    from stormlake.operators.sql import run

    rng = __import__("random").Random(5)
    rows = [(rng.choice("ABC"), rng.randrange(0, 20) * 900_000_000, i, rng.choice((1, 1, 1, 2500))) for i in range(120)]
    got = {r["event_id"]: r["motion_id"] for r in run(scans.storm_motion_near(), scans=spark.createDataFrame(rows, "site string, ts_us long, event_id long, size long")).collect()}
    want = {}
    for site, at, i, _ in rows:
        near = [(s != site, abs(u - at), k) for s, u, k, size in rows if size >= 2000 and abs(u - at) <= 3_600_000_000]
        if near:
            want[i] = min(near)[2]
    assert got == want and len(got) > 60


def test_geometry(spark):
    row = spark.range(1).select(
        *[c.alias(n) for c, n in zip(geometry.project(35.9, -97.0, 35.0, -97.0), ("x", "y"), strict=True)],
        *[c.alias(n) for c, n in zip(geometry.unproject(40.0, 60.0, 35.0, -97.0), ("lat", "lon"), strict=True)],
        *[c.alias(n) for c, n in zip(geometry.elevation_of(80.0, geometry.height_km(80.0, 1.5)), ("elev", "slant"), strict=True)],
        geometry.direction_from(0.0, -10.0).alias("north"), geometry.direction_from(-10.0, 0.0).alias("east"), geometry.round_even(0.285, 2).alias("even"),
        geometry.interpolate(F.lit(5.0), F.array(F.lit(0.0), F.lit(10.0)), F.array(F.lit(1.0), F.lit(3.0))).alias("mid"), geometry.interpolate(F.lit(-5.0), F.array(F.lit(0.0), F.lit(10.0)), F.array(F.lit(1.0), F.lit(3.0))).alias("low"),
        geometry.convergence(35.0, -97.0, 35.0, -97.0).alias("turn"), geometry.trapezoid(F.lit(0.5), 0, 1, 2, 3).alias("ramp"), geometry.slant_km(80.0, 1.5).alias("r"),
    ).first()
    assert abs(row["x"]) < 1e-9 and abs(row["y"] - 100.075) < 0.01 and abs(row["elev"] - 1.5) < 1e-6 and abs(row["slant"] - row["r"]) < 1e-6
    back = spark.range(1).select(*geometry.project(row["lat"], row["lon"], 35.0, -97.0)).first()
    assert abs(back[0] - 40) < 1e-6 and abs(back[1] - 60) < 1e-6
    assert (row["north"], row["east"], row["even"], row["mid"], row["low"], row["ramp"]) == (0.0, 90.0, 0.28, 2.0, 1.0, 0.5) and abs(row["turn"]) < 1e-9


def test_tilts_of_a_volume(spark):
    sweeps = spark.createDataFrame([("A", 0, 0.5, 100), ("A", 1, 0.5, 100), ("A", 2, 1.5, 50), ("A", 3, 0.65, 120)], "site string, i long, elev double, gates long")
    assert [t["i"] for t in tilts.select_tilts(sweeps).first()["tilts"]] == [3, 2]


@pytest.mark.parametrize(("gate", "want"), [((45.0, 1.5, 0.99, -3.0, 0.8, 5.0, "below", 2.0), "RA"), ((60.0, 0.5, 0.97, -3.0, 0.8, 5.0, "below", 2.0), "RH"), ((20.0, 0.1, 0.99, -10.0, 0.5, 5.0, "above", 5.0), "DS"), ((38.0, 1.5, 0.92, -10.0, 0.5, 5.0, "within", 5.0), "WS"), ((15.0, 5.0, 0.6, -10.0, 2.0, 20.0, "below", 0.5), "BS"), ((45.0, 0.0, 0.7, -10.0, 5.0, 45.0, "below", 0.5), "GC")])
def test_canonical_gates(spark, gate, want):
    from stormlake.operators.sql import run

    table = spark.createDataFrame([(1, *gate)], "gate_id long, z double, zdr double, rho double, lkdp double, sdz double, sdphi double, layer string, elev double")
    assert hydrometeors.CLASSES[run(hydrometeors.classify(), gates=table).first()["code"] - 1] == want


def test_bindings_have_rows(spark):
    assert all(f(spark, SF).limit(1).count() for f, _ in BINDINGS.values())

"""Queries over crowded tables: results against brute force, and no operator that makes more rows than its input and result warrant."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stormlake.operators import columns, places, rays, scans, sections, tilts, tracking, views
from stormlake.operators.sql import run
from stormlake.plans import catalogue
from stormlake.plans.twins import TWINS

SCANS = "site string, ts_us long, event_id long, size long"


def most_rows(frame):
    """Rows that the busiest operator of a frame's plan made, and the collected rows."""
    found = frame.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        metric = p.metrics().get("numOutputRows")
        own = metric.get().value() if metric.isDefined() else 0
        under = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return max([own, *map(walk, under)])

    return walk(frame._jdf.queryExecution().executedPlan()), found


def shuffled_rows(frame):
    """Rows that a frame's plan sent through shuffles, and the collected rows."""
    found = frame.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        under = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return sum(map(walk, under)) + (p.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0)

    return walk(frame._jdf.queryExecution().executedPlan()), found


def events_of(spark, rows, folder):
    spark.createDataFrame(rows, SCANS).selectExpr("site AS event_type", "timestamp_micros(ts_us) AS ts", "event_id", "cast(size AS double) / 100 AS value").write.parquet(f"{folder}/events.parquet")


def crowd(n, span_s, seed=3):
    rng = random.Random(seed)
    return [(rng.choice("ABCD"), rng.randrange(span_s) * 1_000_000, i, rng.choice((100, 2500))) for i in range(n)]


def test_partners_of_a_crowd(spark):
    rows = crowd(300, 3000) + [("E", 5_000_000_000, 900, 1), ("A", 5_600_000_000, 901, 1), ("A", 4_400_000_000, 902, 1), ("B", 5_600_000_001, 903, 1), (None, 5_000_000_000, 904, 1)]
    got = {(r["event_id"], r["other_site"]): (r["other_id"], r["offset_us"]) for r in run(scans.mosaic_partners(), scans=spark.createDataFrame(rows, SCANS)).collect()}
    want = {}
    for s, at, i, _ in rows:
        for o, u, k, _ in rows:
            if None not in (s, o) and s != o and abs(u - at) <= 600_000_000:
                want[i, o] = min(want.get((i, o), (10**18,)), (abs(u - at), u, k, u - at))
    assert got == {key: (w[2], w[3]) for key, w in want.items()} and got[900, "A"] == (902, -600_000_000)


def test_partners_grow_with_the_scans(spark):
    rows = crowd(3000, 600)
    most, found = most_rows(run(scans.mosaic_partners(), scans=spark.createDataFrame(rows, SCANS)))
    assert len(found) == 3 * 3000 and most <= 4 * 3000


def test_skew_summary_grows_with_the_scans(spark, tmp_path):
    spark.createDataFrame(crowd(3000, 600), SCANS).selectExpr("site AS event_type", "timestamp_micros(ts_us) AS ts", "event_id", "cast(size AS double) / 100 AS value").write.parquet(f"{tmp_path}/events.parquet")
    most, found = most_rows(catalogue.QUERIES["skew_summary"](spark, str(tmp_path)))
    assert len(found) == 3000 and most <= 4 * 3000 and all(r["text"].count(", ") == 2 for r in found)


@pytest.mark.parametrize("name", ["mosaic_partners", "skew_summary"])
def test_partners_shuffle_scans_only(spark, tmp_path, name):
    """Not the rows that a scan has for every other site; with some more, of the ends of buckets."""
    events_of(spark, crowd(3000, 1800), tmp_path)
    sent, found = shuffled_rows(catalogue.QUERIES[name](spark, str(tmp_path)))
    assert len(found) in (3000, 9000) and sent < 1.1 * 3000


@pytest.mark.parametrize("shared", [1, 7])
def test_partners_of_ids_that_repeat(spark, tmp_path, shared):
    """Scans that share an id have one row for each other site; sites are many, some rows lack a site or a time."""
    rng = random.Random(5)
    rows = [(rng.choice(["A", "B", "C", *(f"S{k}" for k in range(20))]), 1_000_000 * rng.randrange(9000) - 4_000_000_000, i // shared, 1) for i in range(600)]
    rows += [(None, 0, 900, 1), ("A", None, 901, 1), ("A", 10**12, 902, 1), ("B", 10**12 + 600_000_000, 903, 1), ("C", 10**12 - 600_000_001, 904, 1)]
    events_of(spark, rows, tmp_path)
    want = {}
    for s, at, i, _ in rows:
        for o, u, k, _ in rows:
            if None not in (s, o, at, u) and s != o and abs(u - at) <= 600_000_000:
                want[i, o] = min(want.get((i, o), (10**18,)), (abs(u - at), u, k, u - at))
    got = catalogue.QUERIES["mosaic_partners"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["event_id"], r["other_site"]): (r["other_id"], r["offset_us"]) for r in got} == {key: (w[2], w[3]) for key, w in want.items()}
    said, texts = {}, catalogue.QUERIES["skew_summary"](spark, str(tmp_path)).collect()
    for (i, o), w in sorted(want.items()):
        said.setdefault(i, []).append(f"{o} {'-' if w[3] < 0 else '+'}{abs(w[3]) // 60_000_000}:{abs(w[3]) // 1_000_000 % 60:02d}")
    assert len(texts) == len(said) and {r["event_id"]: r["text"] for r in texts} == {i: ", ".join(t) for i, t in said.items()}


def test_no_window_is_worked_out_anew_for_each_row(spark):
    """A frame that ends with its partition is."""
    rows = spark.createDataFrame(crowd(20, 600), SCANS)
    for text in (scans.storm_motion_near(), scans.mosaic_partners()):
        assert "unboundedfollowing" not in run(text, scans=rows)._jdf.queryExecution().toString().lower()


SITES, POINTS = "site long, lat double, lon double", "point_id long, lat double, lon double"


def arc(a, b):
    """Great-circle km of (lat, lon)."""
    (p, x), (q, y) = (map(math.radians, c) for c in (a, b))
    return 2 * places.EARTH_KM * math.asin(min(1.0, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2)))


def spread(n, seed=7):
    """Sites on a coarse lattice, many at one place, some near a pole and the date line."""
    rng = random.Random(seed)
    lattice = [(k, 30.0 + rng.randrange(12), -100.0 + rng.randrange(12)) for k in range(n)]
    return [*lattice, (n, 89.5, 10.0), (n + 1, 89.0, -170.0), (n + 2, 10.0, 179.9), (n + 3, 10.5, -179.9), (n + 4, 10.0, 179.9)]


def test_nearest_radar_of_points_anywhere(spark):
    rng, sites = random.Random(1), spread(60)
    points = [(i, 30 + rng.randrange(240) / 20, -100 + rng.randrange(240) / 20) for i in range(150)] + [(200, 89.9, -80.0), (201, -60.0, 30.0), (202, 10.1, -179.99), (203, 10.2, 179.99), (204, 60.0, 0.0), (205, 0.0, 0.0)]
    got = {r["point_id"]: (r["site"], r["km"]) for r in run(places.nearest_radar(), points=spark.createDataFrame(points, POINTS), sites=spark.createDataFrame(sites, SITES)).collect()}
    want = {i: min((round(arc((lat, lon), (q, y)), 7), k) for k, q, y in sites) for i, lat, lon in points}
    assert {i: s for i, (s, _) in got.items()} == {i: k for i, (_, k) in want.items()} and all(abs(got[i][1] - want[i][0]) < 1e-4 for i in want)


def test_nearest_radar_makes_no_product(spark):
    rng = random.Random(2)
    sites = [(k, 25 + rng.random() * 24, -120 + rng.random() * 50) for k in range(1000)]
    points = [(i, 35 + rng.random(), -97 + rng.random()) for i in range(2000)]
    most, found = most_rows(run(places.nearest_radar(), points=spark.createDataFrame(points, POINTS), sites=spark.createDataFrame(sites, SITES)))
    assert len(found) == 2000 and most < 20_000


def test_mosaic_cells_make_no_product(spark):
    """Each of 900 cells is seen by the radar at its place, of 30 by a first one and of the others by a later one that shares the place."""
    sites = [(k + 1, 30.0 + k % 30, -100.0 + k % 30) for k in range(900)]
    points = [(k, 30.001 + k % 30, -100.0 + k % 30) for k in range(900)]
    most, found = most_rows(run(sections.neighbour_cells(), points=spark.createDataFrame(points, POINTS), sites=spark.createDataFrame(sites, SITES)))
    assert sorted(r["point_id"] for r in found) == list(range(30)) and most < 50_000


def test_cells_of_the_nearest_radar_against_all(spark):
    rng = random.Random(4)
    sites = [(k + 1, 25.0 + rng.randrange(48) / 2, -120.0 + rng.randrange(100) / 2) for k in range(12)]
    points = [(i, 25 + rng.random() * 24, -120 + rng.random() * 50) for i in range(600)]
    got = {r["point_id"] for r in run(sections.neighbour_cells(0.0), points=spark.createDataFrame(points, POINTS), sites=spark.createDataFrame(sites, SITES)).collect()}
    km = lambda p, s: math.sqrt((p[1] - s[1]) ** 2 + ((p[2] - s[2]) * math.cos(math.radians(p[1]))) ** 2)
    assert got == {p[0] for p in points if min((km(p, s), s[0]) for s in sites)[1] == p[0] % 12 + 1} and len(got) > 20


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_sites_that_share_places(spark, k):
    sites = spread(80)
    got = {(r["site"], r["rank"]): (r["other"], r["km"]) for r in run(places.nearest_sites(k, 300.0), sites=spark.createDataFrame(sites, SITES)).collect()}
    want = {}
    for a, *p in sites:
        near = sorted((round(arc(p, q), 4), b) for b, *q in sites if b != a and arc(p, q) <= 300)
        want |= {(a, r + 1): (b, km) for r, (km, b) in enumerate(near[:k])}
    assert got == want


def test_nearest_sites_rank_places(spark):
    sites = [(k, 35.0 + k % 3, -97.0) for k in range(600)]
    most, found = most_rows(run(places.nearest_sites(), sites=spark.createDataFrame(sites, SITES)))
    assert len(found) == 2400 and most <= 3600


@pytest.mark.parametrize("text", [places.neighbours(), places.offsets()])
def test_pairs_of_places_are_dealt(spark, text):
    """However small the table of sites, its pairs are made in many tasks, and what sites at one place share is worked out once."""
    sites = [(k, 35.0 + k % 3, -97.0) for k in range(60)]
    frame = run(text, sites=spark.createDataFrame(sites, SITES).coalesce(1))
    assert frame.rdd.getNumPartitions() >= places.TASKS and len(frame.collect()) == 60 * 59


def test_links_of_a_crowd_make_few_pairs(spark, monkeypatch):
    """Greedy links of 500 cells that all lie within reach of each other."""
    rng, made, plain = random.Random(9), [], tracking.checkpointed

    def counted(frame):
        made.append(plain(frame))
        return made[-1]

    monkeypatch.setattr(tracking, "checkpointed", counted)
    spot = lambda: (rng.random() * 9, rng.random() * 9)
    before, after = [(j, *spot(), rng.choice([10.0, 15.0])) for j in range(500)], [(i, *spot()) for i in range(500)]
    b = spark.createDataFrame([(1, *r) for r in before], "frame int, id long, px double, py double, reach_km double")
    a = spark.createDataFrame([(1, *r) for r in after], "frame int, id long, x double, y double")
    got = {(r["before_id"], r["after_id"]) for r in tracking.links(b, a, ["frame"]).collect()}
    want, jj, ii = set(), set(), set()
    for _, i, j in sorted((math.hypot(x - px, y - py), i, j) for j, px, py, reach in before for i, x, y in after if math.hypot(x - px, y - py) <= reach):
        if i not in ii and j not in jj:
            want.add((j, i))
            ii.add(i)
            jj.add(j)
    assert got == want and max(f.count() for f in made) < 20 * 500


def test_gates_at_the_very_edge_of_a_reach(spark, tmp_path):
    """Debris counts of 6000 places equal SQL, also where a gate lies three gates on along the same ray."""
    duckdb = pytest.importorskip("duckdb")
    spark.range(6000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["cell_rotation"](spark, str(tmp_path)).select("id", "rot", "n_debris").collect()
    c = duckdb.connect()
    for name in ("supplier", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.execute(f"SELECT id, rot, n_debris FROM ({catalogue.ORACLES['cell_rotation']}) q").fetchall())


def test_samples_at_edges_of_bins(spark):
    """Azimuths and ranges in tenths, every edge of a bin among them."""
    samples = [(k, k / 10.0, 0.2 + (k % 700) / 10.0) for k in range(3600)]
    radials = [(0, 0, a, [float(g) for g in range(64)]) for a in range(50)]
    frame = run(columns.point_samples(), samples=spark.createDataFrame(samples, "point_id long, az double, range_km double"), radials=spark.createDataFrame(radials, "vol long, tilt long, az long, v array<double>").withColumn("v", F.expr("transform(v, x -> x + 100 * az)")))
    got = {r["point_id"]: r["dbz"] for r in frame.collect()}
    assert got == {k: (k // 72) * 100.0 + math.floor(r + 0.5) - 1 for k, _, r in samples if 0.5 <= r < 64.5}


def partial():
    """A volume of two tilts, the lower one without its second ray, the upper one without its third."""
    return [(0, t, 0.5 + 1.2 * t, a, [10.0 + t] * 64) for t in range(2) for a in range(4) if (t, a) not in ((0, 1), (1, 2))]


def test_section_of_a_ray_that_a_tilt_lacks(spark):
    table = spark.createDataFrame(partial(), "vol long, tilt long, elev double, az long, v array<double>")
    got = {}
    for r in run(sections.cross_section(), radials=table, bins=spark.range(64).selectExpr("cast(id AS int) AS bin")).collect():
        got.setdefault(r["az"], {})[r["bin"], r["h_km"]] = r["value"]
    assert set(got) == {0, 1, 2, 3} and len({frozenset(v) for v in got.values()}) == 1
    assert {v for v in got[1].values()} == {None, 11.0} and {v for v in got[2].values()} == {None, 10.0}


def test_stack_of_a_ray_that_a_tilt_lacks(spark):
    stack = {r["az"]: r["layers"] for r in views.tilt_stack(spark.createDataFrame(partial(), "vol long, tilt long, elev double, az long, v array<double>")).collect()}
    assert {a: [(t["tilt"], round(t["elev"], 1), len(t["v"])) for t in layers] for a, layers in stack.items()} == {a: [(0, 0.5, 64), (1, 1.7, 64)] for a in range(4)}
    assert set(stack[1][0]["v"]) == {views.MISSING} and set(stack[1][1]["v"]) == {11.0} and set(stack[2][1]["v"]) == {views.MISSING}


def test_points_on_edges_as_in_sql(spark):
    """Every point of a lattice that corners and edges lie on."""
    duckdb = pytest.importorskip("duckdb")
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)]
    turned = [(-83.25, 41.0), (-84.9, 43.4), (-87.95, 43.925), (-88.475, 40.7), (-86.825, 38.525), (-83.9, 39.35), (-85.5, 40.75)]
    edges = [(n, *ring[k], *ring[(k + 1) % len(ring)]) for n, ring in enumerate((corners, turned)) for k in range(len(ring))]
    points = [(100 * i + j, j / 2 - 1, i / 2 - 1) for i in range(12) for j in range(12)] + [(5000 + k, y, x) for k, (x, y) in enumerate(turned)]
    c = duckdb.connect()
    c.execute("CREATE TABLE p (point_id BIGINT, lat DOUBLE, lon DOUBLE)")
    c.executemany("INSERT INTO p VALUES (?, ?, ?)", points)
    c.execute("CREATE TABLE e (ring_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", edges)
    want = set(c.execute(TWINS["points_in_polygons"].format(points="p", edges="e")).fetchall())
    frame = run(places.in_polygon(), points=spark.createDataFrame(points, POINTS), edges=spark.createDataFrame(edges, "ring_id long, x0 double, y0 double, x1 double, y1 double"))
    assert {tuple(r) for r in frame.select("point_id", "ring_id").collect()} == want


def test_phases_that_scatter_by_just_the_limit(spark):
    """Smoothed phases of the last four gates are 6 degrees off their mean, without a slope, at levels that running sums round."""
    phi = [183.1, 186.5, 183.5, 175.7, 203.6, 187.8, 189.7, 201.7]
    table = [(1, k, [round(x + 0.1 * k, 1) for x in phi], [0.99] * 8, [38.7, 54.4, 60.3, 17.7, 49.7, 32.1, 73.0, 29.7]) for k in range(300)]
    frame = spark.createDataFrame(table, "vol int, az int, phi array<double>, rho array<double>, z array<double>")
    assert {tuple(round(x, 9) + 0.0 if x is not None else x for x in r["kdp"][-2:]) for r in rays.specific_phase(frame, ["vol"], 1000.0).collect()} == {(0.0, 0.0)}


def test_tilts_of_many_sweeps(spark):
    """Against a fold sweep by sweep; a chunk's edge, sweeps without gates and elevations that many share. The fold's steps are the elevations."""
    rng = random.Random(11)
    rows = [("A", i, rng.randrange(1500) / 10, rng.choice((None, *range(40)))) for i in range(9000)]
    kept = []
    for _, i, elev, gates in sorted(rows, key=lambda r: (r[2], r[1])):
        if kept and elev - kept[-1][0] < 0.2:
            last = kept[-1]
            if None not in (gates, last[2]) and (gates, i) > (last[2], last[1]):
                kept[-1] = (elev, i, gates)
        else:
            kept.append((elev, i, gates))
    frame = tilts.select_tilts(spark.createDataFrame(rows, "site string, i long, elev double, gates long"))
    assert [tuple(t) for t in frame.first()["tilts"]] == kept
    assert "apart" in frame._jdf.queryExecution().toString()


def test_archive_drops_no_duplicates_where_there_are_none(spark, tmp_path, monkeypatch):
    """Texts that aren't repeated, as the manifest tells, are not dealt once more to be compared."""
    from jobs import archive_bulletins

    plans, plain = [], archive_bulletins.F.pmod
    monkeypatch.setattr(archive_bulletins.F, "pmod", lambda *a: plans.append(1) or plain(*a))
    spark.createDataFrame([(k, f"text {k}", "s", "en") for k in range(50)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/d")
    dropped = []
    real = type(spark.range(1)).dropDuplicates
    monkeypatch.setattr(type(spark.range(1)), "dropDuplicates", lambda self, *a: dropped.append(self.columns) or real(self, *a))
    done = archive_bulletins.archive(spark, archive_bulletins.Config(f"{tmp_path}/d", f"{tmp_path}/out", 1.0))
    assert done["kept"] == 50 and plans and not any("text" in c for c in dropped)

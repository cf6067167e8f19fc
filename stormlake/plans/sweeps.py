"""Queries over whole sweeps, with twins that flood, join gates with gates and sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake.functions.constants import EARTH_43_M, KE_A_KM
from stormlake.operators import echoes, lines, rays, tracking, views
from stormlake.operators.sql import oracle
from stormlake.plans.bindings import BINDINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N_AZ, GATES = 50, 64


def _query(name: str, twin: str, *tables: str) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        ORACLES[name] = oracle(twin, **{t: BINDINGS[t][1] for t in tables})
        return function

    return add


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BINDINGS["moments"][0](spark, sf_dir)


def _gates(rows: DataFrame, column: str) -> DataFrame:
    """Valid gates of an array column, one row each; an outer explode, as a plain one would have its array worked out once more for a filter below."""
    return rows.select("vol", "tilt", "az", F.posexplode_outer(column).alias("bin", column)).filter(F.col(column).isNotNull()).withColumns({"az": F.col("az").cast("bigint"), "bin": F.col("bin").cast("bigint"), column: F.round(column, 4)})


# gate by gate: which gates reach which, at each level
_FLOOD = """WITH RECURSIVE gates AS (SELECT vol, tilt, az, bin, x, level, lvl FROM (SELECT vol, tilt, az, unnest(range(64)) AS bin, unnest(v) AS x FROM {radials}) q, (VALUES (0, 40), (1, 50), (2, 60)) l(level, lvl) WHERE x >= lvl),
    flood(vol, tilt, level, az0, bin0, az, bin) AS (SELECT vol, tilt, level, az, bin, az, bin FROM gates
        UNION SELECT f.vol, f.tilt, f.level, f.az0, f.bin0, n.az, n.bin FROM flood f JOIN gates n ON n.vol = f.vol AND n.tilt = f.tilt AND n.level = f.level AND ((n.bin = f.bin AND n.az IN ((f.az + 1) % 50, (f.az + 49) % 50)) OR (n.az = f.az AND abs(n.bin - f.bin) = 1))),
    owned AS (SELECT vol, tilt, level, az, bin, min(az0 * 1048576 + bin0) AS root FROM flood GROUP BY vol, tilt, level, az, bin),
    full_ AS (SELECT o.*, g.x, power(10, g.x / 10) AS w, (o.bin + 1) * pi() / 25 AS area, (o.bin + 1) * sin((o.az + 0.5e0) * pi() / 25) AS e, (o.bin + 1) * cos((o.az + 0.5e0) * pi() / 25) AS n, u.root AS parent
        FROM owned o JOIN gates g USING (vol, tilt, level, az, bin) LEFT JOIN owned u ON u.vol = o.vol AND u.tilt = o.tilt AND u.level = o.level - 1 AND u.az = o.az AND u.bin = o.bin),
    regions AS (SELECT vol, tilt, level, root, any_value(parent) AS parent, count(*) AS n_gates, sum(area) AS area, max(x) AS top, sum(w * e) / sum(w) AS x, sum(w * n) / sum(w) AS y FROM full_ GROUP BY vol, tilt, level, root)"""


@_query("echo_regions", _FLOOD + " SELECT vol, tilt, level, root, parent, n_gates, round(area, 3) AS area_km2, top AS max_dbz, round(x, 3) AS x_km, round(y, 3) AS y_km FROM regions", "radials")
def echo_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected echo of each sweep at 40, 50 and 60 dBZ, and the region below that holds each."""
    found = echoes.regions(BINDINGS["radials"][0](spark, sf_dir), ["vol", "tilt"], N_AZ)
    return found.withColumns({c: F.round(c, 3) for c in ("area_km2", "x_km", "y_km")})


@_query("echo_cells", _FLOOD + """, big AS (SELECT * FROM regions WHERE area >= 8), cores AS (SELECT vol, tilt, level - 1 AS level, parent AS root, count(*) AS n FROM big WHERE level > 0 GROUP BY ALL),
    tree(vol, tilt, level, root, ends) AS (SELECT vol, tilt, level, root, coalesce(n, 0) < 2 FROM big LEFT JOIN cores USING (vol, tilt, level, root) WHERE level = 0
        UNION ALL SELECT b.vol, b.tilt, b.level, b.root, coalesce(c.n, 0) < 2 FROM tree t JOIN big b ON NOT t.ends AND b.vol = t.vol AND b.tilt = t.tilt AND b.level = t.level + 1 AND b.parent = t.root LEFT JOIN cores c ON c.vol = b.vol AND c.tilt = b.tilt AND c.level = b.level AND c.root = b.root),
    said AS (SELECT r.vol, r.tilt, r.level, r.root, r.n_gates, round(r.area, 1) AS area_km2, round(r.top, 1) AS max_dbz, round(r.x, 2) AS x_km, round(r.y, 2) AS y_km FROM regions r JOIN tree t USING (vol, tilt, level, root) WHERE t.ends)
    SELECT a.*, 1 + (SELECT count(*) FROM said b WHERE b.vol = a.vol AND b.tilt = a.tilt AND (b.max_dbz > a.max_dbz OR (b.max_dbz = a.max_dbz AND (b.area_km2 > a.area_km2 OR (b.area_km2 = a.area_km2 AND (b.level, b.root) < (a.level, a.root)))))) AS rank FROM said a""", "radials")
def echo_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm cells of each sweep, split where a region has two cores or more."""
    found = echoes.regions(BINDINGS["radials"][0](spark, sf_dir), ["vol", "tilt"], N_AZ)
    return echoes.cells(found, ["vol", "tilt"])


@_query("azimuthal_shear", """WITH g AS (SELECT vol, tilt, az, bin, vel, (bin + 1) * 1e3 * 2 * pi() / 50 AS ds, least(10, greatest(1, cast(round(75e1 / ((bin + 1) * 1e3 * 2 * pi() / 50)) AS int))) AS n FROM {moments}),
    met AS (SELECT a.vol, a.tilt, a.az, a.bin, b.vel AS y, k.k * a.ds AS x, k.k, (2 * a.n + 1) * (least(a.bin + 1, 63) - greatest(a.bin - 1, 0) + 1) AS size FROM g a, (SELECT unnest(range(-10, 11)) AS k) k, g b
        WHERE a.vel IS NOT NULL AND a.bin >= 1 AND abs(k.k) <= a.n AND b.vol = a.vol AND b.tilt = a.tilt AND b.az = (a.az + k.k + 50) % 50 AND b.bin BETWEEN a.bin - 1 AND a.bin + 1 AND b.vel IS NOT NULL),
    fits AS (SELECT vol, tilt, az, bin, regr_slope(y, x) AS slope, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, count(*) AS n FROM met GROUP BY vol, tilt, az, bin, size HAVING 2 * count(*) >= size AND min(k) < 0 AND max(k) > 0)
    SELECT vol, tilt, az, bin, round(slope * 1000, 4) AS shear FROM fits WHERE sqrt(greatest(syy - slope * sxy, 0) / n) <= 6""", "moments")
def azimuthal_shear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(rays.azimuthal_shear(_moments(spark, sf_dir).withColumn("v", F.col("vel")), ["vol", "tilt"], N_AZ, GATES), "shear")


@_query("specific_phase", """WITH RECURSIVE t AS (SELECT vol, tilt, az, bin, phi, row_number() OVER (PARTITION BY vol, tilt, az ORDER BY bin) AS k FROM {moments} WHERE phi IS NOT NULL AND rho >= 0.9e0 AND z >= 20),
    turned(vol, tilt, az, bin, k, p) AS (SELECT vol, tilt, az, bin, k, phi FROM t WHERE k = 1
        UNION ALL SELECT t.vol, t.tilt, t.az, t.bin, t.k, t.phi + 360 * CASE WHEN p.p - t.phi > 270 THEN ceil((p.p - t.phi - 270) / 360) WHEN t.phi - p.p > 270 THEN -ceil((t.phi - p.p - 270) / 360) ELSE 0 END FROM turned p JOIN t ON t.vol = p.vol AND t.tilt = p.tilt AND t.az = p.az AND t.k = p.k + 1),
    clean AS (SELECT a.vol, a.tilt, a.az, a.bin, list_sort(list(b.p))[count(*) // 2 + 1] AS p FROM turned a JOIN turned b ON b.vol = a.vol AND b.tilt = a.tilt AND b.az = a.az AND abs(b.bin - a.bin) <= 2 GROUP BY a.vol, a.tilt, a.az, a.bin),
    reach AS (SELECT c.*, CASE WHEN m.z >= 40 THEN 2 ELSE 3 END AS h FROM clean c JOIN {moments} m USING (vol, tilt, az, bin)),
    fits AS (SELECT a.vol, a.tilt, a.az, a.bin, regr_slope(b.p, b.bin) AS slope, regr_syy(b.p, b.bin) AS syy, regr_sxy(b.p, b.bin) AS sxy, count(*) AS n FROM reach a JOIN clean b ON b.vol = a.vol AND b.tilt = a.tilt AND b.az = a.az AND abs(b.bin - a.bin) <= a.h
        GROUP BY a.vol, a.tilt, a.az, a.bin, a.h HAVING 3 * count(*) >= 2 * (least(a.bin + a.h, 63) - greatest(a.bin - a.h, 0) + 1) AND count(*) > 1)
    SELECT vol, tilt, az, bin, round(greatest(-2, least(10, slope / 2)), 4) AS kdp FROM fits WHERE sqrt(greatest(syy - slope * sxy, 0) / n) <= 6""", "moments")
def specific_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(rays.specific_phase(_moments(spark, sf_dir), ["vol", "tilt"]), "kdp")


@_query("phase_texture", """WITH w AS (SELECT a.vol, a.tilt, a.az, a.bin, least(a.bin + 2, 63) - greatest(a.bin - 2, 0) + 1 AS size, degrees(atan2(sin(radians(b.phi - a.phi)), cos(radians(b.phi - a.phi)))) AS d
        FROM {moments} a JOIN {moments} b ON b.vol = a.vol AND b.tilt = a.tilt AND b.az = a.az AND b.bin BETWEEN a.bin - 2 AND a.bin + 2 WHERE a.phi IS NOT NULL AND b.phi IS NOT NULL)
    SELECT vol, tilt, az, bin, round(stddev_pop(CASE WHEN abs(d - 180) < 1e-6 THEN -18e1 ELSE d END), 4) AS texture FROM w GROUP BY vol, tilt, az, bin, size HAVING 2 * count(*) >= size""", "moments")
def phase_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(_moments(spark, sf_dir).withColumn("texture", rays.phase_texture()), "texture")


@_query("bright_band", f"""WITH h AS (SELECT vol, sqrt(power(r * cos(radians(elev)), 2) + power({EARTH_43_M!r}e0 + r * sin(radians(elev)), 2)) - {EARTH_43_M!r}e0 AS h FROM (SELECT *, (bin + 1) * 1e3 AS r FROM {{moments}}) q
        WHERE elev BETWEEN 35e-1 AND 105e-1 AND bin BETWEEN 4 AND 79 AND rho BETWEEN 9e-1 AND 97e-2 AND z BETWEEN 30 AND 47 AND zdr BETWEEN 8e-1 AND 25e-1),
    l AS (SELECT vol, list_sort(list(h)) AS l, count(*) AS n FROM h GROUP BY vol),
    p AS (SELECT vol, n, l[cast(floor((n - 1) * 1e-1 + 0.5e0) AS int) + 1] AS a, l[cast(floor((n - 1) * 25e-2 + 0.5e0) AS int) + 1] AS b, l[cast(floor((n - 1) * 75e-2 + 0.5e0) AS int) + 1] AS c, l[cast(floor((n - 1) * 9e-1 + 0.5e0) AS int) + 1] AS d FROM l)
    SELECT vol, n, round(b, 2) AS quarter_m, round(c, 2) AS three_quarters_m, CASE WHEN n >= 300 AND c - b <= 1000 THEN cast(floor(a + 0.5e0) AS bigint) END AS bottom_m, CASE WHEN n >= 300 AND c - b <= 1000 THEN cast(floor(d + 0.5e0) AS bigint) END AS top_m, n >= 300 AND c - b <= 1000 AS found FROM p""", "moments")
def bright_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rays.bright_band(_moments(spark, sf_dir), ["vol"])


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of ten frames, two of three with a motion."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("bigint").alias("id"), (k % 10).cast("bigint").alias("frame"), ((k * 37) % 2411 / 10).alias("x"), ((k * 53) % 5003 / 20).alias("y"))
    motion = lambda n: F.when(F.col("id") % 3 > 0, ((F.col("id") * n) % 61 - 30).cast("double"))
    return rows.withColumns({"u": motion(7), "v": motion(11), "dt_s": F.lit(300)})


_FRAMES = "cells AS (SELECT c_custkey AS id, c_custkey % 10 AS frame, (c_custkey * 37) % 2411 / 1e1 AS x, (c_custkey * 53) % 5003 / 2e1 AS y, CASE WHEN c_custkey % 3 > 0 THEN ((c_custkey * 7) % 61 - 30)::double END AS u, CASE WHEN c_custkey % 3 > 0 THEN ((c_custkey * 11) % 61 - 30)::double END AS v FROM customer)"


@_query("cell_links", f"""WITH RECURSIVE {_FRAMES},
    pairs AS (SELECT b.frame, b.id AS j, a.id AS i, sqrt(power(a.x - b.x - coalesce(b.u, 0) * 3e-1, 2) + power(a.y - b.y - coalesce(b.v, 0) * 3e-1, 2)) AS km FROM cells b JOIN cells a ON a.frame = b.frame + 1 WHERE sqrt(power(a.x - b.x - coalesce(b.u, 0) * 3e-1, 2) + power(a.y - b.y - coalesce(b.v, 0) * 3e-1, 2)) <= CASE WHEN b.u IS NULL THEN 15 ELSE 10 END),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY km, i, j) AS k FROM pairs),
    walk(frame, k, ii, jj, i, j, km, taken) AS (SELECT frame, k, [i], [j], i, j, km, true FROM ranked WHERE k = 1
        UNION ALL SELECT r.frame, r.k, CASE WHEN list_contains(w.ii, r.i) OR list_contains(w.jj, r.j) THEN w.ii ELSE list_append(w.ii, r.i) END, CASE WHEN list_contains(w.ii, r.i) OR list_contains(w.jj, r.j) THEN w.jj ELSE list_append(w.jj, r.j) END,
            r.i, r.j, r.km, NOT (list_contains(w.ii, r.i) OR list_contains(w.jj, r.j)) FROM walk w JOIN ranked r ON r.frame = w.frame AND r.k = w.k + 1)
    SELECT frame, j AS before_id, i AS after_id, round(km, 4) AS km FROM walk WHERE taken""")
def cell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each frame that go on in the next."""
    cells = _frames(spark, sf_dir)
    found = tracking.links(tracking.predicted(cells), cells.withColumn("frame", F.col("frame") - 1), ["frame"])
    return found.withColumn("km", F.round("km", 4))


@_query("cell_rotation", """WITH cells AS (SELECT point_id AS id, point_id % (SELECT max(vol) + 1 FROM {radials}) AS vol, point_id % 10 AS tilt, range_km * sin(radians(az)) AS x, range_km * cos(radians(az)) AS y FROM {samples}),
    gates AS (SELECT vol, tilt, az, bin, vel AS rot, z, rho - 15e-2 AS rho, zdr - 1 AS zdr, (bin + 1) * sin((az + 0.5e0) * pi() / 25) AS x, (bin + 1) * cos((az + 0.5e0) * pi() / 25) AS y FROM {moments}),
    met AS (SELECT c.id, g.* FROM cells c JOIN gates g ON g.vol = c.vol AND g.tilt = c.tilt AND sqrt(power(g.x - c.x, 2) + power(g.y - c.y, 2)) <= 8 WHERE g.rot IS NOT NULL),
    best AS (SELECT vol, tilt, id, max_by({'rot': rot, 'az': az, 'bin': bin, 'x': x, 'y': y}, (rot, az, bin)) AS m FROM met GROUP BY ALL),
    lofted AS (SELECT b.vol, b.tilt, b.id, count(*) AS n FROM best b JOIN gates g ON g.vol = b.vol AND g.tilt = b.tilt AND sqrt(power(g.x - b.m.x, 2) + power(g.y - b.m.y, 2)) <= 3 WHERE b.m.rot >= 10 AND g.z >= 40 AND g.rho <= 8e-1 AND g.zdr <= 5e-1 GROUP BY ALL)
    SELECT c.vol, c.tilt, c.id, greatest(coalesce(b.m.rot, 0), 0) AS rot, b.m.az AS peak_az, b.m.bin AS peak_gate, coalesce(l.n, 0) AS n_debris, coalesce(l.n, 0) >= 6 AS debris FROM cells c LEFT JOIN best b USING (vol, tilt, id) LEFT JOIN lofted l USING (vol, tilt, id)""", "radials", "samples", "moments")
def cell_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest rotation and debris around places of sweeps."""
    sweeps = _moments(spark, sf_dir)
    n = sweeps.agg(F.max("vol") + 1).first()[0]
    places = BINDINGS["samples"][0](spark, sf_dir).select((F.col("point_id") % n).alias("vol"), (F.col("point_id") % 10).alias("tilt"), F.col("point_id").alias("id"), (F.col("range_km") * F.sin(F.radians("az"))).alias("x_km"), (F.col("range_km") * F.cos(F.radians("az"))).alias("y_km"))
    turned = sweeps.select("vol", "tilt", "az", F.col("vel").alias("rot"), "z", F.transform("rho", lambda x: x - 0.15).alias("rho"), F.transform("zdr", lambda x: x - 1).alias("zdr"))
    return tracking.rotation(places, turned, ["vol", "tilt"], N_AZ)


_K = f"{KE_A_KM}e0"
_LOOKS = """looks AS (SELECT c_custkey AS ray_id, c_custkey % (SELECT max(vol) + 1 FROM {radials}) AS vol, (c_custkey * 37) % 1201 / 1e1 - 60 AS x, (c_custkey * 53) % 1201 / 1e1 - 60 AS y, (c_custkey * 29) % 150 / 1e1 AS z,
    cos(radians((c_custkey * 11) % 80 - 60)) * sin(radians(c_custkey * 7 % 360)) AS dx, cos(radians((c_custkey * 11) % 80 - 60)) * cos(radians(c_custkey * 7 % 360)) AS dy, sin(radians((c_custkey * 11) % 80 - 60)) AS dz FROM customer)"""
_ELEVATION = lambda t: f"atan2((z + dz * {t}) * cos(sqrt(power(x + dx * {t}, 2) + power(y + dy * {t}, 2)) / {_K}) - 2 * {_K} * power(sin(sqrt(power(x + dx * {t}, 2) + power(y + dy * {t}, 2)) / {_K} / 2), 2), ({_K} + z + dz * {t}) * sin(sqrt(power(x + dx * {t}, 2) + power(y + dy * {t}, 2)) / {_K}))"


# by small steps along the ray and the elevation seen from the radar, then by halves
@_query("ray_picks", f"""WITH RECURSIVE {_LOOKS},
    steps AS (SELECT l.*, i, {_ELEVATION("(i * 5e-2)")} AS e0 FROM looks l, (SELECT unnest(range(0, 4001)) AS i) s WHERE abs(z + dz * i * 5e-2) < 40 AND power(x + dx * i * 5e-2, 2) + power(y + dy * i * 5e-2, 2) < 4300),
    pairs AS (SELECT *, lead(e0) OVER (PARTITION BY ray_id ORDER BY i) AS e1, lead(i) OVER (PARTITION BY ray_id ORDER BY i) AS j FROM steps),
    crossed AS (SELECT p.*, t.tilt, t.elev FROM pairs p JOIN (SELECT DISTINCT vol, tilt, elev FROM {{radials}}) t ON t.vol = p.vol AND p.j = p.i + 1 AND (radians(t.elev) BETWEEN least(e0, e1) AND greatest(e0, e1))),
    halved(ray_id, vol, x, y, z, dx, dy, dz, tilt, elev, up, a, b, n) AS (SELECT ray_id, vol, x, y, z, dx, dy, dz, tilt, elev, e1 > e0, i * 5e-2, j * 5e-2, 0 FROM crossed
        UNION ALL SELECT ray_id, vol, x, y, z, dx, dy, dz, tilt, elev, up, CASE WHEN ({_ELEVATION("((a + b) / 2)")} < radians(elev)) = up THEN (a + b) / 2 ELSE a END, CASE WHEN ({_ELEVATION("((a + b) / 2)")} < radians(elev)) = up THEN b ELSE (a + b) / 2 END, n + 1 FROM halved WHERE n < 48),
    hits AS (SELECT *, x + dx * a AS px, y + dy * a AS py, z + dz * a AS h, sqrt(power(x + dx * a, 2) + power(y + dy * a, 2)) AS s FROM halved WHERE n = 48 AND z + dz * a >= 0),
    placed AS (SELECT *, (degrees(atan2(px, py)) + 360) % 360 AS az, {_K} * sin(s / {_K}) / cos(radians(elev) + s / {_K}) AS r FROM hits WHERE sqrt(power(px - 30, 2) + power(py - 25, 2)) >= s),
    met AS (SELECT p.*, r.v[cast(floor(p.r + 0.5e0) AS int)] AS value FROM placed p JOIN {{radials}} r ON r.vol = p.vol AND r.tilt = p.tilt AND r.az = floor(p.az / 72e-1) WHERE p.r >= 0.5e0 AND p.r < 64.5e0)
    SELECT vol, ray_id, tilt, round(a, 3) AS t, round(az, 3) AS az_deg, round(r, 3) AS slant_km, round(s, 3) AS ground_km, round(h, 3) AS height_km, value FROM met WHERE value >= 20 QUALIFY row_number() OVER (PARTITION BY ray_id ORDER BY a, tilt) = 1""", "radials")
def ray_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate that each of many lines of sight meets, beside another radar."""
    sweeps = BINDINGS["radials"][0](spark, sf_dir)
    n = sweeps.agg(F.max("vol") + 1).first()[0]
    k = F.col("c_custkey").cast("bigint")
    pitch, turn = F.radians((k * 11) % 80 - 60), F.radians(k * 7 % 360)
    looks = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("ray_id"), (k % n).alias("vol"), ((k * 37) % 1201 / 10 - 60).alias("x"), ((k * 53) % 1201 / 10 - 60).alias("y"), ((k * 29) % 150 / 10).alias("z"), (F.cos(pitch) * F.sin(turn)).alias("dx"), (F.cos(pitch) * F.cos(turn)).alias("dy"), F.sin(pitch).alias("dz"))
    others = sweeps.select("vol").distinct().select("vol", F.lit(30.0).alias("x"), F.lit(25.0).alias("y"))
    found = views.pick(looks, sweeps, ["vol"], N_AZ, others, least=20.0)
    return found.withColumns({c: F.round(c, 3) for c in ("t", "az_deg", "slant_km", "ground_km", "height_km")})


_BORDERS = """k AS (SELECT c_custkey AS k, c_custkey // 60 + cos(radians(6 * (c_custkey % 60))) * (1 + (c_custkey * 37) % 11 / 4e1) AS x, sin(radians(6 * (c_custkey % 60))) * (1 + (c_custkey * 53) % 13 / 5e1) AS y FROM customer),
    said AS (SELECT k AS a, CASE WHEN k % 60 BETWEEN 1 AND 58 THEN k + 1 WHEN k % 60 = 59 THEN CASE WHEN k // 60 % 2 = 0 THEN k - 58 ELSE k + 1 END END AS b FROM k UNION SELECT k, k + 60 FROM k WHERE k % 180 = 25),
    seg AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM said SEMI JOIN (SELECT k AS b FROM k) e USING (b))"""


# walked from every junction to both sides, then cut in two again and again
@_query("border_lines", f"""WITH RECURSIVE {_BORDERS}, d AS (SELECT a AS u, b AS v FROM seg UNION ALL SELECT b, a FROM seg), j AS (SELECT u FROM d GROUP BY u HAVING count(*) <> 2),
    flood(v0, v) AS (SELECT DISTINCT u, u FROM d UNION SELECT f.v0, d.v FROM flood f JOIN d ON d.u = f.v WHERE f.v NOT IN (SELECT u FROM j)),
    stops AS (SELECT u FROM j UNION SELECT min(v) FROM flood GROUP BY v0 HAVING NOT bool_or(v IN (SELECT u FROM j))),
    walk(f, s, pos, p, v) AS (SELECT s.u, d.v, 1, s.u, d.v FROM stops s JOIN d ON d.u = s.u UNION ALL SELECT w.f, w.s, w.pos + 1, w.v, d.v FROM walk w JOIN d ON d.u = w.v AND d.v <> w.p WHERE w.v NOT IN (SELECT u FROM stops)),
    whole_ AS (SELECT f, s, max(pos) AS n, arg_max(v, pos) AS lf, arg_max(p, pos) AS ls FROM walk GROUP BY f, s),
    pts AS MATERIALIZED (SELECT q.f, q.s, q.pos, q.v, k.x, k.y, w.n FROM (SELECT f, s, pos, v FROM walk UNION ALL SELECT DISTINCT f, s, 0, f FROM walk) q JOIN whole_ w ON w.f = q.f AND w.s = q.s AND (w.f, w.s) < (w.lf, w.ls) JOIN k ON k.k = q.v),
    cut_(f, s, lo, hi, depth) AS (SELECT DISTINCT f, s, 0, n, 0 FROM pts
        UNION ALL SELECT f, s, unnest([lo, far]) AS lo, unnest([far, hi]) AS hi, depth + 1 FROM (
            SELECT c.f, c.s, c.lo, c.hi, c.depth, arg_max(p.pos, (CASE WHEN a.x = b.x AND a.y = b.y THEN sqrt(power(p.x - a.x, 2) + power(p.y - a.y, 2)) ELSE abs((p.x - a.x) * (b.y - a.y) - (p.y - a.y) * (b.x - a.x)) / sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) END, -p.pos)) AS far,
                max(CASE WHEN a.x = b.x AND a.y = b.y THEN 1e9 ELSE abs((p.x - a.x) * (b.y - a.y) - (p.y - a.y) * (b.x - a.x)) / sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) END) AS d
            FROM cut_ c JOIN pts p ON p.f = c.f AND p.s = c.s AND p.pos > c.lo AND p.pos < c.hi JOIN pts a ON a.f = c.f AND a.s = c.s AND a.pos = c.lo JOIN pts b ON b.f = c.f AND b.s = c.s AND b.pos = c.hi GROUP BY c.f, c.s, c.lo, c.hi, c.depth) q WHERE d > 12e-2),
    kept AS (SELECT f, s, lo AS pos FROM cut_ UNION SELECT f, s, hi FROM cut_), ends AS (SELECT f, s, pos, lead(pos) OVER (PARTITION BY f, s ORDER BY pos) AS next FROM kept)
    SELECT DISTINCT least(a.v, b.v) AS a, greatest(a.v, b.v) AS b FROM ends e JOIN pts a ON a.f = e.f AND a.s = e.s AND a.pos = e.pos JOIN pts b ON b.f = e.f AND b.s = e.s AND b.pos = e.next WHERE a.v <> b.v""")
def border_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings, paths and links between them, simplified between their junctions."""
    k = F.col("k")
    angle = F.radians(6 * (k % 60))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("k"))
    vertices = customers.select(k.alias("vertex"), (F.floor(k / 60) + F.cos(angle) * (1 + (k * 37) % 11 / 40)).alias("x"), (F.sin(angle) * (1 + (k * 53) % 13 / 50)).alias("y"))
    on = F.when((k % 60).between(1, 58), k + 1).when(k % 60 == 59, F.when(F.floor(k / 60) % 2 == 0, k - 58).otherwise(k + 1))
    said = customers.select(k.alias("a"), F.explode(F.filter(F.array(on, F.when(k % 180 == 25, k + 60)), lambda b: b.isNotNull())).alias("b"))
    return lines.simplified_lines(vertices, said.join(customers.select(k.alias("b")), "b", "left_semi"), 0.12)

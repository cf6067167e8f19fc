"""Sampling between tilts, along rays and over the ground, as SQL.

Tables as in ``columns``: radials(vol, tilt, elev, az, v), bins(bin).
"""

from __future__ import annotations

from stormlake.functions.constants import KE_A_KM
from stormlake.operators.places import nearest_of

K = f"{KE_A_KM}e0"
HALF_BEAM = "0.475e0"


def cross_section(top_km: int = 14) -> str:
    """(vol, az, bin, h_km, value) on a vertical plane: each point's elevation and slant range, the two tilts around it and
    their gates.

    Both valid: blended by elevation; one valid: it, within half a beam of its tilt; else null. Points under the lowest or
    over the highest tilt by half a beam take that tilt. A volume's rays are those of all of its tilts: one that a tilt lacks is
    missing there. Tilts are few, so their bands are a broadcast range join.
    """
    phi = f"((g.bin + 1e0) / {K})"
    return f"""
    WITH tilts AS (SELECT vol, tilt, min(elev) AS elev FROM {{radials}} GROUP BY vol, tilt),
    bands AS (SELECT vol, tilt, elev, lead(tilt) OVER (PARTITION BY vol ORDER BY tilt) AS tilt1, lead(elev) OVER (PARTITION BY vol ORDER BY tilt) AS elev1,
        CASE WHEN row_number() OVER (PARTITION BY vol ORDER BY tilt) = 1 THEN elev - {HALF_BEAM} ELSE elev END AS lo,
        coalesce(lead(elev) OVER (PARTITION BY vol ORDER BY tilt), elev + {HALF_BEAM}) AS hi FROM tilts),
    places AS (SELECT g.bin, h.bin AS h_km, degrees(atan2(z, x)) AS elev, sqrt(x * x + z * z) AS slant FROM (
        SELECT g.bin, h.bin AS hb, ({K} + h.bin) * sin{phi} AS x, h.bin * cos{phi} - 2e0 * {K} * power(sin({phi} / 2e0), 2) AS z FROM {{bins}} g CROSS JOIN {{bins}} h WHERE h.bin <= {top_km}) g JOIN {{bins}} h ON h.bin = g.hb),
    banded AS (SELECT b.vol, p.bin, p.h_km, p.elev, b.tilt, b.elev AS e0, b.tilt1, b.elev1 AS e1, CASE WHEN p.slant >= 0.5e0 AND p.slant < 64.5e0 THEN cast(floor(p.slant - 0.5e0) AS int) END AS gate
        FROM places p JOIN bands b ON p.elev >= b.lo AND p.elev < b.hi),
    rays AS (SELECT DISTINCT vol, az FROM {{radials}}),
    filled AS (SELECT t.vol, t.tilt, z.az, r.v FROM tilts t JOIN rays z ON z.vol = t.vol LEFT JOIN {{radials}} r ON r.vol = t.vol AND r.tilt = t.tilt AND r.az = z.az),
    sampled AS (SELECT s.*, r.az, {{gate:r.v:s.gate}} AS va FROM banded s JOIN filled r ON r.vol = s.vol AND r.tilt = s.tilt),
    paired AS (SELECT s.vol, s.az, s.bin, s.h_km, s.elev, s.e0, s.e1, s.va, CASE WHEN s.elev >= s.e0 THEN {{gate:r.v:s.gate}} END AS vb FROM sampled s LEFT JOIN {{radials}} r ON r.vol = s.vol AND r.tilt = s.tilt1 AND r.az = s.az)
    SELECT vol, az, bin, h_km, round(CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN va + (vb - va) * (elev - e0) / (e1 - e0) WHEN va IS NOT NULL AND elev - e0 < {HALF_BEAM} THEN va
        WHEN vb IS NOT NULL AND e1 - elev < {HALF_BEAM} THEN vb END, 4) AS value FROM paired"""


def tilt_resample() -> str:
    """Each tilt's gates beside those of the tilt below at equal ground range over a flat earth, and how many differ by
    more than 20. A ray reads the one below it by a window over whole rays, and counts its own gates before the shuffle."""
    return """
    WITH stacked AS (SELECT vol, tilt, v, elev, lag(tilt) OVER w AS tilt0, lag(v) OVER w AS under, lag(elev) OVER w AS elev0 FROM {radials} WINDOW w AS (PARTITION BY vol, az ORDER BY tilt)),
    met AS (SELECT vol, tilt, filter(transform(v, (x, g) -> abs(x - get(under, cast(floor((g + 1e0) * cos(radians(elev)) / cos(radians(elev0)) - 0.5e0) AS int)))), d -> d IS NOT NULL) AS d FROM stacked WHERE tilt0 = tilt - 1)
    SELECT vol, tilt, cast(sum(size(d)) AS bigint) AS n, cast(sum(size(filter(d, x -> x > 2e1))) AS bigint) AS n_differ FROM met GROUP BY vol, tilt HAVING sum(size(d)) > 0"""


def fold_check(tilts: int = 6, apart_deg: float = 0.2) -> str:
    """(vol, tilt, elev, n, n_differ, share): gates of a volume's lowest ``tilts`` sweeps that differ from those of the volume before it by more than
    its Nyquist velocity, and their share in percent; whole percents mean that one of the two has a part a fold off.

    Tables: radials(vol, tilt, az, v); sweeps(vol, tilt, elev, n_az, nyquist, first_m, spacing_m), nyquist 30 m/s where null; loops(vol, loop). The
    volume before is the last in the loop; its sweep is the lowest within 0.2 degrees. Rays meet by azimuth, floor(az * n_az before / n_az), and gates by
    range, the nearest. Sweeps without a common gate have n and share 0. Rays meet whole and count before the shuffle.
    """
    gate = "cast(floor((p.first_m + g * p.spacing_m - p.first0_m) / p.spacing0_m + 0.5e0) AS int)"
    return f"""
    WITH frames AS (SELECT vol, lag(vol) OVER (PARTITION BY loop ORDER BY vol) AS vol0 FROM {{loops}}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY elev, tilt) AS k FROM {{sweeps}}),
    met AS (SELECT b.vol, b.tilt, b.elev, b.n_az, coalesce(b.nyquist, 30e0) AS nyquist, b.first_m, b.spacing_m, f.vol0, min_by(struct(a.tilt, a.n_az, a.first_m, a.spacing_m), struct(a.elev, a.tilt)) AS a
        FROM ranked b JOIN frames f ON f.vol = b.vol JOIN {{sweeps}} a ON a.vol = f.vol0 AND abs(a.elev - b.elev) < {apart_deg!r}e0 WHERE b.k <= {tilts} GROUP BY b.vol, b.tilt, b.elev, b.n_az, b.nyquist, b.first_m, b.spacing_m, f.vol0),
    placed AS (SELECT m.*, a.tilt AS tilt0, a.first_m AS first0_m, a.spacing_m AS spacing0_m, cast(floor(r.az * a.n_az / m.n_az) AS bigint) AS az0, r.v FROM met m JOIN {{radials}} r ON r.vol = m.vol AND r.tilt = m.tilt),
    beside AS (SELECT p.vol, p.tilt, p.elev, filter(transform(p.v, (x, g) -> CASE WHEN {gate} >= 0 THEN abs(x - get(r.v, {gate})) END), d -> d IS NOT NULL) AS d, p.nyquist
        FROM placed p LEFT JOIN {{radials}} r ON r.vol = p.vol0 AND r.tilt = p.tilt0 AND r.az = p.az0)
    SELECT vol, tilt, min(elev) AS elev, cast(coalesce(sum(size(d)), 0) AS bigint) AS n, cast(coalesce(sum(size(filter(d, x -> x > nyquist))), 0) AS bigint) AS n_differ,
        round(1e2 * coalesce(sum(size(filter(d, x -> x > nyquist))), 0) / greatest(coalesce(sum(size(d)), 0), 1), 3) AS share FROM beside GROUP BY vol, tilt"""


def phase_unwrap(jump: int = 270) -> str:
    """Running unwrap along a ray: a turn is added after each fall of more than ``jump`` from the last valid gate. The phase
    is made of the gates' values. A ray is cut at its turns, which are few, and each piece raised as a whole."""
    step = "(get(p, k).phase - get(p, k - 1).phase)"
    return f"""
    WITH valid AS (SELECT vol, tilt, az, filter(transform(v, (x, g) -> struct(g AS bin, 2e1 * x - 36e1 * floor(2e1 * x / 36e1) AS phase)), y -> y.phase IS NOT NULL) AS p FROM {{radials}}),
    turned AS (SELECT *, filter(transform(p, (y, k) -> struct(k AS k, CASE WHEN k = 0 THEN 0 WHEN {step} < -{jump} THEN 1 WHEN {step} > {jump} THEN -1 ELSE 0 END AS turn)), y -> y.k = 0 OR y.turn <> 0) AS turns FROM valid),
    pieces AS (SELECT vol, tilt, az, p, transform(turns, (z, j) -> struct(z.k AS k, coalesce(get(turns, j + 1).k, size(p)) - z.k AS n, 36e1 * aggregate(slice(turns, 1, j + 1), 0, (a, y) -> a + y.turn) AS turn)) AS pieces FROM turned),
    gates AS (SELECT vol, tilt, az, inline(flatten(transform(pieces, z -> transform(slice(p, z.k + 1, z.n), y -> struct(y.bin AS bin, y.phase + z.turn AS phase))))) FROM pieces)
    SELECT vol, tilt, az, bin, round(phase, 3) AS phase FROM gates"""


def neighbour_cells(twin_km: float = 6.0) -> str:
    """Cells seen by several radars once: each where the radar that saw it is the nearest, and of two within 6 km that of the
    radar nearer to it. Cells are points(point_id, lat, lon) seen by site point_id modulo the number of sites, plus 1; they
    meet within cells of a grid, and see the few sites that can be nearest in their square."""
    away = lambda a, b: f"111.195e0 * sqrt(power({a}.lat - {b}.lat, 2) + power(({a}.lon - {b}.lon) * cos(radians({a}.lat)), 2))"
    step = "(SELECT -1 AS d UNION ALL SELECT 0 AS d UNION ALL SELECT 1 AS d)"

    def bound(c: str, s: str, h: float, sign: str, pick: str) -> str:
        """Distance from the near or far side of a square, with the least or greatest cosine of a latitude in it."""
        apart = lambda x: f"greatest(abs({c}.{x} - {s}.{x}) {sign} {h!r}e0, 0e0)"
        level = f"WHEN abs({c}.lat) <= {h!r}e0 THEN 1e0 " if pick == "greatest" else ""
        cosine = f"CASE {level}WHEN true THEN {pick}(cos(radians({c}.lat - {h!r}e0)), cos(radians({c}.lat + {h!r}e0))) END"
        return f"111.195e0 * sqrt(power({apart('lat')}, 2) + power({apart('lon')} * greatest({cosine}, 0e0), 2))"

    squares = nearest_of("{points}", lambda c, s, h: bound(c, s, h, "-", "least"), lambda c, s, h: bound(c, s, h, "+", "greatest"))
    return f"""
    WITH {squares},
    placed AS (SELECT p.point_id, p.point_id % n.n + 1 AS site, p.lat, p.lon FROM {{points}} p CROSS JOIN (SELECT count(*) AS n FROM {{sites}}) n),
    nearest AS (SELECT p.point_id, p.site, p.lat, p.lon, array_min(transform(k.sites, s -> struct({away("p", "s")} AS km, s.site AS site))) AS m FROM placed p JOIN kept k ON k.i = cast(floor(p.lat * 8e0) AS bigint) AND k.j = cast(floor(p.lon * 8e0) AS bigint)),
    seen AS (SELECT point_id, site, lat, lon, m.km AS radar_km, cast(floor(lat * 1e1) AS bigint) AS i, cast(floor(lon * 1e1) AS bigint) AS j FROM nearest WHERE m.site = site),
    around AS (SELECT s.*, s.i + a.d AS ni, s.j + b.d AS nj FROM seen s CROSS JOIN {step} a CROSS JOIN {step} b),
    twins AS (SELECT DISTINCT a.point_id FROM around a JOIN seen b ON b.i = a.ni AND b.j = a.nj AND b.site <> a.site AND {away("a", "b")} < {twin_km}e0 AND (b.radar_km < a.radar_km OR (b.radar_km = a.radar_km AND b.point_id < a.point_id)))
    SELECT s.point_id, s.site, round(s.radar_km, 4) AS radar_km FROM seen s LEFT JOIN twins t ON t.point_id = s.point_id WHERE t.point_id IS NULL"""


def hodograph_layers(profile: str, gap_m: int = 600) -> str:
    """Segments of a profile by layer (0-1, 1-3, 3-6, 6-9, above) and whether levels are missing between their ends."""
    return f"""
    WITH profile AS ({profile}),
    steps AS (SELECT vol, height_m, u, v, lag(height_m) OVER (PARTITION BY vol ORDER BY height_m) AS h0, lag(u) OVER (PARTITION BY vol ORDER BY height_m) AS u0, lag(v) OVER (PARTITION BY vol ORDER BY height_m) AS v0 FROM profile)
    SELECT vol, height_m, CASE WHEN (h0 + height_m) / 2e0 < 1e3 THEN 0 WHEN (h0 + height_m) / 2e0 < 3e3 THEN 1 WHEN (h0 + height_m) / 2e0 < 6e3 THEN 3 WHEN (h0 + height_m) / 2e0 < 9e3 THEN 6 ELSE 9 END AS layer,
        height_m - h0 > {gap_m} AS gap, round(sqrt(power(u - u0, 2) + power(v - v0, 2)), 4) AS shear FROM steps WHERE h0 IS NOT NULL"""


def freezing_level() -> str:
    """Climatological 0 degree height and melting layer of each site for the first of July, kilometres of the radar 0.37."""
    day = "(19905e0 - 365.2425e0 * floor(19905e0 / 365.2425e0))"
    return f"""
    SELECT site, round(m, 4) AS freezing_m, cast(floor(m - 37e1 + 0.5e0) - 6e2 AS bigint) AS bottom_m, cast(floor(m - 37e1 + 0.5e0) AS bigint) AS top_m FROM (
        SELECT site, greatest(59e2 - 75e0 * l + least(greatest(5e1 * l - 35e1, 3e2), 19e2) * cos(6.283185307179586e0 * ({day} - 205e0) / 365.2425e0), 0e0) AS m FROM (
            SELECT site, least(greatest(abs(lat), 1e1), 7e1) AS l FROM {{sites}}) q) p"""


def nearest_tilt() -> str:
    """For each sample the tilt nearest an elevation (here its range over 10 km as degrees), the lower one on ties."""
    return """
    WITH tilts AS (SELECT tilt, min(elev) AS elev FROM {radials} GROUP BY tilt),
    ranked AS (SELECT s.point_id, t.tilt, row_number() OVER (PARTITION BY s.point_id ORDER BY abs(t.elev - s.range_km / 1e1), t.elev) AS k FROM {samples} s CROSS JOIN tilts t)
    SELECT point_id, tilt FROM ranked WHERE k = 1"""

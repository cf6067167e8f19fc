"""Column products and wind fits as SQL over array-valued radials.

Tables: radials(vol, tilt, elev, az, v) with one array of gates for each ray, missing gates null; gates 1 km apart
from 1 km. A table of the beam over each ground bin is shared by all rays. Rays are shuffled, sorted and joined whole:
gates become rows only in a result, after the last shuffle.
"""

from __future__ import annotations

from stormlake.functions.constants import EARTH_43_M, ECHO_TOP_DBZ, KE_A_KM, ROT_MIN_CREF, ROT_TOP_KM, TRACK_MIN_ROT, VIL_CAP_DBZ, VIL_MIN

K = f"{KE_A_KM}e0"


def beams(gates: int = 64) -> str:
    """(tilt, bin, gate, h_km): which gate of a tilt lies over a ground bin, and how high; gate null beyond the ray."""
    slant = f"({K} * sin((b.bin + 1e0) / {K}) / cos(radians(t.elev) + (b.bin + 1e0) / {K}))"
    return f"""
    SELECT tilt, bin, CASE WHEN r - 1e0 > -0.5e0 AND floor(r - 0.5e0) < {gates} THEN cast(floor(r - 0.5e0) AS int) END AS gate, sqrt(r * r + {K} * {K} + 2e0 * r * {K} * sin(radians(elev))) - {K} AS h_km
    FROM (SELECT t.tilt, t.elev, b.bin, {slant} AS r FROM (SELECT tilt, min(elev) AS elev FROM {{radials}} GROUP BY tilt) t CROSS JOIN {{bins}} b) q"""


def aims(gates: int = 64) -> str:
    """Common tables up to ``aim``, a single row: each tilt's gates and heights over the ground bins, in the order of bins. It holds a tilt's
    two arrays, a few dozen in all, so that it may be broadcast whatever the number of rays."""
    return f"""lut AS ({beams(gates)}),
    tilted AS (SELECT tilt, array_sort(collect_list(struct(bin, gate, h_km))) AS l FROM lut GROUP BY tilt),
    aim AS (SELECT map_from_entries(collect_list(struct(tilt, struct(transform(l, x -> x.gate) AS gates, transform(l, x -> x.h_km) AS heights)))) AS at, first(transform(l, x -> x.bin)) AS bins FROM tilted)"""


def column_products() -> str:
    """(vol, az, bin, cref, top_km, vil): highest reflectivity, echo top at 18 dBZ and vertically integrated liquid above
    each ground bin.

    The top is that of the highest tilt at 18 dBZ or more, interpolated in dBZ to the tilt above it where that is valid.
    Liquid is 3.44e-6 * mean(Z)^(4/7) * dh over neighbouring tilts, Z capped at 56 dBZ and 0 where missing or below 0 dBZ,
    none under 0.1. The tilts over one azimuth meet in a row, as arrays over the ground bins, and are folded upwards.
    """
    x, x1 = "get(p.x, b)", "get(p.x1, b)"
    h, h1 = "get(p.h, b)", "get(p.h1, b)"
    z = lambda x: f"(CASE WHEN {x} >= 0e0 THEN power(1e1, least({x}, {VIL_CAP_DBZ}e0) / 1e1) ELSE 0e0 END)"
    top = f"CASE WHEN {x} >= {ECHO_TOP_DBZ}e0 THEN CASE WHEN {x1} < {ECHO_TOP_DBZ}e0 THEN {h} + ({x} - {ECHO_TOP_DBZ}e0) / ({x} - {x1}) * ({h1} - {h}) ELSE {h} END END"
    liquid = f"CASE WHEN {h1} IS NOT NULL AND ({x} >= 0e0 OR {x1} >= 0e0) THEN 3.44e-6 * power(0.5e0 * ({z(x)} + {z(x1)}), 4e0 / 7e0) * ({h1} - {h}) * 1e3 ELSE 0e0 END"
    return f"""
    WITH {aims()},
    stacks AS (SELECT vol, az, array_sort(collect_list(struct(tilt, transform(try_element_at(at, tilt).gates, g -> get(v, g)) AS x))) AS s FROM {{radials}} CROSS JOIN aim GROUP BY vol, az),
    pairs AS (SELECT vol, az, bins, transform(s, (t, k) -> struct(t.x AS x, get(s, k + 1).x AS x1, try_element_at(at, t.tilt).heights AS h, try_element_at(at, get(s, k + 1).tilt).heights AS h1)) AS s FROM stacks CROSS JOIN aim),
    folded AS (SELECT vol, az, inline(transform(bins, (bin, b) -> struct(bin, aggregate(s, named_struct('cref', cast(NULL AS double), 'top', cast(NULL AS double), 'liquid', 0e0),
        (a, p) -> named_struct('cref', greatest(a.cref, {x}), 'top', coalesce({top}, a.top), 'liquid', a.liquid + {liquid})) AS f))) FROM pairs)
    SELECT vol, az, bin, f.cref, round(f.top, 4) AS top_km, CASE WHEN f.liquid >= {VIL_MIN}e0 THEN round(f.liquid, 4) END AS vil FROM folded WHERE f.cref IS NOT NULL"""


def low_level_rotation() -> str:
    """(vol, az, bin, rot): largest shear of the beams that are at most 2 km above the radar, where the column has an echo. Shears
    are a table like radials; both kinds of rays over one azimuth meet in a row."""
    return f"""
    WITH {aims()},
    rays AS (SELECT vol, az, transform(try_element_at(at, tilt).gates, g -> get(v, g)) AS z, cast(NULL AS array<double>) AS low FROM {{radials}} CROSS JOIN aim
        UNION ALL SELECT vol, az, NULL, zip_with(try_element_at(at, tilt).gates, try_element_at(at, tilt).heights, (g, h) -> CASE WHEN h <= {ROT_TOP_KM}e0 THEN get(v, g) END) FROM {{shears}} CROSS JOIN aim),
    stacks AS (SELECT vol, az, collect_list(z) AS zs, collect_list(low) AS lows FROM rays GROUP BY vol, az),
    places AS (SELECT vol, az, inline(transform(bins, (bin, b) -> struct(bin, array_max(transform(zs, z -> get(z, b))) AS cref, array_max(transform(lows, y -> get(y, b))) AS rot))) FROM stacks CROSS JOIN aim)
    SELECT vol, az, bin, rot FROM places WHERE cref >= {ROT_MIN_CREF}e0 AND rot IS NOT NULL"""


def rotation_tracks() -> str:
    """(vol, az, bin, track): largest low-level shear of a loop's frames up to each, where it reaches the least that is drawn. Loops are loops(vol, loop): frames of one site
    without a gap.

    Only places where the largest shear grows are kept, each until it grows again, and then spread over the frames between: no place meets
    a frame that shows nothing of it.
    """
    return f"""
    WITH low AS ({low_level_rotation()}),
    placed AS (SELECT l.loop, w.vol, w.az, w.bin, w.rot FROM low w JOIN {{loops}} l ON l.vol = w.vol),
    raised AS (SELECT *, max(rot) OVER (PARTITION BY loop, az, bin ORDER BY vol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM placed),
    held AS (SELECT *, lead(vol) OVER (PARTITION BY loop, az, bin ORDER BY vol) AS until FROM raised WHERE before IS NULL OR rot > before),
    frames AS (SELECT loop, array_sort(collect_list(vol)) AS vols FROM {{loops}} GROUP BY loop)
    SELECT explode(filter(f.vols, v -> v >= h.vol AND (h.until IS NULL OR v < h.until))) AS vol, h.az, h.bin, h.rot AS track FROM held h JOIN frames f ON f.loop = h.loop WHERE h.rot >= {TRACK_MIN_ROT}e0"""


def sweep_statistics() -> str:
    """(vol, tilt, elev, n_rays, first_dbz, n_valid, mean, top) of each sweep; first_dbz is of the first ray's tenth gate. A ray's
    gates are summed up before the shuffle."""
    return """
    WITH rays AS (SELECT vol, tilt, elev, az, get(v, 9) AS tenth, filter(v, x -> x IS NOT NULL) AS valid FROM {radials}),
    sums AS (SELECT vol, tilt, elev, az, tenth, cast(size(valid) AS bigint) AS n, aggregate(valid, 0e0, (a, x) -> a + x) AS y, array_max(valid) AS top FROM rays)
    SELECT vol, tilt, round(avg(elev), 3) AS elev, count(DISTINCT az) AS n_rays, min_by(tenth, az) AS first_dbz, sum(n) AS n_valid, round(sum(y) / sum(n), 4) AS mean_dbz, max(top) AS top_dbz FROM sums GROUP BY vol, tilt"""


def point_samples() -> str:
    """Value of a sweep at (az, range): azimuth bin by floor, gate with the nearest centre, null outside the ray. An azimuth a billionth of a bin under an edge lies on it, as decimals
    have no exact form."""
    return """
    SELECT p.point_id, r.vol, r.tilt, {gate:r.v:cast(floor(p.range_km + 0.5e0) AS int) - 1} AS dbz FROM {samples} p JOIN {radials} r ON r.az = cast(floor(p.az / 7.2e0 + 1e-9) AS bigint) % 50
    WHERE p.range_km >= 0.5e0 AND p.range_km < 64.5e0"""


def storm_relative() -> str:
    """Radial velocity of every gate less the storm's motion along the beam. Storms are storms(vol, u, v); without one the
    velocity stays as it is. Rays meet storms, and their gates become rows afterwards."""
    return """
    WITH rays AS (SELECT r.vol, r.tilt, r.az, r.v, coalesce((s.u * sin(radians(r.az * 7.2e0)) + s.v * cos(radians(r.az * 7.2e0))) * cos(radians(r.elev)), 0e0) AS along FROM {radials} r LEFT JOIN {storms} s ON s.vol = r.vol),
    gates AS (SELECT vol, tilt, az, along, posexplode(v) AS (bin, x) FROM rays)
    SELECT vol, tilt, az, bin, round(x - along, 4) AS srv FROM gates WHERE x IS NOT NULL"""


_DET = "(n * (ss * cc - sc * sc) - s * (s * cc - sc * c) + c * (s * sc - ss * c))"
_DET_B = "(n * (sy * cc - sc * cy) - y * (s * cc - sc * c) + c * (s * cy - sy * c))"
_DET_C = "(n * (ss * cy - sy * sc) - s * (s * cy - sy * c) + y * (s * sc - ss * c))"
_SOLVED = f"abs({_DET}) > 1e-6 * power(greatest(n, 1e0), 3)"
_SUMS = """cast(sum(k) AS double) AS n, sum(k * si) AS s, sum(k * co) AS c, sum(k * si * si) AS ss, sum(k * co * co) AS cc, sum(k * si * co) AS sc, sum(y) AS y, sum(y * si) AS sy, sum(y * co) AS cy, sum(yy) AS yy"""


_FOUR = ("x0", "x1", "x2", "x3")
_K = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in _FOUR)
_Y = " + ".join(f"coalesce({x}, 0e0)" for x in _FOUR)
_YY = " + ".join(f"coalesce({x} * {x}, 0e0)" for x in _FOUR)


def _gates(values: str, ring: str) -> str:
    return ", ".join(f"get({values}, 4 * {ring} + {i}) AS {x}" for i, x in enumerate(_FOUR))


def _rings(first: int, last: int) -> str:
    """Rings of a ray as structs of their number and four gates."""
    return f"transform(sequence({first}, {last}), g -> struct(g AS ring, {_gates('v', 'g')}))"


def _turn(n_az: int) -> str:
    return f"sin(radians((az + 0.5e0) * {360 / n_az!r}e0)) AS si, cos(radians((az + 0.5e0) * {360 / n_az!r}e0)) AS co"


def ring_fits(n_az: int = 50, first: int = 1, last: int = 14) -> str:
    """First pass of the wind fit: v = a + b sin(az) + c cos(az) on rings of four gates, by normal equations and Cramer's rule.

    A ring needs a quarter of its gates; a singular system (determinant at most 1e-6 of the cubed count) is left out. All gates of a ray
    in a ring share an azimuth, so a ray brings a count and a sum for each ring, added up before the shuffle.
    """
    return f"""
    WITH parts AS (SELECT vol, tilt, elev, {_turn(n_az)}, inline({_rings(first, last)}) FROM {{radials}}),
    counted AS (SELECT vol, tilt, elev, ring, si, co, {_K} AS k, {_Y} AS y, 0e0 AS yy FROM parts),
    sums AS (SELECT vol, tilt, cast(ring AS bigint) AS ring, min(elev) AS elev, {_SUMS} FROM counted GROUP BY vol, tilt, ring HAVING sum(k) >= {n_az})
    SELECT vol, tilt, ring, cast(n AS bigint) AS n, round({_DET_B} / {_DET} / cos(radians(elev)), 3) AS u, round({_DET_C} / {_DET} / cos(radians(elev)), 3) AS v FROM sums WHERE {_SOLVED}"""


def refined_fits(nyquist: float, n_az: int = 50, first: int = 1, last: int = 14, top_elev: float = 20.0) -> str:
    """(vol, tilt, ring, n, u, v, rms): both passes of the wind fit over radials that also carry raw, the velocities as measured.

    Each gate's raw velocity is taken to the fold next to the first fit and kept where it lies within 3 times the first pass's residual (at least
    2 m/s) of it; the second fit over these needs a quarter of the ring's gates, some in six of eight sectors, and a residual of at most 4.5 m/s.
    Sweeps above 20 degrees have no fits. Coefficients come back as one row for each sweep, an array over its rings; a ray brings counts,
    sums and squares for each ring in both passes.
    """
    model = "(m.a + m.b * si + m.c * co)"
    a = f"((y - {_DET_B} / {_DET} * s - {_DET_C} / {_DET} * c) / n)"
    b, c = f"({_DET_B} / {_DET})", f"({_DET_C} / {_DET})"
    rms = f"sqrt(greatest(yy - {a} * y - {b} * sy - {c} * cy, 0e0) / n)"
    away = f"(pmod({{0}} - model + {nyquist!r}e0, {2 * nyquist!r}e0) - {nyquist!r}e0)"
    kept = ", ".join(f"CASE WHEN abs({away.format(x)}) < reach THEN model + {away.format(x)} END AS {x}" for x in _FOUR)
    group = lambda rows, more="": f"SELECT vol, tilt, ring, min(elev) AS elev, {_SUMS}{more} FROM {rows} GROUP BY vol, tilt, ring HAVING sum(k) >= {n_az}"
    return f"""
    WITH rays AS (SELECT vol, tilt, elev, az, v, raw, {_turn(n_az)} FROM {{radials}} WHERE elev <= {top_elev!r}e0),
    parts AS (SELECT vol, tilt, elev, si, co, inline({_rings(first, last)}) FROM rays),
    counted AS (SELECT vol, tilt, elev, ring, si, co, {_K} AS k, {_Y} AS y, {_YY} AS yy FROM parts),
    sums AS ({group("counted")}),
    fits AS (SELECT vol, tilt, ring, {a} AS a, {b} AS b, {c} AS c, {rms} AS rms FROM sums WHERE {_SOLVED}),
    models AS (SELECT vol, tilt, collect_list(struct(ring, a, b, c, 3e0 * greatest(rms, 2e0) AS reach)) AS models FROM fits GROUP BY vol, tilt),
    again AS (SELECT r.vol, r.tilt, r.elev, cast(floor(r.az * 8e0 / {n_az}) AS int) AS sector, r.si, r.co, inline(transform(f.models, m -> struct(m.ring AS ring, {model} AS model, m.reach AS reach, {_gates("raw", "m.ring")})))
        FROM rays r JOIN models f ON f.vol = r.vol AND f.tilt = r.tilt),
    unfolded AS (SELECT vol, tilt, elev, sector, si, co, ring, {kept} FROM again),
    recounted AS (SELECT *, {_K} AS k, {_Y} AS y, {_YY} AS yy FROM unfolded),
    resums AS ({group("recounted", ", bit_or(CASE WHEN k > 0 THEN shiftleft(1, sector) ELSE 0 END) AS sectors")})
    SELECT vol, tilt, cast(ring AS bigint) AS ring, cast(n AS bigint) AS n, round({b} / cos(radians(elev)), 3) AS u, round({c} / cos(radians(elev)), 3) AS v, round({rms}, 3) AS rms
    FROM resums WHERE {_SOLVED} AND bit_count(sectors) >= 6 AND {rms} <= 4.5e0"""


def beam_height(r: str, e: str) -> str:
    """Height in metres of a gate at slant range r (m)."""
    big = f"{EARTH_43_M!r}e0"
    return f"(sqrt({r} * {r} + {big} * {big} + 2e0 * {r} * {big} * sin(radians({e}))) - {big})"


def wind_profile() -> str:
    """Medians of ring winds in 250 m bins up to 12 km with two rings or more."""
    slant = "(1e3 + (ring * 4e0 + 1.5e0) * 1e3)"
    return f"""
    WITH rings AS ({ring_fits()}),
    placed AS (SELECT f.vol, f.u, f.v, {beam_height(slant.replace("ring", "f.ring"), "t.elev")} AS h FROM rings f JOIN (SELECT tilt, min(elev) AS elev FROM {{radials}} GROUP BY tilt) t ON t.tilt = f.tilt)
    SELECT vol, cast(floor(h / 250e0) AS bigint) * 250 + 125 AS height_m, round({{median:u}}, 4) AS u, round({{median:v}}, 4) AS v, count(*) AS n FROM placed WHERE h < 12e3 GROUP BY vol, cast(floor(h / 250e0) AS bigint) HAVING count(*) >= 2"""


def storm_motions() -> str:
    """Movers of each volume whose profile reaches from 1 to 5 km: mean wind and shear of 0 to 6 km in steps of 250 m, the right
    mover 7.5 m/s to the right of the shear, and helicity relative to it up to 1 and 3 km."""
    z = "(CASE WHEN {0} IS NULL THEN {1} WHEN {1} IS NULL THEN {0} WHEN h1 = h0 THEN {0} ELSE {0} + ({1} - {0}) * (z - h0) / (h1 - h0) END)"
    return f"""
    WITH profile AS ({wind_profile()}),
    reach AS (SELECT vol FROM profile GROUP BY vol HAVING min(height_m) <= 1000 AND max(height_m) >= 5000),
    levels AS (SELECT r.vol, b.bin * 250e0 AS z FROM reach r CROSS JOIN {{bins}} b WHERE b.bin <= 24),
    around AS (SELECT l.vol, l.z, max(CASE WHEN p.height_m <= l.z THEN cast(p.height_m AS double) END) AS h0, min(CASE WHEN p.height_m >= l.z THEN cast(p.height_m AS double) END) AS h1 FROM levels l JOIN profile p ON p.vol = l.vol GROUP BY l.vol, l.z),
    met AS (SELECT a.vol, a.z, a.h0, a.h1, p.u AS u0, p.v AS v0, q.u AS u1, q.v AS v1 FROM around a LEFT JOIN profile p ON p.vol = a.vol AND p.height_m = a.h0 LEFT JOIN profile q ON q.vol = a.vol AND q.height_m = a.h1),
    winds AS (SELECT vol, z, {z.format("u0", "u1")} AS u, {z.format("v0", "v1")} AS v FROM met),
    sums AS (SELECT vol, avg(u) AS um, avg(v) AS vm, avg(CASE WHEN z >= 55e2 THEN u END) - avg(CASE WHEN z <= 5e2 THEN u END) AS su, avg(CASE WHEN z >= 55e2 THEN v END) - avg(CASE WHEN z <= 5e2 THEN v END) AS sv FROM winds GROUP BY vol),
    movers AS (SELECT *, um + 75e-1 * sv / sqrt(su * su + sv * sv) AS ru, vm - 75e-1 * su / sqrt(su * su + sv * sv) AS rv FROM sums WHERE sqrt(su * su + sv * sv) >= 1e-3),
    steps AS (SELECT w.vol, w.z, w.u - m.ru AS u, w.v - m.rv AS v, lag(w.u - m.ru) OVER (PARTITION BY w.vol ORDER BY w.z) AS pu, lag(w.v - m.rv) OVER (PARTITION BY w.vol ORDER BY w.z) AS pv FROM winds w JOIN movers m ON m.vol = w.vol),
    turned AS (SELECT vol, sum(CASE WHEN z <= 1e3 THEN u * pv - pu * v END) AS srh1, sum(CASE WHEN z <= 3e3 THEN u * pv - pu * v END) AS srh3 FROM steps GROUP BY vol)
    SELECT m.vol, round(m.ru, 2) AS right_u, round(m.rv, 2) AS right_v, round(2e0 * m.um - m.ru, 2) AS left_u, round(2e0 * m.vm - m.rv, 2) AS left_v, round(m.um, 2) AS mean_u, round(m.vm, 2) AS mean_v, round(t.srh1, 1) AS srh1, round(t.srh3, 1) AS srh3
    FROM movers m JOIN turned t ON t.vol = m.vol"""


def wind_levels() -> str:
    """Columns of a profile view: each volume's wind in rows of 250 m, null where no level lies within half a row."""
    return f"""
    WITH profile AS ({wind_profile()})
    SELECT v.vol, b.bin * 250 + 125 AS row_m, p.u, p.v FROM (SELECT DISTINCT vol FROM {{radials}}) v CROSS JOIN {{bins}} b
    LEFT JOIN profile p ON p.vol = v.vol AND cast(floor(p.height_m / 250e0) AS bigint) = b.bin WHERE b.bin < 48"""


def ring_windows(half: int = 2) -> str:
    """Mean and standard deviation of the valid gates around each gate of a ray, where at least half are valid. A gate brings its window
    with it from the ray's array; nothing is shuffled."""
    reach = range(-half, half + 1)
    w = [f"w{k + half}" for k in reach]
    return f"""
    WITH windows AS (SELECT vol, tilt, az, inline(transform(v, (x, g) -> struct(g AS bin, least(g + {half}, size(v) - 1) - greatest(g - {half}, 0) + 1 AS size, {", ".join(f"get(v, g + {k}) AS {x}" for k, x in zip(reach, w, strict=True))}))) FROM {{radials}}),
    counted AS (SELECT *, {" + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in w)} AS n FROM windows),
    means AS (SELECT *, ({" + ".join(f"coalesce({x}, 0e0)" for x in w)}) / n AS mean FROM counted WHERE n > 0 AND 2 * n >= size)
    SELECT vol, tilt, az, bin, round(mean, 4) AS mean, round(sqrt(({" + ".join(f"coalesce(power({x} - mean, 2), 0e0)" for x in w)}) / n), 4) AS sd FROM means"""

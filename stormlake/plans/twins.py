"""SQL twins of the portable queries, written from the definitions and in another form than the operators: as-of joins, self
joins and list functions in place of windows and buckets, other formulas of the same geometry. ``{name}`` fields are bound
tables."""

from __future__ import annotations

from stormlake.functions.constants import EARTH_43_M, EARTH_KM, KE_A_KM

_GAP = 1_800_000_000
_KEYED = "keyed AS (SELECT *, ts_us::hugeint * 100000000 + event_id AS k FROM {scans})"
_SEQUENCED = f"""{_KEYED},
    starts AS (SELECT site, k, event_id FROM (SELECT a.site, a.k, a.event_id, a.ts_us, p.ts_us AS prior_us FROM keyed a ASOF LEFT JOIN keyed p ON p.site = a.site AND p.k < a.k) q WHERE prior_us IS NULL OR ts_us - prior_us > {_GAP}),
    owned AS (SELECT a.site, a.ts_us, a.event_id, a.k, s.k AS head FROM keyed a ASOF JOIN starts s ON s.site = a.site AND s.k <= a.k)"""

# r = K sin p / (cos e cos p - sin e sin p), h = K cos e / (cos e cos p - sin e sin p) - K
_K = f"{KE_A_KM}e0"
_SAMPLED = f"""lut AS (SELECT tilt, bin, cast(floor({_K} * sin(p) / d - 0.5e0) AS int) AS gate, {_K} * cos(e) / d - {_K} AS h FROM (SELECT t.tilt, b.bin, radians(t.elev) AS e, (b.bin + 1) / {_K} AS p,
        cos(radians(t.elev)) * cos((b.bin + 1) / {_K}) - sin(radians(t.elev)) * sin((b.bin + 1) / {_K}) AS d FROM (SELECT DISTINCT tilt, elev FROM {{radials}}) t, {{bins}} b) q)"""


def _sampled(table: str) -> str:
    return f"SELECT r.vol, r.az, l.bin, l.tilt, l.h, CASE WHEN l.gate >= 0 AND l.gate < 64 THEN r.v[l.gate + 1] END AS x FROM {{{table}}} r JOIN lut l USING (tilt)"


_ROTATION = f"""WITH {_SAMPLED},
    echo AS (SELECT vol, az, bin FROM ({_sampled("radials")}) q GROUP BY vol, az, bin HAVING max(x) >= 20)
    SELECT vol, az, bin, max(x) AS rot FROM ({_sampled("shears")}) q SEMI JOIN echo USING (vol, az, bin) WHERE h <= 2 AND x IS NOT NULL GROUP BY vol, az, bin"""

# centred sums: slopes from covariances
_RINGS = """rings AS (SELECT vol, tilt, elev, ring, n, (vs * cc - vc * sc) / (ss * cc - sc * sc) / cos(radians(elev)) AS u, (vc * ss - vs * sc) / (ss * cc - sc * sc) / cos(radians(elev)) AS v FROM (
        SELECT vol, tilt, min(elev) AS elev, ring, count(*) AS n, covar_pop(x, s) AS vs, covar_pop(x, c) AS vc, covar_pop(s, c) AS sc, var_pop(s) AS ss, var_pop(c) AS cc FROM (
            SELECT vol, tilt, elev, (g - 1) // 4 AS ring, v[g] AS x, sin(radians(az * 7.2e0 + 3.6e0)) AS s, cos(radians(az * 7.2e0 + 3.6e0)) AS c FROM {radials}, (SELECT unnest(range(5, 61)) AS g) gates) q WHERE x IS NOT NULL GROUP BY vol, tilt, ring HAVING count(*) >= 50) p
        WHERE abs(ss * cc - sc * sc) > 1e-6)"""
_PROFILE = f"""{_RINGS},
    heights AS (SELECT vol, round(u, 3) AS u, round(v, 3) AS v, sqrt(power(r * cos(radians(elev)), 2) + power({EARTH_43_M!r}e0 + r * sin(radians(elev)), 2)) - {EARTH_43_M!r}e0 AS h FROM (SELECT *, 1e3 * (4 * ring + 2.5e0) AS r FROM rings) q),
    profile AS (SELECT vol, cast(floor(h / 250) AS bigint) * 250 + 125 AS height_m, round(quantile_cont(u, 0.5), 4) AS u, round(quantile_cont(v, 0.5), 4) AS v, count(*) AS n FROM heights WHERE h < 12000 GROUP BY 1, 2 HAVING count(*) > 1)"""

_XYZ = "xyz AS (SELECT site, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {sites})"
_PAIRS = f"""{_XYZ}, pairs AS (SELECT a.site, b.site AS other, {2 * EARTH_KM}e0 * asin(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 2) AS km FROM xyz a JOIN xyz b ON a.site <> b.site)"""


def _bearing(lat: str) -> tuple[str, str]:
    """(x, y) of the other site, or of a point with this latitude on its meridian, by distance and bearing."""
    dl = "radians(o.lon - s.lon)"
    east = f"cos(radians({lat})) * sin({dl})"
    north = f"(cos(radians(s.lat)) * sin(radians({lat})) - sin(radians(s.lat)) * cos(radians({lat})) * cos({dl}))"
    arc = f"atan2(sqrt(power({east}, 2) + power({north}, 2)), sin(radians(s.lat)) * sin(radians({lat})) + cos(radians(s.lat)) * cos(radians({lat})) * cos({dl}))"
    course = f"atan2({east}, {north})"
    return f"({EARTH_KM}e0 * {arc} * sin({course}))", f"({EARTH_KM}e0 * {arc} * cos({course}))"


_X, _Y = _bearing("o.lat")
_X1, _Y1 = _bearing("(o.lat + 0.05e0)")

TWINS: dict[str, str] = {
    "newest_per_site": "SELECT site, ts_us, event_id, n_scans FROM (SELECT *, count(*) OVER (PARTITION BY site) AS n_scans, row_number() OVER (PARTITION BY site ORDER BY ts_us DESC, event_id DESC) AS k FROM {scans}) q WHERE k = 1",
    "scan_at_or_before": "SELECT r.req_id, s.ts_us, s.event_id FROM {requests} r ASOF JOIN (SELECT site, ts_us, max(event_id) AS event_id FROM {scans} GROUP BY ALL) s ON s.site = r.site AND s.ts_us <= r.at_us WHERE s.ts_us // 86400000000 >= r.at_us // 86400000000 - 1",
    "issue_at_or_before": "SELECT r.req_id, s.begin_us, s.id FROM {requests} r ASOF JOIN (SELECT kind, begin_us, max(id) AS id FROM {intervals} GROUP BY ALL) s ON s.kind = r.site AND s.begin_us <= r.at_us WHERE s.begin_us // 86400000000 >= r.at_us // 86400000000 - 1",
    "prior_scans": "SELECT s.event_id, p.event_id AS prior_id, s.ts_us - p.ts_us AS age_us FROM {scans} s ASOF JOIN (SELECT site, ts_us, max(event_id) AS event_id FROM {scans} GROUP BY ALL) p ON p.site = s.site AND p.ts_us < s.ts_us WHERE s.ts_us - p.ts_us <= 900000000",
    "mosaic_partners": """SELECT a.event_id, b.site AS other_site, first(b.event_id ORDER BY abs(b.ts_us - a.ts_us), b.ts_us, b.event_id) AS other_id, first(b.ts_us - a.ts_us ORDER BY abs(b.ts_us - a.ts_us), b.ts_us, b.event_id) AS offset_us
        FROM {scans} a JOIN {scans} b ON b.ts_us BETWEEN a.ts_us - 600000000 AND a.ts_us + 600000000 WHERE a.site <> b.site GROUP BY a.event_id, b.site""",
    "storm_motion_near": "SELECT s.event_id, first(m.event_id ORDER BY m.site <> s.site, abs(m.ts_us - s.ts_us), m.event_id) AS motion_id FROM {scans} s JOIN (SELECT * FROM {scans} WHERE size >= 2000) m ON m.ts_us BETWEEN s.ts_us - 3600000000 AND s.ts_us + 3600000000 GROUP BY s.event_id",
    "scan_sequences": f"WITH {_SEQUENCED} SELECT site, dense_rank() OVER (PARTITION BY site ORDER BY head) AS seq, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_scans FROM owned GROUP BY site, head",
    "next_frames": f"""WITH {_SEQUENCED}, lists AS (SELECT site, head, list(event_id ORDER BY k) AS l FROM owned GROUP BY site, head),
        chained AS (SELECT *, lead(l[1]) OVER (PARTITION BY site ORDER BY head) AS jump_id FROM lists)
        SELECT l[i] AS event_id, coalesce(l[i + 1], l[1]) AS next_id, i = len(l) AS wraps, CASE WHEN coalesce(l[i + 1], l[1]) = l[-1] THEN 1.125e0 ELSE 0.125e0 END AS wait_s, jump_id FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM chained) q""",
    "hourly_counts": "SELECT site, cast(epoch(date_trunc('hour', make_timestamp(ts_us))) / 3600 AS bigint) AS hour, count(*) AS n_scans, cast(sum(size) AS bigint) AS bytes FROM {scans} GROUP BY ALL",
    "new_keys": "SELECT DISTINCT site, event_id FROM {scans} a WHERE NOT EXISTS (SELECT 1 FROM {scans} b WHERE b.site = a.site AND b.event_id = a.event_id AND b.event_id % 2 = 0)",
    "cell_motion": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ts_us, event_id) AS k FROM {points}),
        m AS (SELECT b.event_id, b.x, b.y, (b.x - a.x) / nullif(b.ts_us - a.ts_us, 0) AS u, (b.y - a.y) / nullif(b.ts_us - a.ts_us, 0) AS w FROM r b JOIN r a ON a.track = b.track AND a.k = greatest(1, b.k - 3))
        SELECT event_id, round(u * 3600e6, 4) AS u, round(w * 3600e6, 4) AS v, round(x + u * 900e6, 4) AS x15, round(y + w * 900e6, 4) AS y15, round(x + u * 1800e6, 4) AS x30, round(y + w * 1800e6, 4) AS y30, round(x + u * 2700e6, 4) AS x45, round(y + w * 2700e6, 4) AS y45 FROM m""",
    "site_neighbours": f"WITH {_PAIRS} SELECT site, other, round(km, 4) AS km FROM pairs WHERE km <= 900",
    "nearest_sites": f"WITH {_PAIRS} SELECT * FROM (SELECT a.site, a.other, round(any_value(a.km), 4) AS km, 1 + count(b.other) AS rank FROM pairs a LEFT JOIN pairs b ON b.site = a.site AND (round(b.km, 4), b.other) < (round(a.km, 4), a.other) WHERE a.km <= 900 GROUP BY a.site, a.other) q WHERE rank <= 4",
    "neighbour_offsets": f"WITH {_PAIRS} SELECT p.site, p.other, round({_X}, 3) AS x, round({_Y}, 3) AS y, round(degrees(atan2({_X1} - {_X}, {_Y1} - {_Y})), 3) AS turn FROM pairs p JOIN {{sites}} s ON s.site = p.site JOIN {{sites}} o ON o.site = p.other WHERE p.km <= 900",
    "nearest_radar": f"""WITH {_XYZ}, places AS (SELECT point_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {{points}}),
        met AS (SELECT p.point_id, s.site, {2 * EARTH_KM}e0 * asin(sqrt(power(p.x - s.x, 2) + power(p.y - s.y, 2) + power(p.z - s.z, 2)) / 2) AS km FROM places p, xyz s)
        SELECT point_id, first(site ORDER BY round(km, 7), site) AS site, round(min(km), 4) AS km FROM met GROUP BY point_id""",
    "warnings_active": "SELECT t.at_us, i.kind, sum((i.begin_us <= t.at_us)::int) - sum((i.end_us <= t.at_us)::int) AS n_active FROM {ticks} t, (SELECT * FROM {intervals} WHERE end_us > begin_us) i GROUP BY ALL HAVING n_active > 0",
    "warnings_sweep": """WITH i AS (SELECT * FROM {intervals} WHERE end_us > begin_us), t AS (SELECT kind, begin_us AS at_us FROM i UNION SELECT kind, end_us FROM i)
        SELECT t.kind, t.at_us, count(*) FILTER (i.end_us > t.at_us) AS n_active FROM t JOIN i ON i.kind = t.kind AND i.begin_us <= t.at_us GROUP BY ALL""",
    "outlook_in_effect": """WITH days AS (SELECT req_id, at_us, (at_us - 43200000000) // 86400000000 AS day FROM {requests}),
        listed AS (SELECT d.*, c.cycle, d.day * 86400000000 + c.minute::bigint * 60000000 AS issued_us FROM days d, (VALUES (6, 360), (13, 780), (16, 990), (20, 1200), (1, 1500)) c(cycle, minute))
        SELECT l.req_id, l.day, arg_max(l.cycle, l.issued_us) AS cycle, max(l.issued_us) AS issued_us FROM listed l SEMI JOIN (SELECT * FROM {outlooks} WHERE n_areas > 0) o USING (day, cycle) WHERE l.issued_us <= l.at_us GROUP BY l.req_id, l.day""",
    "points_in_polygons": """WITH t AS (SELECT p.point_id, e.ring_id, (e.x0 - p.lon) AS ax, (e.y0 - p.lat) AS ay, (e.x1 - p.lon) AS bx, (e.y1 - p.lat) AS by_ FROM {points} p, {edges} e)
        SELECT point_id, ring_id FROM t GROUP BY point_id, ring_id HAVING abs(sum(atan2(ax * by_ - ay * bx, ax * bx + ay * by_))) > 3""",
    "column_products": f"""WITH {_SAMPLED}, s AS ({_sampled("radials")}),
        z AS (SELECT *, CASE WHEN x >= 0 THEN power(10, least(x, 56) / 10) ELSE 0 END AS z FROM s),
        j AS (SELECT a.vol, a.az, a.bin, a.tilt, a.x, 3.44e-6 * power((a.z + b.z) / 2, 4 / 7.0::double) * 1000 * (b.h - a.h) AS w, CASE WHEN a.x >= 18 THEN a.h + CASE WHEN b.x < 18 THEN (a.x - 18) / (a.x - b.x) * (b.h - a.h) ELSE 0 END END AS top
            FROM z a LEFT JOIN z b ON b.vol = a.vol AND b.az = a.az AND b.bin = a.bin AND b.tilt = a.tilt + 1)
        SELECT vol, az, bin, max(x) AS cref, round(last(top ORDER BY tilt) FILTER (top IS NOT NULL), 4) AS top_km, CASE WHEN coalesce(sum(w), 0) >= 0.1 THEN round(sum(w), 4) END AS vil FROM j GROUP BY vol, az, bin HAVING max(x) IS NOT NULL""",
    "low_level_rotation": _ROTATION,
    "rotation_tracks": f"""WITH r AS ({_ROTATION}), v AS (SELECT DISTINCT vol FROM {{radials}}) SELECT v.vol, r.az, r.bin, max(r.rot) AS track FROM v JOIN r ON r.vol <= v.vol AND r.vol // 3 = v.vol // 3 GROUP BY ALL HAVING max(r.rot) >= 5""",
    "sweep_statistics": """SELECT vol, tilt, round(avg(elev), 3) AS elev, count(DISTINCT az) AS n_rays, arg_min_null(v[10], az) AS first_dbz, cast(sum(len(list_filter(v, lambda x: x IS NOT NULL))) AS bigint) AS n_valid,
        round(sum(coalesce(list_sum(v), 0)) / sum(len(list_filter(v, lambda x: x IS NOT NULL))), 4) AS mean_dbz, max(list_max(v)) AS top_dbz FROM {radials} GROUP BY vol, tilt""",
    "point_samples": "SELECT p.point_id, r.vol, r.tilt, r.v[cast(floor(p.range_km + 0.5) AS int)] AS dbz FROM {samples} p JOIN {radials} r ON r.az = cast(floor(p.az / 7.2e0 + 1e-9) AS bigint) WHERE p.range_km >= 0.5 AND p.range_km < 64.5",
    "storm_relative": """SELECT * FROM (SELECT r.vol, r.tilt, r.az, unnest(range(64)) AS bin, round(unnest(list_transform(v, lambda x: x - CASE WHEN s.u IS NULL THEN 0 ELSE cos(radians(elev)) * sqrt(s.u * s.u + s.v * s.v) * cos(radians(az * 7.2e0) - atan2(s.u, s.v)) END)), 4) AS srv
        FROM {radials} r LEFT JOIN (SELECT vol, u, v FROM {storms}) s(svol, u, v) ON s.svol = r.vol) q WHERE srv IS NOT NULL""".replace("list_transform(v,", "list_transform(r.v,"),
    "vad_ring_fits": f"WITH {_RINGS} SELECT vol, tilt, ring, n, round(u, 3) AS u, round(v, 3) AS v FROM rings",
    "vad_refined_fits": """WITH g AS (SELECT vol, tilt, elev, az, bin // 4 AS ring, x, raw, sin(radians(az * 7.2e0 + 3.6e0)) AS s, cos(radians(az * 7.2e0 + 3.6e0)) AS c FROM {radials} WHERE x IS NOT NULL AND bin BETWEEN 4 AND 59 AND elev <= 20),
        f1 AS (SELECT vol, tilt, ring, (vs * cc - vc * sc) / d AS b, (vc * ss - vs * sc) / d AS c, m - (vs * cc - vc * sc) / d * ms - (vc * ss - vs * sc) / d * mc AS a FROM (SELECT *, ss * cc - sc * sc AS d FROM (
            SELECT vol, tilt, ring, avg(x) AS m, avg(s) AS ms, avg(c) AS mc, covar_pop(x, s) AS vs, covar_pop(x, c) AS vc, covar_pop(s, c) AS sc, var_pop(s) AS ss, var_pop(c) AS cc FROM g GROUP BY ALL HAVING count(*) >= 50) p) q WHERE abs(d) > 1e-6),
        e1 AS (SELECT g.*, f1.a + f1.b * g.s + f1.c * g.c AS model, sqrt(avg((g.x - f1.a - f1.b * g.s - f1.c * g.c) ** 2) OVER (PARTITION BY g.vol, g.tilt, g.ring)) AS rms FROM g JOIN f1 USING (vol, tilt, ring)),
        h AS (SELECT *, model + d AS y FROM (SELECT *, raw - model - 20 * round((raw - model) / 20) AS d FROM e1) q WHERE abs(d) < 3 * greatest(rms, 2)),
        f2 AS (SELECT *, (vs * cc - vc * sc) / d AS b, (vc * ss - vs * sc) / d AS k FROM (SELECT *, ss * cc - sc * sc AS d FROM (
            SELECT vol, tilt, ring, min(elev) AS elev, count(*) AS n, count(DISTINCT az * 8 // 50) AS sectors, avg(y) AS m, avg(s) AS ms, avg(c) AS mc, covar_pop(y, s) AS vs, covar_pop(y, c) AS vc, covar_pop(s, c) AS sc, var_pop(s) AS ss, var_pop(c) AS cc FROM h GROUP BY vol, tilt, ring HAVING count(*) >= 50) p) q WHERE abs(d) > 1e-6 AND sectors >= 6),
        e2 AS (SELECT vol, tilt, ring, sqrt(avg((h.y - f2.m - f2.b * (h.s - f2.ms) - f2.k * (h.c - f2.mc)) ** 2)) AS rms FROM h JOIN f2 USING (vol, tilt, ring) GROUP BY ALL)
        SELECT vol, tilt, ring, n, round(b / cos(radians(elev)), 3) AS u, round(k / cos(radians(elev)), 3) AS v, round(rms, 3) AS rms FROM f2 JOIN e2 USING (vol, tilt, ring) WHERE rms <= 4.5""",
    "fold_check": """WITH g AS (SELECT r.vol, r.tilt, r.az, unnest(range(64)) AS i, unnest(r.v) AS x FROM {radials} r),
        n AS (SELECT *, (SELECT count(*) FROM {sweeps} o WHERE o.vol = s.vol AND (o.elev, o.tilt) < (s.elev, s.tilt)) AS below FROM {sweeps} s),
        p AS (SELECT b.*, a.vol AS vol0, a.tilt AS tilt0, a.n_az AS n0, a.first_m AS f0, a.spacing_m AS s0 FROM n b JOIN {loops} l ON l.vol = b.vol JOIN {loops} k ON k.loop = l.loop AND k.vol = (SELECT max(o.vol) FROM {loops} o WHERE o.loop = l.loop AND o.vol < l.vol) JOIN {sweeps} a ON a.vol = k.vol AND abs(a.elev - b.elev) < 0.2
            WHERE b.below < 6 AND NOT EXISTS (SELECT 1 FROM {sweeps} o WHERE o.vol = a.vol AND abs(o.elev - b.elev) < 0.2 AND (o.elev, o.tilt) < (a.elev, a.tilt))),
        m AS (SELECT p.vol, p.tilt, p.elev, coalesce(p.nyquist, 30) AS nyquist, b.x, c.x AS y FROM p JOIN g b ON b.vol = p.vol AND b.tilt = p.tilt LEFT JOIN g c ON c.vol = p.vol0 AND c.tilt = p.tilt0 AND c.az = b.az * p.n0 // p.n_az AND c.i = round((p.first_m + b.i * p.spacing_m - p.f0) / p.s0))
        SELECT vol, tilt, elev, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, count(*) FILTER (abs(x - y) > nyquist) AS n_differ, round(100 * count(*) FILTER (abs(x - y) > nyquist) / greatest(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL), 1), 3) AS share FROM m GROUP BY ALL""",
    "wind_profile": f"WITH {_PROFILE} SELECT * FROM profile",
    "wind_levels": f"WITH {_PROFILE}, vols AS (SELECT DISTINCT vol FROM {{radials}}), rows AS (SELECT unnest(range(125, 12000, 250)) AS row_m) SELECT c.vol, r.row_m, p.u, p.v FROM vols c CROSS JOIN rows r LEFT JOIN profile p ON p.vol = c.vol AND abs(p.height_m - r.row_m) < 125",
    "hodograph_layers": f"""WITH {_PROFILE}, lists AS (SELECT vol, list({{'h': height_m, 'u': u, 'v': v}} ORDER BY height_m) AS l FROM profile GROUP BY vol), steps AS (SELECT vol, l[i] AS b, l[i - 1] AS a FROM (SELECT *, unnest(range(2, len(l) + 1)) AS i FROM lists) q)
        SELECT vol, b.h AS height_m, CASE WHEN m < 1000 THEN 0 WHEN m < 3000 THEN 1 WHEN m < 6000 THEN 3 WHEN m < 9000 THEN 6 ELSE 9 END AS layer, b.h - a.h > 600 AS gap, round(sqrt((b.u - a.u) ** 2 + (b.v - a.v) ** 2), 4) AS shear FROM (SELECT *, (a.h + b.h) / 2 AS m FROM steps) q""",
    "storm_motions": f"""WITH {_PROFILE}, ends AS (SELECT vol, min(height_m) AS lo, max(height_m) AS hi FROM profile GROUP BY vol HAVING min(height_m) <= 1000 AND max(height_m) >= 5000),
        levels AS (SELECT vol, z, least(greatest(z, lo), hi) AS height FROM ends, (SELECT unnest(range(0, 6001, 250)) AS z) g),
        below AS (SELECT l.*, p.height_m AS h0, p.u AS u0, p.v AS v0 FROM levels l ASOF JOIN profile p ON p.vol = l.vol AND p.height_m <= l.height),
        around AS (SELECT b.*, p.height_m AS h1, p.u AS u1, p.v AS v1 FROM below b ASOF JOIN profile p ON p.vol = b.vol AND p.height_m >= b.height),
        w AS (SELECT vol, z, u0 + coalesce((u1 - u0) * (height - h0) / nullif(h1 - h0, 0), 0) AS u, v0 + coalesce((v1 - v0) * (height - h0) / nullif(h1 - h0, 0), 0) AS v FROM around),
        m AS (SELECT vol, avg(u) AS um, avg(v) AS vm, avg(u) FILTER (z >= 5500) - avg(u) FILTER (z <= 500) AS su, avg(v) FILTER (z >= 5500) - avg(v) FILTER (z <= 500) AS sv FROM w GROUP BY vol),
        r AS (SELECT *, um + 7.5 * cos(atan2(sv, su) - pi() / 2) AS ru, vm + 7.5 * sin(atan2(sv, su) - pi() / 2) AS rv FROM m WHERE sqrt(su * su + sv * sv) >= 0.001),
        t AS (SELECT a.vol, sum((b.u - ru) * (a.v - rv) - (a.u - ru) * (b.v - rv)) FILTER (b.z <= 1000) AS srh1, sum((b.u - ru) * (a.v - rv) - (a.u - ru) * (b.v - rv)) FILTER (b.z <= 3000) AS srh3 FROM w a JOIN w b ON b.vol = a.vol AND b.z = a.z + 250 JOIN r ON r.vol = a.vol GROUP BY a.vol)
        SELECT r.vol, round(ru, 2) AS right_u, round(rv, 2) AS right_v, round(2 * um - ru, 2) AS left_u, round(2 * vm - rv, 2) AS left_v, round(um, 2) AS mean_u, round(vm, 2) AS mean_v, round(srh1, 1) AS srh1, round(srh3, 1) AS srh3 FROM r JOIN t USING (vol)""",
    "range_windows": """WITH g AS (SELECT vol, tilt, az, unnest(range(64)) AS bin, unnest(v) AS x FROM {radials}) SELECT a.vol, a.tilt, a.az, a.bin, round(avg(b.x), 4) AS mean, round(sqrt(greatest(avg(b.x * b.x) - avg(b.x) ** 2, 0)), 4) AS sd
        FROM g a JOIN g b ON b.vol = a.vol AND b.tilt = a.tilt AND b.az = a.az AND b.bin BETWEEN a.bin - 2 AND a.bin + 2 GROUP BY ALL HAVING 2 * count(b.x) >= count(*)""",
    "tilt_resample": """WITH q AS (SELECT a.vol, a.tilt, unnest(range(64)) AS g, unnest(a.v) AS x, a.elev AS e1, b.elev AS e0, b.v AS under FROM {radials} a JOIN {radials} b ON b.vol = a.vol AND b.az = a.az AND b.tilt + 1 = a.tilt),
        m AS (SELECT vol, tilt, x, under[cast(floor((g + 1) * cos(radians(e1)) / cos(radians(e0)) + 0.5) AS int)] AS y FROM q) SELECT vol, tilt, count(*) AS n, count(*) FILTER (abs(x - y) > 20) AS n_differ FROM m WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""",
    "phase_unwrap": """WITH g AS (SELECT vol, tilt, az, unnest(range(64)) AS bin, unnest(v) AS x FROM {radials}), p AS (SELECT vol, tilt, az, bin, 20 * x - 360 * floor(x / 18) AS ph, row_number() OVER (PARTITION BY vol, tilt, az ORDER BY bin) AS k FROM g WHERE x IS NOT NULL),
        s AS (SELECT b.vol, b.tilt, b.az, b.k, CASE WHEN b.ph - a.ph < -270 THEN 1 WHEN b.ph - a.ph > 270 THEN -1 ELSE 0 END AS turn FROM p b JOIN p a ON a.vol = b.vol AND a.tilt = b.tilt AND a.az = b.az AND a.k = b.k - 1)
        SELECT p.vol, p.tilt, p.az, p.bin, round(any_value(p.ph) + 360 * coalesce(sum(s.turn), 0), 3) AS phase FROM p LEFT JOIN s ON s.vol = p.vol AND s.tilt = p.tilt AND s.az = p.az AND s.k <= p.k GROUP BY p.vol, p.tilt, p.az, p.bin""",
    "scans_between": "SELECT site, ts_us, event_id FROM {scans} WHERE make_timestamp(ts_us) BETWEEN TIMESTAMP '2024-01-06 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00'",
    "cross_section": f"""WITH t AS (SELECT DISTINCT vol, tilt, elev FROM {{radials}}), ends AS (SELECT vol, min(elev) AS lo, max(elev) AS hi FROM t GROUP BY vol), rays AS (SELECT DISTINCT vol, az FROM {{radials}}),
        p AS (SELECT bin, h_km, degrees(atan(z / x)) AS e, sqrt(x * x + z * z) AS s FROM (SELECT b.bin, h.bin AS h_km, ({_K} + h.bin) * sin((b.bin + 1) / {_K}) AS x, ({_K} + h.bin) * cos((b.bin + 1) / {_K}) - {_K} AS z FROM {{bins}} b, {{bins}} h WHERE h.bin <= 14) q),
        q AS (SELECT n.vol, p.*, CASE WHEN s >= 0.5 AND s < 64.5 THEN cast(floor(s + 0.5) AS int) END AS i FROM p JOIN ends n ON p.e >= n.lo - 0.475e0 AND p.e < n.hi + 0.475e0),
        a AS (SELECT q.*, t.tilt AS t0, t.elev AS e0 FROM q ASOF LEFT JOIN t ON t.vol = q.vol AND t.elev <= q.e),
        u AS (SELECT a.*, t.tilt AS t1, t.elev AS e1 FROM a ASOF LEFT JOIN t ON t.vol = a.vol AND t.elev > a.e),
        v AS (SELECT u.*, rays.az, below.v[i] AS v0, above.v[i] AS v1 FROM u JOIN rays ON rays.vol = u.vol LEFT JOIN {{radials}} below ON below.vol = u.vol AND below.tilt = u.t0 AND below.az = rays.az LEFT JOIN {{radials}} above ON above.vol = u.vol AND above.tilt = u.t1 AND above.az = rays.az)
        SELECT vol, az, bin, h_km, round(CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (e - e0) / (e1 - e0) WHEN v0 IS NOT NULL AND e - e0 < 0.475e0 THEN v0 WHEN v1 IS NOT NULL AND e1 - e < 0.475e0 THEN v1 END, 4) AS value FROM v""",
    "nearest_tilt": "SELECT s.point_id, first(t.tilt ORDER BY abs(t.elev - s.range_km / 10), t.elev) AS tilt FROM {samples} s, (SELECT DISTINCT tilt, elev FROM {radials}) t GROUP BY s.point_id",
    "quota_prune": """WITH p AS (SELECT * FROM {scans} s WHERE ts_us < (SELECT max(ts_us) FROM {scans} n WHERE n.site = s.site) AND NOT (ts_us >= 1704499200000000 AND ts_us <= 1704585600000000)),
        f AS (SELECT site, event_id, size, coalesce(sum(size) OVER (ORDER BY ts_us, site, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM p)
        SELECT site, event_id, cast(freed_before AS bigint) AS freed_before, size FROM f WHERE (SELECT sum(size) FROM {scans}) - freed_before > 3000000""",
    "eviction_order": """WITH r AS (SELECT *, ts_us BETWEEN 1705795200000000 AND 1706227200000000 AS kept FROM {scans}), t AS (SELECT site, sum(size) AS total FROM r GROUP BY site),
        b AS (SELECT a.site, a.event_id, coalesce(sum(c.size), 0) AS before FROM r a LEFT JOIN r c ON c.site = a.site AND (c.kept, c.ts_us, c.event_id) < (a.kept, a.ts_us, a.event_id) GROUP BY ALL)
        SELECT site, event_id, cast(before AS bigint) AS before FROM b JOIN t USING (site) WHERE total - before > 1000000""",
    "site_shares": "SELECT site, cast(bytes AS bigint) AS bytes, round(100 * bytes / (SELECT sum(size) FROM {scans}), 4) AS percent FROM (SELECT site, sum(size) AS bytes FROM {scans} GROUP BY site) q",
    "mosaic_cells": """WITH d AS (SELECT p.point_id, p.lat, p.lon, p.point_id % (SELECT count(*) FROM {sites}) + 1 AS own, s.site, 111.195e0 * sqrt((p.lat - s.lat) ** 2 + ((p.lon - s.lon) * cos(radians(p.lat))) ** 2) AS km FROM {points} p, {sites} s),
        c AS (SELECT point_id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(own) AS site, min(km) AS km FROM d GROUP BY point_id HAVING first(site ORDER BY km, site) = any_value(own))
        SELECT point_id, site, round(km, 4) AS radar_km FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.site <> c.site AND 111.195e0 * sqrt((c.lat - o.lat) ** 2 + ((c.lon - o.lon) * cos(radians(c.lat))) ** 2) < 6 AND (o.km, o.point_id) < (c.km, c.point_id))""",
    "freezing_level": """SELECT site, round(f, 4) AS freezing_m, cast(floor(f - 369.5) AS bigint) - 600 AS bottom_m, cast(floor(f - 369.5) AS bigint) AS top_m FROM (SELECT site, greatest(0, 5900 - 75 * a + cos(2 * pi() * (19905 % 365.2425::double - 205) / 365.2425::double) * CASE WHEN a < 13 THEN 300 WHEN a > 45 THEN 1900 ELSE 50 * a - 350 END) AS f
        FROM (SELECT site, least(70, greatest(10, abs(lat))) AS a FROM {sites}) q) p""",
}

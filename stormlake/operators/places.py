"""Sites, distances and intervals as portable SQL.

Tables: sites(site, lat, lon), points(point_id, lat, lon), intervals(id, kind, begin_us, end_us).
"""

from __future__ import annotations

from collections.abc import Callable

from stormlake.functions.constants import EARTH_KM, MOSAIC_KM, NEIGHBOURS
from stormlake.operators.scans import last_before

#: Tasks among which pairs of places are dealt: their tables are small, so Spark would give them one.
TASKS = 32


def _distance(a: str, b: str) -> str:
    """Great-circle km between two aliases with lat and lon."""
    return f"(2e0 * {EARTH_KM}e0 * asin(sqrt(least(1e0, power(sin(radians({b}.lat - {a}.lat) / 2e0), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2e0), 2)))))"


def _spots(km: float) -> str:
    """Common tables: spots (lat, lon, sites, i, j, k), places with their sites and the cube of edge ``km`` around the earth's centre that they lie in. Sites that share
    a place share all that is worked out for it."""
    cube = lambda x: f"cast(floor({EARTH_KM}e0 * {x} / {km!r}e0) AS bigint)"
    return f"""SELECT lat, lon, sort_array(collect_list(site)) AS sites, {cube("cos(radians(lat)) * cos(radians(lon))")} AS i, {cube("cos(radians(lat)) * sin(radians(lon))")} AS j, {cube("sin(radians(lat))")} AS k
        FROM {{sites}} GROUP BY lat, lon"""


def _met(columns: str, km: float, where: str = "true") -> str:
    """Columns of pairs of places s and o within a distance, a place with itself among them. Places meet by cubes: a chord is shorter than its arc, so partners lie in the same
    cube or one next to it, at the poles and the date line too. A few cubes hold them all, so places are dealt evenly and the partners, a dimension, broadcast."""
    step = "(SELECT -1 AS d UNION ALL SELECT 0 AS d UNION ALL SELECT 1 AS d)"
    return f"""SELECT /*+ BROADCAST(o) */ {columns} FROM (SELECT /*+ REPARTITION({TASKS}) */ c.lat, c.lon, c.sites, c.i + a.d AS i, c.j + b.d AS j, c.k + e.d AS k FROM ({_spots(km)}) c CROSS JOIN {step} a CROSS JOIN {step} b CROSS JOIN {step} e WHERE {where}) s
        JOIN ({_spots(km)}) o ON o.i = s.i AND o.j = s.j AND o.k = s.k AND {_distance("s", "o")} <= {km!r}e0"""


def _opened(met: str, columns: str) -> str:
    """A row for each pair of different sites at the places of ``met`` (sites, others, columns)."""
    return f"""SELECT site, other, {columns} FROM (SELECT site, explode(others) AS other, {columns} FROM (SELECT explode(sites) AS site, others, {columns} FROM ({met}) m) n) q WHERE site <> other"""


def neighbours(km: float = MOSAIC_KM) -> str:
    """Pairs of sites within a distance."""
    return _opened(_met(f"s.sites, o.sites AS others, round({_distance('s', 'o')}, 4) AS km", km), "km")


def nearest_sites(k: int = NEIGHBOURS, km: float = MOSAIC_KM) -> str:
    """The k nearest other sites of each site within a distance, ties by name.

    Places are ranked, not sites: of each place the first k + 1 sites suffice. Places that find as many within an eighth of the distance look no further.
    """
    near = km / 8
    columns = f"s.lat, s.lon, o.sites, round({_distance('s', 'o')}, 4) AS km"
    return f"""
    WITH close AS ({_met(columns, near)}),
    full AS (SELECT lat, lon FROM close GROUP BY lat, lon HAVING sum(size(sites)) > {k}),
    lacking AS (SELECT x.lat, x.lon FROM (SELECT DISTINCT lat, lon FROM {{sites}}) x LEFT ANTI JOIN full f ON f.lat = x.lat AND f.lon = x.lon),
    met AS (SELECT c.* FROM close c LEFT SEMI JOIN full f ON f.lat = c.lat AND f.lon = c.lon UNION ALL {_met(columns, km, "EXISTS (SELECT 1 FROM lacking x WHERE x.lat = c.lat AND x.lon = c.lon)")}),
    placed AS (SELECT lat, lon, km, explode(slice(sites, 1, {k + 1})) AS other FROM (SELECT *, rank() OVER (PARTITION BY lat, lon ORDER BY km) AS r FROM met) q WHERE r <= {k + 1}),
    first AS (SELECT lat, lon, km, other FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY km, other) AS r FROM placed) q WHERE r <= {k + 1}),
    ranked AS (SELECT s.site, f.other, f.km, row_number() OVER (PARTITION BY s.site ORDER BY f.km, f.other) AS k FROM {{sites}} s JOIN first f ON f.lat = s.lat AND f.lon = s.lon AND f.other <> s.site)
    SELECT site, other, km, cast(k AS bigint) AS rank FROM ranked WHERE k <= {k}"""


def offsets(km: float = MOSAIC_KM) -> str:
    """For each neighbour its place (x east, y north, km) in the site's frame and its meridian convergence in degrees."""

    def project(lat: str, axis: str) -> str:
        dlon = "radians(o.lon - s.lon)"
        hav = f"least(1e0, power(sin((radians({lat}) - radians(s.lat)) / 2e0), 2) + cos(radians(s.lat)) * cos(radians({lat})) * power(sin({dlon} / 2e0), 2))"
        c = f"(2e0 * asin(sqrt({hav})))"
        k = f"({EARTH_KM}e0 * CASE WHEN {c} < 1e-9 THEN 1e0 ELSE {c} / sin({c}) END)"
        return f"{k} * cos(radians({lat})) * sin({dlon})" if axis == "x" else f"{k} * (cos(radians(s.lat)) * sin(radians({lat})) - sin(radians(s.lat)) * cos(radians({lat})) * cos({dlon}))"

    north = "(o.lat + 5e-2)"
    columns = f"""s.sites, o.sites AS others, round({project("o.lat", "x")}, 3) AS x, round({project("o.lat", "y")}, 3) AS y,
        round(degrees(atan2({project(north, "x")} - {project("o.lat", "x")}, {project(north, "y")} - {project("o.lat", "y")})), 3) AS turn"""
    return _opened(_met(columns, km), "x, y, turn")


def nearest_of(points: str, least: Callable[[str, str, float], str], most: Callable[[str, str, float], str]) -> str:
    """Common tables ending in kept (i, j, sites: array of (site, lat, lon)): for each square of an eighth of a degree (i, j: floor of lat and lon times 8) that
    holds a row of ``points`` (lat, lon) the places that can be nearest to one in it, each with its first site.

    least and most: SQL of bounds of the distance between a place and any point of a square, of their names and half the square's width in degrees. A place stays
    where its least distance isn't above the smallest of the places' most; squares of a degree thin the places out for the small ones.
    """
    centre = lambda n: f"(c.i + 5e-1) * {1 / n!r}e0 AS lat, (c.j + 5e-1) * {1 / n!r}e0 AS lon"
    bounds = lambda n: f"{least('c', 's', 0.5 / n)} AS least, {most('c', 's', 0.5 / n)} AS most"
    return f"""
    spots AS (SELECT /*+ REPARTITION({TASKS}) */ lat, lon, min(site) AS site FROM {{sites}} GROUP BY lat, lon),
    small AS (SELECT DISTINCT cast(floor(lat * 8e0) AS bigint) AS i, cast(floor(lon * 8e0) AS bigint) AS j FROM {points}),
    wide AS (SELECT i, j, {centre(1)} FROM (SELECT DISTINCT cast(floor(i / 8e0) AS bigint) AS i, cast(floor(j / 8e0) AS bigint) AS j FROM small) c),
    far AS (SELECT /*+ BROADCAST(c) */ c.i, c.j, s.site, s.lat, s.lon, {bounds(1)} FROM wide c CROSS JOIN spots s),
    reach AS (SELECT i, j, min(most) AS most FROM far GROUP BY i, j),
    held AS (SELECT /*+ BROADCAST(r) */ f.i, f.j, f.site, f.lat, f.lon FROM far f JOIN reach r ON r.i = f.i AND r.j = f.j AND f.least <= r.most + 1e-6),
    close AS (SELECT c.i, c.j, s.site, s.lat, s.lon, {bounds(8)} FROM (SELECT i, j, {centre(8)} FROM small c) c JOIN held s ON s.i = cast(floor(c.i / 8e0) AS bigint) AND s.j = cast(floor(c.j / 8e0) AS bigint)),
    kept AS (SELECT i, j, collect_list(struct(site, lat, lon)) AS sites FROM (SELECT *, min(most) OVER (PARTITION BY i, j) AS upto FROM close) q WHERE least <= upto + 1e-6 GROUP BY i, j)"""


def nearest_radar() -> str:
    """The nearest site of each point; the first wins ties, to a tenth of a millimetre. A point sees the few sites that can be nearest in its square."""
    around = lambda c, h: f"{2 * h * 111.4!r}e0"
    least, most = (lambda c, s, h, sign=sign: f"{_distance(c, s)} {sign} {around(c, h)}" for sign in "-+")
    return f"""
    WITH {nearest_of("{points}", least, most)},
    met AS (SELECT p.point_id, transform(k.sites, s -> struct({_distance("p", "s")} AS km, s.site AS site)) AS seen FROM {{points}} p JOIN kept k ON k.i = cast(floor(p.lat * 8e0) AS bigint) AND k.j = cast(floor(p.lon * 8e0) AS bigint))
    SELECT point_id, array_min(transform(seen, x -> struct(round(x.km, 7) AS km, x.site AS site))).site AS site, round(array_min(transform(seen, x -> x.km)), 4) AS km FROM met"""


def active_at() -> str:
    """Intervals in force at each instant of ticks(at_us), a few, begin <= t < end, counted by kind."""
    return f"""
    SELECT t.at_us, i.kind, count(*) AS n_active FROM {{ticks}} t JOIN {{intervals}} i ON i.begin_us <= t.at_us AND t.at_us < i.end_us GROUP BY t.at_us, i.kind"""


def active_sweep() -> str:
    """How many intervals of each kind are in force after each change: a running sum of begins and ends, without a range join. The sum runs within days,
    upon what the days before have left: a kind's days are numbered in one task, its changes aren't."""
    return """
    WITH changes AS (SELECT kind, begin_us AS at_us, 1 AS d FROM {intervals} WHERE end_us > begin_us UNION ALL SELECT kind, end_us AS at_us, -1 AS d FROM {intervals} WHERE end_us > begin_us),
    summed AS (SELECT kind, at_us, cast(floor(at_us / 86400e6) AS bigint) AS day, sum(d) AS d FROM changes GROUP BY kind, at_us),
    days AS (SELECT kind, day, sum(d) AS d FROM summed GROUP BY kind, day),
    left_over AS (SELECT kind, day, sum(d) OVER (PARTITION BY kind ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM days)
    SELECT s.kind, s.at_us, cast(coalesce(l.before, 0) + sum(s.d) OVER (PARTITION BY s.kind, s.day ORDER BY s.at_us ROWS UNBOUNDED PRECEDING) AS bigint) AS n_active FROM summed s JOIN left_over l ON l.kind = s.kind AND l.day = s.day"""


def latest_issue() -> str:
    """The latest issue at or before each request of its kind, of the same day or the one before: an as-of join."""
    text = last_before("SELECT kind, begin_us AS at_us, id FROM {intervals}", "SELECT site AS kind, at_us, req_id FROM {requests}", "kind")
    return f"SELECT req_id, event_us AS begin_us, id FROM ({text}) q"


#: Hour, minute of issue and order of the day's outlook cycles; that of 1 comes out on the next calendar day.
CYCLES = ((6, 6, 0), (13, 13, 0), (16, 16, 30), (20, 20, 0), (1, 25, 0))


def in_effect() -> str:
    """The outlook in effect at each request: of the convective day, which begins at 12 UTC, the cycle issued last that has
    areas. Tables: outlooks(day, cycle, n_areas), requests(req_id, at_us)."""
    cycles = " UNION ALL ".join(f"SELECT {c} AS cycle, {h * 3600 + m * 60} AS issued_s, {k} AS place" for k, (c, h, m) in enumerate(CYCLES))
    return f"""
    WITH asked AS (SELECT req_id, at_us, cast(floor((at_us - 43200e6) / 86400e6) AS bigint) AS day FROM {{requests}}),
    issued AS (SELECT o.day, o.cycle, c.place, o.day * 86400000000 + cast(c.issued_s AS bigint) * 1000000 AS issued_us FROM {{outlooks}} o JOIN ({cycles}) c ON c.cycle = o.cycle WHERE o.n_areas > 0)
    SELECT a.req_id, a.day, max_by(i.cycle, i.place) AS cycle, max(i.issued_us) AS issued_us FROM asked a JOIN issued i ON i.day = a.day AND i.issued_us <= a.at_us GROUP BY a.req_id, a.day"""


def in_polygon(cell_deg: float = 2.0) -> str:
    """Points inside rings (ring_id and edges x0, y0, x1, y1) of any shape: ray casting, odd crossings. A point on an edge, to
    rounding, is inside where the angles under which it sees the edges sum to about half a turn or more; zeros keep their signs in these, which
    Spark's atan2 drops and a point on a corner depends on.

    A ring lies in the squares of a grid that its bounding box meets; a point asks for the rings of its own square, and then for the edges
    of those whose box holds it.
    """
    square = lambda x: f"cast(floor({x} / {cell_deg!r}e0) AS bigint)"
    minus = lambda x: f"cast({x} AS string) = '-0.0'"
    angle = f"CASE WHEN turn <> 0e0 THEN atan2(turn, along) WHEN along < 0e0 OR {minus('along')} THEN CASE WHEN {minus('turn')} THEN -pi() ELSE pi() END ELSE 0e0 END"
    return f"""
    WITH boxes AS (SELECT ring_id, min(least(x0, x1)) AS w, max(greatest(x0, x1)) AS e, min(least(y0, y1)) AS s, max(greatest(y0, y1)) AS n FROM {{edges}} GROUP BY ring_id),
    columns AS (SELECT *, explode(sequence({square("w")}, {square("e")})) AS i FROM boxes),
    squares AS (SELECT ring_id, w, e, s, n, i, explode(sequence({square("s")}, {square("n")})) AS j FROM columns),
    placed AS (SELECT point_id, lat, lon, {square("lon")} AS i, {square("lat")} AS j FROM {{points}}),
    met AS (SELECT p.point_id, p.lat, p.lon, q.ring_id FROM placed p JOIN squares q ON q.i = p.i AND q.j = p.j AND p.lon BETWEEN q.w AND q.e AND p.lat BETWEEN q.s AND q.n),
    sides AS (SELECT m.point_id, e.ring_id, (e.y0 > m.lat) <> (e.y1 > m.lat) AND m.lon < (e.x1 - e.x0) * (m.lat - e.y0) / nullif(e.y1 - e.y0, 0e0) + e.x0 AS crosses, e.x0 - m.lon AS ax, e.y0 - m.lat AS ay, e.x1 - m.lon AS bx, e.y1 - m.lat AS by_
        FROM met m JOIN {{edges}} e ON e.ring_id = m.ring_id),
    seen AS (SELECT point_id, ring_id, crosses, ax * by_ - ay * bx AS turn, ax * bx + ay * by_ AS along FROM sides)
    SELECT point_id, ring_id FROM seen GROUP BY point_id, ring_id
    HAVING CASE WHEN max(abs(turn) <= 1e-9 AND along <= 1e-9) THEN abs(sum({angle})) > 3e0 ELSE sum(CASE WHEN crosses THEN 1 ELSE 0 END) % 2 = 1 END"""

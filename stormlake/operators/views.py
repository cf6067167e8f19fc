"""What a viewer asks of volumes, cells and areas: sweeps to show, thresholds, frames of other radars, areas with holes,
nearest things, sections split between radars, and picks along a ray."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlake.functions import geometry
from stormlake.functions.constants import FORECAST_MIN, KE_A_KM, MISSING, RANGE_FOLDED, VALID_ABOVE
from stormlake.operators.sections import HALF_BEAM

#: Fields whose threshold is on the absolute value.
SIGNED = ("VEL", "DVEL", "AZSHR", "ROT", "KDP")


def nearest_sweep_with(sweeps: DataFrame, field: str, index: int) -> DataFrame:
    """(icao, scan_time, sweep): of sweeps (icao, scan_time, sweep, fields) the one nearest an index that carries a field, the
    lower on ties."""
    some = sweeps.filter(F.array_contains("fields", field))
    return some.groupBy("icao", "scan_time").agg(F.min_by("sweep", F.struct(F.abs(F.col("sweep") - index).alias("d"), F.col("sweep").alias("s"))).alias("sweep"))


def sweeps_for(tilts: DataFrame, elevation: float, everything: bool) -> DataFrame:
    """Tilts (icao, scan_time, tilt, elev) that a view reads: all, or the nearest to an elevation, the lower on ties."""
    if everything:
        return tilts
    order = Window.partitionBy("icao", "scan_time").orderBy(F.abs(F.col("elev") - elevation), "elev")
    return tilts.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def isolate(tilts: DataFrame, elevation: float, mode: str) -> DataFrame:
    """``all`` tilts, those at or ``below`` an elevation, or the ``single`` nearest one."""
    if mode not in ("all", "below", "single"):
        raise ValueError(mode)
    if mode == "below":
        return tilts.filter(F.col("elev") <= elevation + 1e-6)
    return sweeps_for(tilts, elevation, mode == "all")


def over_threshold(v: Column, field: str, threshold: float) -> Column:
    """Whether a gate is shown: valid, and its value, or absolute value for signed fields, not below the threshold."""
    return (v > VALID_ABOVE) & ((F.abs(v) if field in SIGNED else v) >= threshold)


def between_tilts(low: Column, high: Column, elev: Column, e0: Column, e1: Column, categorical: bool = False, folded: bool = True) -> Column:
    """Value at an elevation from the gates of the tilts below (at e0) and above (at e1); null is no data.

    Both valid: blended by elevation, or the nearer one of a ``categorical`` field (the higher on ties), as codes have no means.
    One valid: it, less than half a beam from its tilt. Else range folding, if the nearer gate is folded and ``folded`` asks for
    it (a section shows it, a volume doesn't). Without a second tilt (e1 null or e0) the first one's gate stands. Null gates are missing.
    """
    low, high, reach = F.coalesce(low, F.lit(MISSING)), F.coalesce(high, F.lit(MISSING)), float(HALF_BEAM)
    share = F.coalesce(F.try_divide(elev - e0, e1 - e0), F.lit(0.0))
    alone = e1.isNull() | (e1 == e0)
    nearer = F.when(share < 0.5, low).otherwise(high)
    has_low, has_high = low > VALID_ABOVE, ~alone & (high > VALID_ABOVE)
    met = nearer if categorical else low + (high - low) * share
    one = F.when(has_low & (alone | (elev - e0 < reach)), low).when(has_high & (e1 - elev < reach), high)
    rest = F.when(nearer <= RANGE_FOLDED, F.lit(RANGE_FOLDED)) if folded else F.lit(None).cast("double")
    return F.when(has_low & has_high, met).otherwise(F.coalesce(one, rest))


def live_target(frames: DataFrame, shown: str, playing: bool) -> DataFrame:
    """The newest frame (name, scan_time) if it isn't shown and playback rests."""
    newest = frames.agg(F.max_by("name", F.struct("scan_time", "name")).alias("name"))
    return newest.filter((F.col("name") != shown) & F.lit(not playing))


def to_frame(x: Column, y: Column, x0: Column, y0: Column, turn_deg: Column) -> tuple[Column, Column]:
    """A place in another radar's frame moved to this one: turned by the convergence, then shifted."""
    c, s = F.cos(F.radians(turn_deg)), F.sin(F.radians(turn_deg))
    return x * c + y * s + x0, y * c - x * s + y0


def move_tracks(cells: DataFrame, offsets: DataFrame) -> DataFrame:
    """Cells (site, x, y, track array<struct<x,y>>) of neighbours in the frame of the radar that offsets (other, x0, y0, turn)
    belong to."""
    met = cells.join(F.broadcast(offsets), cells["site"] == offsets["other"])
    point = lambda x, y: to_frame(x, y, F.col("x0"), F.col("y0"), F.col("turn"))
    x, y = point(F.col("x"), F.col("y"))
    moved = F.transform("track", lambda p: F.struct(point(p["x"], p["y"])[0].alias("x"), point(p["x"], p["y"])[1].alias("y")))
    return met.select("site", x.alias("x"), y.alias("y"), moved.alias("track"))


def forecast(x: Column, y: Column, u_ms: Column, v_ms: Column) -> Column:
    """Places in 15, 30 and 45 minutes; null without motion."""
    places = F.array(*[F.struct(F.lit(m).alias("minutes"), (x + u_ms * m * 0.06).alias("x"), (y + v_ms * m * 0.06).alias("y")) for m in FORECAST_MIN])
    return F.when(u_ms.isNotNull(), places)


def _inside(ring: Column, lon: Column, lat: Column) -> Column:
    """Ray casting over a closed ring of (lon, lat) arrays."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def in_areas(points: DataFrame, areas: DataFrame, rank: str | None = None, holes: bool = True) -> DataFrame:
    """Points (point_id, lon, lat) in areas (area_id, outer, holes, rank): with holes a point in one isn't in the area. With a
    rank only the highest area of each point. Areas are broadcast where Spark finds them small; both sides meet by
    one-degree cells first."""
    box = lambda k, f: f(F.transform("outer", lambda p: p[k]))
    cell = lambda c: F.floor(c).cast("int")
    spread = areas.withColumn("i", F.explode(F.sequence(cell(box(0, F.array_min)), cell(box(0, F.array_max))))).withColumn("j", F.explode(F.sequence(cell(box(1, F.array_min)), cell(box(1, F.array_max)))))
    met = points.withColumns({"i": cell(F.col("lon")), "j": cell(F.col("lat"))}).join(spread, ["i", "j"])
    hit = _inside(F.col("outer"), F.col("lon"), F.col("lat"))
    if holes:
        hit = hit & ~F.exists("holes", lambda h: _inside(h, F.col("lon"), F.col("lat")))
    met = met.filter(hit).select("point_id", "area_id", *([rank] if rank else []))
    return met.groupBy("point_id").agg(F.max_by("area_id", F.struct(rank, "area_id")).alias("area_id")) if rank else met.distinct()


def nearest_within(points: DataFrame, cells: DataFrame, km: float = 6.0) -> DataFrame:
    """For each point (point_id, x, y) the nearest cell (cell_id, x, y) within a distance, the lower id on ties; an equi-join
    on squares of that size and their neighbours."""
    square = lambda c: F.floor(c / km).cast("int")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("i", F.explode(F.transform(around, lambda d: square(F.col("px")) + d))).withColumn("j", F.explode(F.transform(around, lambda d: square(F.col("py")) + d)))
    c = cells.select("cell_id", F.col("x").alias("cx"), F.col("y").alias("cy")).withColumns({"i": square(F.col("cx")), "j": square(F.col("cy"))})
    met = p.join(c, ["i", "j"]).withColumn("km", F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))).filter(F.col("km") <= km)
    return met.groupBy("point_id").agg(F.min(F.struct("km", "cell_id")).alias("m")).select("point_id", "m.cell_id", "m.km")


def cities_around(cities: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Cities (name, lat, lon, population) within a radius, placed in the site's frame, largest first."""
    x, y = geometry.project(F.col("lat"), F.col("lon"), lat, lon)
    return cities.withColumns({"x": x, "y": y}).filter(F.hypot("x", "y") <= km).orderBy(F.desc("population"), "name")


def project_rings(areas: DataFrame, lat: float, lon: float) -> DataFrame:
    """Outer rings in a site's frame as arrays of (x, y)."""
    place = lambda p: F.array(*geometry.project(p[1], p[0], lat, lon))
    return areas.withColumn("ring", F.transform("outer", place))


def section_pieces(lines: DataFrame, radars: DataFrame) -> DataFrame:
    """(line_id, radar, t0, t1): stretches of a line (line_id, ax, ay, bx, by) by nearest radar (radar, x, y), the first on
    ties.

    Along a line the squared distances to two radars differ by a linear function of t, so each radar's stretch is the
    intersection of half-lines: a closed form, without sampling or bisection. Radars are a few, and broadcast.
    """
    a = lines.join(F.broadcast(radars.select(F.col("radar"), F.col("x").alias("rx"), F.col("y").alias("ry"))))
    both = a.join(F.broadcast(radars.select(F.col("radar").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")))).filter("other <> radar")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    # |p - r|^2 - |p - o|^2 = base + slope t, at most 0 where r is nearer
    base = (F.col("ax") - F.col("rx")) ** 2 + (F.col("ay") - F.col("ry")) ** 2 - (F.col("ax") - F.col("ox")) ** 2 - (F.col("ay") - F.col("oy")) ** 2
    slope = 2 * (dx * (F.col("ox") - F.col("rx")) + dy * (F.col("oy") - F.col("ry")))
    root = F.when(slope != 0, -base / slope)
    never = (slope == 0) & ((base > 0) | ((base == 0) & (F.col("other") < F.col("radar"))))
    bounds = both.groupBy("line_id", "radar").agg(F.max(F.when(slope < 0, root)).alias("lo"), F.min(F.when(slope > 0, root)).alias("hi"), F.max(never).alias("never"))
    alone = a.select("line_id", "radar").join(bounds, ["line_id", "radar"], "left")
    t0, t1 = F.greatest(F.coalesce("lo", F.lit(0.0)), F.lit(0.0)), F.least(F.coalesce("hi", F.lit(1.0)), F.lit(1.0))
    return alone.filter(~F.coalesce("never", F.lit(False))).select("line_id", "radar", t0.alias("t0"), t1.alias("t1")).filter("t1 > t0")


def _bisected(lo: str, hi: str, rises: str, rounds: int = 44) -> str:
    """SQL for where a function changes between lo and hi: ``rises`` says, of ``m``, whether the place lies beyond it."""
    middle = "((w.a + w.b) / 2)"
    return f"aggregate(sequence(1, {rounds}), named_struct('a', {lo}, 'b', {hi}), (w, i) -> CASE WHEN {rises.replace('$m', middle)} THEN named_struct('a', {middle}, 'b', w.b) ELSE named_struct('a', w.a, 'b', {middle}) END, w -> (w.a + w.b) / 2)"


def crossings(rays: DataFrame, tilts: DataFrame, keys: list[str]) -> DataFrame:
    """(rays' columns, tilt, elev, t) for each place where a ray (keys, ray_id, x, y, z, dx, dy, dz; km east, north, up) meets the surface of a tilt (keys, tilt, elev,
    reach_km: slant range of its end), from either side, above the ground and within reach.

    Along a ray its height is linear and a tilt's height a convex function, so the difference is concave: it has one top, found where its slope changes sign,
    and meets zero once before and once behind it at most. All three are bisected, so nothing depends on a step, and two crossings however near are two.
    """
    k = repr(KE_A_KM)
    rows = rays.join(tilts.select(*keys, "tilt", "elev", "reach_km"), keys)
    rows = rows.withColumns({"e": F.radians("elev"), "aa": F.col("dx") ** 2 + F.col("dy") ** 2, "bb": F.col("x") * F.col("dx") + F.col("y") * F.col("dy")})
    rows = rows.withColumn("s1", F.expr(f"{k}D * atan2(reach_km * cos(e), {k}D + reach_km * sin(e))"))
    rows = rows.withColumns({"root": F.expr("bb * bb - aa * (x * x + y * y - s1 * s1)"), "top": F.expr(f"{k}D * cos(e) / cos(e + s1 / {k}D) - {k}D")})
    # where the ray is above ground, within reach, and not above all of the surface
    low = "greatest(0D, CASE WHEN aa > 0 THEN (-bb - sqrt(greatest(root, 0D))) / aa ELSE 0D END, CASE WHEN dz > 0 THEN -z / dz WHEN dz < 0 THEN (top - z) / dz ELSE 0D END)"
    high = "least(CASE WHEN aa > 0 THEN (-bb + sqrt(greatest(root, 0D))) / aa ELSE double('infinity') END, CASE WHEN dz < 0 THEN -z / dz WHEN dz > 0 THEN (top - z) / dz ELSE double('infinity') END)"
    rows = rows.filter("root >= 0 AND (dz <> 0 OR z >= 0) AND (aa > 0 OR dz <> 0)").withColumns({"t0": F.expr(low), "t1": F.expr(high)}).filter("t0 <= t1")
    ground = lambda t: f"sqrt((x + dx * {t}) * (x + dx * {t}) + (y + dy * {t}) * (y + dy * {t}))"
    over = lambda t: f"(z + dz * {t} - {k}D * cos(e) / cos(e + {ground(t)} / {k}D) + {k}D)"
    slope = lambda t: f"(dz - coalesce(cos(e) * sin(e + {ground(t)} / {k}D) / power(cos(e + {ground(t)} / {k}D), 2) * try_divide(bb + aa * {t}, {ground(t)}), 0D))"
    # a concave function that is above zero at both ends meets it nowhere, at one end once; only below it at both does the top matter
    rows = rows.withColumns({"f0": F.expr(over("t0")), "f1": F.expr(over("t1"))}).filter("NOT (f0 > 0 AND f1 > 0)")
    rows = rows.withColumn("tm", F.expr(f"CASE WHEN f0 > 0 THEN t0 WHEN f1 > 0 THEN t1 ELSE {_bisected('t0', 't1', slope('$m') + ' > 0')} END"))
    up = f"CASE WHEN {over('t0')} <= 0 AND {over('tm')} >= 0 THEN {_bisected('t0', 'tm', over('$m') + ' < 0')} END"
    down = f"CASE WHEN {over('tm')} >= 0 AND {over('t1')} <= 0 THEN {_bisected('tm', 't1', over('$m') + ' > 0')} END"
    rows = rows.withColumn("t", F.explode_outer(F.expr(f"array_distinct(filter(array({up}, {down}), t -> t IS NOT NULL))"))).filter("t IS NOT NULL")
    return rows.select(*rays.columns, "tilt", "elev", "t")


def pick(rays: DataFrame, sweeps: DataFrame, keys: list[str], n_az: int, others: DataFrame | None = None, least: float | None = None, signed: bool = False, first_km: float = 1.0, spacing_km: float = 1.0) -> DataFrame:
    """The first gate that is drawn along each ray (keys, ray_id, x, y, z, dx, dy, dz): (keys, ray_id, tilt, t, az_deg, slant_km, ground_km, height_km, value).

    A ray passes through a tilt's surface where the gate of the sweep (keys, tilt, elev, az, v) is missing, under ``least`` (in size if ``signed``) or nearer to another radar
    (others: keys, x, y), and ends at the ground. Of crossings at one place the lower tilt counts. Rays without a hit give no row.
    """
    size = F.max(F.size("v"))
    tilts = sweeps.groupBy(*keys, "tilt").agg(F.min("elev").alias("elev"), (F.lit(first_km) + (size - F.lit(0.5)) * spacing_km).alias("reach_km"))
    hits = crossings(rays.select(*keys, "ray_id", "x", "y", "z", "dx", "dy", "dz"), tilts, keys)
    hits = hits.withColumns({"px": F.col("x") + F.col("dx") * F.col("t"), "py": F.col("y") + F.col("dy") * F.col("t")}).withColumn("ground_km", F.hypot("px", "py"))
    if others is not None:
        # a radar has a few neighbours
        near = others.groupBy(*keys).agg(F.collect_list(F.struct(F.col("x").alias("ox"), F.col("y").alias("oy"))).alias("near"))
        hits = hits.join(near, keys, "left").filter("NOT coalesce(exists(near, o -> hypot(px - o.ox, py - o.oy) < ground_km), false)")
    e, phi = F.radians("elev"), F.col("ground_km") / KE_A_KM
    hits = hits.withColumns({"az_deg": F.pmod(F.degrees(F.atan2("px", "py")), F.lit(360.0)), "slant_km": F.lit(KE_A_KM) * F.sin(phi) / F.cos(e + phi)})
    hits = hits.withColumns({"az": F.pmod(F.floor(F.col("az_deg") * n_az / 360), F.lit(n_az)), "gate": F.floor((F.col("slant_km") - first_km) / spacing_km + 0.5).cast("int")})
    met = hits.join(sweeps.select(*keys, "tilt", "az", "v"), [*keys, "tilt", "az"]).withColumn("value", F.get("v", F.col("gate"))).filter("value IS NOT NULL")
    if least is not None:
        met = met.filter((F.abs("value") if signed else F.col("value")) >= least)
    first = F.min(F.struct("t", "tilt", "az_deg", "slant_km", "ground_km", (F.col("z") + F.col("dz") * F.col("t")).alias("height_km"), "value")).alias("m")
    return met.groupBy(*keys, "ray_id").agg(first).select(*keys, "ray_id", "m.tilt", "m.t", "m.az_deg", "m.slant_km", "m.ground_km", "m.height_km", "m.value")


def tilt_stack(rays: DataFrame) -> DataFrame:
    """(vol, az, layers): the tilts of each ray (vol, tilt, elev, az, v), lowest first, padded with the sentinel to the widest of
    the volume; a tilt of the volume that lacks the ray is a layer of sentinels. A volume has a few dozen tilts."""
    tilts = rays.groupBy("vol", "tilt").agg(F.min("elev").alias("elev"), F.max(F.size("v")).alias("width"))
    whole = tilts.groupBy("vol").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("tilt", "elev"))).alias("tilts"))
    held = rays.groupBy("vol", "az").agg(F.array_sort(F.collect_list(F.struct("tilt", "elev", "v"))).alias("held")).join(whole, "vol")
    empty = "array(struct(t.tilt AS tilt, t.elev AS elev, array_repeat({0}, width) AS v))"
    padded = "transform(filter(held, h -> h.tilt = t.tilt), h -> struct(h.tilt AS tilt, h.elev AS elev, concat(transform(h.v, x -> coalesce(x, {0})), array_repeat({0}, width - size(h.v))) AS v))"
    layers = f"flatten(transform(tilts, t -> CASE WHEN exists(held, h -> h.tilt = t.tilt) THEN {padded} ELSE {empty} END))".replace("{0}", f"{float(MISSING)!r}D")
    return held.select("vol", "az", F.expr(layers).alias("layers"))


def storm_vectors(vols: DataFrame, own: DataFrame, by_hand: DataFrame) -> DataFrame:
    """Storm motion (u, v) of each volume: one set by hand, else its own, else none."""
    named = lambda d, n: d.select("vol", F.col("u").alias(f"{n}_u"), F.col("v").alias(f"{n}_v"))
    met = vols.join(named(own, "own"), "vol", "left").join(F.broadcast(named(by_hand, "set")), "vol", "left")
    return met.select(*vols.columns, F.coalesce("set_u", "own_u", F.lit(0.0)).alias("u"), F.coalesce("set_v", "own_v", F.lit(0.0)).alias("v"))

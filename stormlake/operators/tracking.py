"""Cells of one frame linked to those of the next, and gates around cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlake.functions.constants import CELL_SEARCH_KM, TDS_MAX_RHO, TDS_MAX_ZDR, TDS_MIN_DBZ, TDS_MIN_GATES, TDS_MIN_ROT, TDS_RADIUS_KM, TRACK_MATCH_KM, TRACK_NEW_KM
from stormlake.sources.shared import checkpointed

#: About how many pairs a cell makes at first.
PAIRS_OF_A_CELL = 8


def predicted(cells: DataFrame) -> DataFrame:
    """Where cells (x, y in km, u, v in m/s or null, dt_s) are looked for in the next frame, and within which distance: nearer where their
    motion is known."""
    known = F.col("u").isNotNull() & F.col("v").isNotNull()
    ahead = lambda at, speed: F.when(known, F.col(at) + F.col(speed) * F.col("dt_s") / 1000).otherwise(F.col(at))
    return cells.withColumns({"px": ahead("x", "u"), "py": ahead("y", "v"), "reach_km": F.when(known, TRACK_MATCH_KM).otherwise(TRACK_NEW_KM)})


def links(before: DataFrame, after: DataFrame, keys: list[str], widest_km: float = TRACK_NEW_KM) -> DataFrame:
    """(keys, before_id, after_id, km): each cell of ``after`` (keys, id, x, y) with at most one of ``before`` (keys, id, px, py, reach_km), the
    nearest pairs first.

    Pairs are those of neighbouring squares of a grid. A pair that is the nearest of all free pairs of both its cells is taken, in rounds, until no pair of two free
    cells is left: with ties broken by after_id, then before_id, those are the pairs that taking the nearest one after another would give. Every round takes
    the nearest pair of each key at least, and mostly nearly all.

    Where cells are crowded, pairs within a fraction of ``widest_km`` are taken first and only cells still free look twice as far, again and again: nearer pairs
    always go first, so that changes nothing but how many pairs are ever made. The first fraction is chosen so that a cell has a few.
    """
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    looking = before.filter("reach_km <= " + repr(widest_km)).select(*keys, F.col("id").alias("before_id"), "px", "py", "reach_km")
    there = after.select(*keys, F.col("id").alias("after_id"), "x", "y")

    def squares(rows: DataFrame, x: str, y: str, km: float) -> DataFrame:
        return rows.withColumns({"i": F.floor(F.col(x) / km), "j": F.floor(F.col(y) / km)})

    def crowd() -> float:
        """About how many pairs a cell has within the widest distance: those of equal squares, pi of them."""
        count = lambda rows, x, y, n: squares(rows, x, y, widest_km).groupBy(*keys, "i", "j").agg(F.count("*").alias(n))
        met = count(looking, "px", "py", "n").join(count(there, "x", "y", "m"), [*keys, "i", "j"])
        pairs, cells = met.agg(F.sum(F.col("n").cast("double") * F.col("m")), F.sum("n")).first()
        return math.pi * pairs / cells if cells else 0.0

    pair = F.struct("km", "after_id", "before_id")
    out = None
    for halvings in range(min(12, max(0, math.ceil(math.log(max(crowd(), 1.0) / PAIRS_OF_A_CELL, 4)))), -1, -1):
        reach = widest_km / 2**halvings
        if out is not None:
            looking = checkpointed(looking.join(out.select(*keys, "before_id"), [*keys, "before_id"], "left_anti"))
            there = checkpointed(there.join(out.select(*keys, "after_id"), [*keys, "after_id"], "left_anti"))
        near = squares(looking, "px", "py", reach).withColumn("di", F.explode(step)).withColumn("dj", F.explode(step)).withColumns({"i": F.col("i") + F.col("di"), "j": F.col("j") + F.col("dj")})
        km = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
        free = checkpointed(near.join(squares(there, "x", "y", reach), [*keys, "i", "j"]).withColumn("km", km).filter(F.col("km") <= F.least("reach_km", F.lit(reach))).select(*keys, "before_id", "after_id", "km"))
        out = free.limit(0) if out is None else out
        while free.limit(1).count():
            nearest = lambda c: F.min(pair).over(Window.partitionBy(*keys, c))
            taken = checkpointed(free.withColumns({"a": nearest("after_id"), "b": nearest("before_id")}).filter((F.col("a") == pair) & (F.col("b") == pair)).select(*keys, "before_id", "after_id", "km"))
            out = out.unionByName(taken)
            free = checkpointed(free.join(taken.select(*keys, "after_id"), [*keys, "after_id"], "left_anti").join(taken.select(*keys, "before_id"), [*keys, "before_id"], "left_anti"))
    return out


def _bearing(az: Column, n_az: int) -> Column:
    """Radians of a ray's middle, in the one order of steps that decides which gates lie at the very edge of a reach."""
    return (az + 0.5) * math.pi / (n_az / 2)


def around(places: DataFrame, rays: DataFrame, keys: list[str], n_az: int, reach_km: float, first_km: float = 1.0, spacing_km: float = 1.0, gates: str = "v") -> DataFrame:
    """Rays (keys, az, arrays) near each place (keys, id, x_km, y_km), with ``near``: the gates of the array ``gates`` whose centres are within the reach.

    A place asks for the rays within the angle under which its circle is seen, all of them where the radar lies within it, and on each for the gates of the
    circle's chord: an index over azimuth whose reach widens towards the radar. Gates never become rows.
    """
    turn = 2 * math.pi / n_az
    s = F.hypot("x_km", "y_km")
    angle = F.when(s > reach_km, F.asin(F.lit(reach_km) / s)).otherwise(math.pi)
    at = F.atan2("x_km", "y_km")
    lo, hi = F.floor((at - angle) / turn - 0.5).cast("int"), F.ceil((at + angle) / turn - 0.5).cast("int")
    asked = places.select(*keys, "id", "x_km", "y_km", F.explode(F.sequence(lo, F.least(hi, lo + n_az - 1))).alias("k")).withColumn("az", F.pmod("k", F.lit(n_az)).cast("bigint")).drop("k")
    rows = asked.join(rays.withColumn("az", F.col("az").cast("bigint")), [*keys, "az"])
    theta = _bearing(F.col("az"), n_az)
    rows = rows.withColumns({"east": F.sin(theta), "north": F.cos(theta)}).withColumn("along", F.col("x_km") * F.col("east") + F.col("y_km") * F.col("north"))
    beside2 = F.col("x_km") ** 2 + F.col("y_km") ** 2 - F.col("along") ** 2
    half = F.sqrt(F.greatest(F.lit(reach_km**2) - beside2, F.lit(0.0)))
    gate = lambda km, way: way((km - first_km) / spacing_km).cast("int")
    # a gate more at either end, then the distance itself decides
    first, last = F.greatest(gate(F.col("along") - half, F.floor), F.lit(0)), F.least(gate(F.col("along") + half, F.ceil), F.size(gates) - 1)
    rows = rows.withColumns({"lo": first, "hi": last}).filter("lo <= hi")
    km = f"({first_km!r}D + g * {spacing_km!r}D)"
    return rows.withColumn("near", F.expr(f"filter(sequence(lo, hi), g -> sqrt(power({km} * east - x_km, 2) + power({km} * north - y_km, 2)) <= {reach_km!r}D)")).drop("east", "north", "along", "lo", "hi").filter(F.size("near") > 0)


def rotation(places: DataFrame, rays: DataFrame, keys: list[str], n_az: int, first_km: float = 1.0, spacing_km: float = 1.0) -> DataFrame:
    """(keys, id, rot, peak_az, peak_gate, n_debris, debris) of cells (keys, id, x_km, y_km): the strongest rotation (array rot) within 8 km, 0 if there is none, the last such
    gate in order of azimuth and range, and whether lofted debris lies within 3 km of it: 6 gates or more of 40 dBZ, correlation up to 0.80 and 0.5 dB (arrays z,
    rho and zdr) where it turns by 10 or more."""
    valid = "filter(near, g -> get(rot, g) IS NOT NULL)"
    met = around(places, rays.select(*keys, "az", "rot"), keys, n_az, CELL_SEARCH_KM, first_km, spacing_km, "rot")
    best = met.select(*keys, "id", "az", F.expr(f"array_max(transform({valid}, g -> struct(get(rot, g) AS rot, cast(g AS bigint) AS gate)))").alias("m")).filter("m IS NOT NULL")
    best = best.groupBy(*keys, "id").agg(F.max(F.struct("m.rot", "az", "m.gate")).alias("m")).select(*keys, "id", "m.rot", F.col("m.az").alias("peak_az"), F.col("m.gate").alias("peak_gate"))
    angle, km = _bearing(F.col("peak_az"), n_az), F.lit(first_km) + F.col("peak_gate") * spacing_km
    peaks = best.filter(F.col("rot") >= TDS_MIN_ROT).select(*keys, "id", (km * F.sin(angle)).alias("x_km"), (km * F.cos(angle)).alias("y_km"))
    lofted = F.expr(f"size(filter(near, g -> get(z, g) >= {TDS_MIN_DBZ!r}D AND get(rho, g) <= {TDS_MAX_RHO!r}D AND get(zdr, g) <= {TDS_MAX_ZDR!r}D))")
    counts = around(peaks, rays.select(*keys, "az", "z", "rho", "zdr"), keys, n_az, TDS_RADIUS_KM, first_km, spacing_km, "rho").select(*keys, "id", lofted.alias("n")).groupBy(*keys, "id").agg(F.sum("n").alias("n_debris"))
    out = places.select(*keys, "id").join(best, [*keys, "id"], "left").join(counts, [*keys, "id"], "left")
    n = F.coalesce("n_debris", F.lit(0)).cast("bigint")
    return out.select(*keys, "id", F.greatest(F.coalesce("rot", F.lit(0.0)), F.lit(0.0)).alias("rot"), "peak_az", "peak_gate", n.alias("n_debris"), (n >= TDS_MIN_GATES).alias("debris"))

"""Fields of gates from their neighbours on rays, in array form: one row is a ray, gates are never rows of a shuffle.

Rays are (keys, az, arrays of one length): missing gates null, azimuth bins from 0 to ``n_az`` - 1. Windows are cut at a ray's ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlake.functions.constants import (
    EARTH_43_M, KDP_HALF_M, KDP_HEAVY_DBZ, KDP_LEAST, KDP_MIN_DBZ, KDP_MIN_RHO, KDP_MOST, KDP_RESIDUAL_DEG, ML_DBZ, ML_DEPTH_IQR_M, ML_ELEVATIONS, ML_GATES, ML_RANGE_M, ML_RHO, ML_ZDR, SHEAR_HALF_M, SHEAR_MIN_M, SHEAR_RADIALS, SHEAR_RESIDUAL_MS,
)


def shear_reach(n_az: int, gates: int, first_m: float, spacing_m: float) -> list[int]:
    """Rays that the fit of each gate takes to either side: as many as lie within 750 m of arc, 1 to 10; none nearer than 2 km."""
    out = []
    for g in range(gates):
        r = first_m + g * spacing_m
        arc = r * 2 * math.pi / n_az
        out.append(min(max(math.floor(SHEAR_HALF_M / arc + 0.5), 1), SHEAR_RADIALS) if r >= SHEAR_MIN_M else 0)
    return out


def azimuthal_shear(rays: DataFrame, keys: list[str], n_az: int, gates: int, first_m: float = 1000.0, spacing_m: float = 1000.0) -> DataFrame:
    """(keys, az, shear): slope of velocity (column v) over arc length, in 10^-3 / s, by least squares over the rays of ``shear_reach`` to either side
    and a gate before and behind; clockwise rise is positive.

    Null unless the gate is valid, both sides have a valid gate, half the window is valid and velocity scatters by at most 6 m/s about the fit. Azimuth
    wraps: the first and last rays are copied beyond the ends. A neighbour that is k rays away is read only up to the last gate that reaches so
    far, so what a row holds beside its own ray is about two rays.
    """
    reach = shear_reach(n_az, gates, first_m, spacing_m)
    most = max(reach, default=0)
    if 2 * most + 1 > n_az:
        raise ValueError(f"{n_az} rays are too few for fits of {2 * most + 1}")
    rows = rays.select(*keys, F.col("az").cast("int").alias("az"), "v")
    beyond = F.expr(f"concat(array(az), CASE WHEN az < {most} THEN array(az + {n_az}) WHEN az >= {n_az - most} THEN array(az - {n_az}) ELSE array() END)")
    rows = rows.select(*keys, F.explode(beyond).alias("az"), "v")
    order = Window.partitionBy(*keys).orderBy("az")

    def beside(k: int) -> Column:
        # one gate more, as fits take a gate behind
        far = max((g for g in range(gates) if reach[g] >= abs(k)), default=-1) + 2
        return F.first(F.slice("v", 1, far)).over(order.rangeBetween(k, k)) if k else F.col("v")

    rows = rows.select(*keys, "az", "v", F.array(*[beside(k) for k in range(-most, most + 1)]).alias("around")).filter(F.col("az").between(0, n_az - 1))
    zero = "named_struct('n', 0D, 'sx', 0D, 'sv', 0D, 'sxx', 0D, 'sxv', 0D, 'svv', 0D, 'l', 0, 'r', 0)"
    x = f"(k * ({first_m!r}D + g * {spacing_m!r}D) * {2 * math.pi / n_az!r}D)"
    add = f"named_struct('n', b.n + 1, 'sx', b.sx + {x}, 'sv', b.sv + y, 'sxx', b.sxx + {x} * {x}, 'sxv', b.sxv + {x} * y, 'svv', b.svv + y * y, 'l', b.l + int(k < 0), 'r', b.r + int(k > 0))"
    n = f"get(array({', '.join(map(str, reach))}), g)"
    window = f"filter(slice(coalesce(get(around, k + {most}), array()), greatest(g, 1), CASE WHEN g = 0 OR g = {gates - 1} THEN 2 ELSE 3 END), y -> y IS NOT NULL)"
    slope = "((s.sxv - s.sx * s.sv / s.n) / (s.sxx - s.sx * s.sx / s.n))"
    fit = f"""CASE WHEN s.l > 0 AND s.r > 0 AND 2 * s.n >= (2 * {n} + 1) * CASE WHEN g = 0 OR g = {gates - 1} THEN 2 ELSE 3 END AND s.sxx - s.sx * s.sx / s.n > 0
        THEN CASE WHEN sqrt(greatest(s.svv - s.sv * s.sv / s.n - {slope} * (s.sxv - s.sx * s.sv / s.n), 0D) / s.n) <= {SHEAR_RESIDUAL_MS!r}D THEN {slope} * 1000 END END"""
    each = f"transform(sequence(0, {gates - 1}), g -> CASE WHEN get(v, g) IS NOT NULL AND {n} > 0 THEN aggregate(sequence(-{n}, {n}), {zero}, (a, k) -> aggregate({window}, a, (b, y) -> {add}), s -> {fit}) END)"
    return rows.select(*keys, "az", F.expr(each).alias("shear"))


def unwrapped_phase(trusted: str) -> str:
    """Phases of trusted gates, in turn raised and lowered by whole turns until they are within 270 degrees of the one before. SQL over an array
    whose other gates are null."""
    turned = "CASE WHEN s.last - x > 270 THEN x + 360D * ceil((s.last - x - 270D) / 360D) WHEN x - s.last > 270 THEN x - 360D * ceil((x - s.last - 270D) / 360D) ELSE x END"
    return f"""aggregate({trusted}, named_struct('last', cast(NULL AS double), 'all', cast(array() AS array<double>)), (s, x) -> CASE WHEN x IS NULL THEN named_struct('last', s.last, 'all', concat(s.all, array(cast(NULL AS double))))
        ELSE named_struct('last', {turned}, 'all', concat(s.all, array({turned}))) END, s -> s.all)"""


def sliding_median(values: str, half: int = 2) -> str:
    """Median of the valid gates around each valid gate, of an even number the upper middle one. SQL over an array column."""
    around = f"array_sort(filter(slice({values}, greatest(g - {half}, 0) + 1, g + {half} + 1 - greatest(g - {half}, 0)), x -> x IS NOT NULL))"
    return f"transform(sequence(0, size({values}) - 1), g -> CASE WHEN get({values}, g) IS NOT NULL THEN get({around}, cast(floor(size({around}) / 2) AS int)) END)"


def specific_phase(rays: DataFrame, keys: list[str], spacing_m: float = 1000.0) -> DataFrame:
    """(keys, az, kdp) from arrays phi, rho and z: half the slope of phase over range in degrees a km, -2 to 10.

    Gates with correlation of 0.9 and 20 dBZ or more are trusted; their phases are unwrapped and smoothed by a median of five gates, and slopes
    fitted over 1 km to either side where it is 40 dBZ or more, else over 3 km: where two thirds of the window are trusted and scatter by at most 6 degrees about the fit. Fits
    read the ends of one array of running sums, whatever their reach; a scatter of just 6 degrees passes, whichever way the sums were rounded.
    """
    heavy, light = (max(2, math.floor(m / spacing_m + 0.5)) for m in KDP_HALF_M)
    km = spacing_m / 1000
    trusted = f"transform(phi, (x, g) -> CASE WHEN get(rho, g) >= {KDP_MIN_RHO!r}D AND get(z, g) >= {KDP_MIN_DBZ!r}D THEN x END)"
    rows = rays.select(*keys, "az", "phi", "rho", "z").filter(F.size("phi") > 0).withColumn("turned", F.expr(unwrapped_phase(trusted))).withColumn("clean", F.expr(sliding_median("turned")))
    # sums up to and without each gate; phases from the first one's, so that sums stay small
    rows = rows.withColumn("base", F.expr("coalesce(get(filter(clean, x -> x IS NOT NULL), 0), 0D)"))
    zero = "named_struct('n', 0D, 'x', 0D, 'p', 0D, 'xx', 0D, 'xp', 0D, 'pp', 0D)"
    last = "element_at(s, -1)"
    add = f"CASE WHEN y.p IS NULL THEN {last} ELSE named_struct('n', {last}.n + 1, 'x', {last}.x + y.g, 'p', {last}.p + y.p, 'xx', {last}.xx + y.g * y.g, 'xp', {last}.xp + y.g * y.p, 'pp', {last}.pp + y.p * y.p) END"
    rows = rows.withColumn("sums", F.expr(f"aggregate(transform(clean, (p, g) -> struct(g AS g, p - base AS p)), array({zero}), (s, y) -> concat(s, array({add})))"))
    of = lambda c: f"(t.b.{c} - t.a.{c})"
    cov, var = f"({of('xp')} - {of('x')} * {of('p')} / {of('n')})", f"({of('xx')} - {of('x')} * {of('x')} / {of('n')})"
    scatter = f"sqrt(greatest({of('pp')} - {of('p')} * {of('p')} / {of('n')} - {cov} * {cov} / {var}, 0D) / {of('n')})"
    fit = f"CASE WHEN 3 * {of('n')} >= 2 * t.size AND {var} > 0 THEN CASE WHEN {scatter} <= {KDP_RESIDUAL_DEG + 1e-9!r}D THEN greatest(least({cov} / {var} / {2 * km!r}D, {KDP_MOST!r}D), {KDP_LEAST!r}D) END END"
    reach = f"CASE WHEN get(z, g) >= {KDP_HEAVY_DBZ!r}D THEN {heavy} ELSE {light} END"
    lo, hi = f"greatest(g - {reach}, 0)", f"least(g + {reach}, size(clean) - 1)"
    ends = f"transform(clean, (p, g) -> CASE WHEN p IS NOT NULL THEN struct({hi} - {lo} + 1 AS size, get(sums, {lo}) AS a, get(sums, {hi} + 1) AS b) END)"
    return rows.select(*keys, "az", F.expr(f"transform({ends}, t -> CASE WHEN t IS NOT NULL THEN {fit} END)").alias("kdp"))


def phase_texture(values: str = "phi", half: int = 2) -> Column:
    """Standard deviation of the phase around each valid gate about its own phase, differences wrapped, where half the window is valid."""
    wrapped = f"transform(filter(slice({values}, greatest(g - {half}, 0) + 1, least(g + {half} + 1, size({values})) - greatest(g - {half}, 0)), x -> x IS NOT NULL), x -> (x - p0 + 180D) - 360D * floor((x - p0 + 180D) / 360D) - 180D)"
    sums = "aggregate(d, named_struct('n', 0D, 's', 0D, 'ss', 0D), (a, x) -> named_struct('n', a.n + 1, 's', a.s + x, 'ss', a.ss + x * x), a -> CASE WHEN 2 * a.n >= size_ THEN sqrt(greatest(a.ss / a.n - a.s / a.n * (a.s / a.n), 0D)) END)"
    size = f"(least(g + {half} + 1, size({values})) - greatest(g - {half}, 0))"
    text = sums.replace("aggregate(d,", f"aggregate({wrapped},").replace("size_", size)
    return F.expr(f"transform({values}, (p0, g) -> CASE WHEN p0 IS NOT NULL THEN {text} END)")


def nearest_rank(values: DataFrame, keys: list[str], value: str, shares: list[float], width: float) -> DataFrame:
    """(keys, share, value, n): the value at place round((n - 1) share) of each group's sorted values, from 0, without sorting them.

    Values are counted in bins of ``width`` first; the one bin that holds a place is known from the counts before it, and only the values of
    such bins are counted one by one. Both counts combine in the tasks that read, so a group of any size costs its bins and the distinct values of a few of them.
    """
    rows = values.select(*keys, F.col(value).alias("x"), F.floor(F.col(value) / width).alias("bin")).filter("x IS NOT NULL")
    bins = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*keys))})
    asked = bins.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("place", F.floor((F.col("total") - 1) * F.col("share") + 0.5))
    asked = asked.filter("upto - n <= place AND place < upto").select(*keys, "bin", "share", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place"), "total")
    few = rows.join(asked.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi").groupBy(*keys, "bin", "x").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*keys, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("upto", F.sum("n").over(within))
    return asked.join(few, [*keys, "bin"]).filter("upto - n <= place AND place < upto").select(*keys, "share", F.col("x").alias("value"), F.col("total").alias("n"))


def bright_band(rays: DataFrame, keys: list[str], first_m: float = 1000.0, spacing_m: float = 1000.0, width_m: float = 100.0) -> DataFrame:
    """(keys, n, quarter_m, three_quarters_m, bottom_m, top_m, found) of each volume with a gate of melting snow, from arrays z, zdr and rho: beams of 3.5 to 10.5
    degrees at 5 to 80 km, correlation 0.90 to 0.97, 30 to 47 dBZ, 0.8 to 2.5 dB.

    Bottom and top are the nearest-rank 10th and 90th percentiles of their heights, null unless there are 300 gates and the middle half spans at most 1000 m.
    """
    between = lambda x, ends: f"{x} BETWEEN {float(ends[0])!r}D AND {float(ends[1])!r}D"
    melting = f"filter(sequence(0, size(rho) - 1), g -> {between(f'({first_m!r}D + g * {spacing_m!r}D)', ML_RANGE_M)} AND {between('get(rho, g)', ML_RHO)} AND {between('get(z, g)', ML_DBZ)} AND {between('get(zdr, g)', ML_ZDR)})"
    rows = rays.filter(F.col("elev").between(*ML_ELEVATIONS) & (F.size("rho") > 0)).select(*keys, "elev", F.explode(F.expr(melting)).alias("g"))
    r = F.lit(first_m) + F.col("g") * spacing_m
    height = F.sqrt(r * r + EARTH_43_M**2 + 2 * EARTH_43_M * r * F.sin(F.radians("elev"))) - EARTH_43_M
    found = nearest_rank(rows.select(*keys, height.alias("h")), keys, "h", [0.1, 0.25, 0.75, 0.9], width_m)
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    whole = found.groupBy(*keys).agg(F.max("n").alias("n"), at(0.25).alias("quarter_m"), at(0.75).alias("three_quarters_m"), at(0.1).alias("low"), at(0.9).alias("high"))
    fits = (F.col("n") >= ML_GATES) & (F.col("three_quarters_m") - F.col("quarter_m") <= ML_DEPTH_IQR_M)
    whole_m = lambda c: F.when(fits, F.floor(F.col(c) + 0.5).cast("bigint"))
    return whole.select(*keys, "n", F.round("quarter_m", 2).alias("quarter_m"), F.round("three_quarters_m", 2).alias("three_quarters_m"), whole_m("low").alias("bottom_m"), whole_m("high").alias("top_m"), fits.alias("found"))

"""Echo regions and storm cells of sweeps as tables: runs along rays, regions of runs, a tree of level sets.

Rays are (keys, az, v): one array of gates a ray, gate spacing in km, missing gates null, azimuth bins from 0 to ``n_az`` - 1. A gate touches
the next and last gate of its ray and the same gate of the next and last ray; azimuth wraps. A ray that isn't there touches nothing.

Only runs leave a ray (its consecutive gates at or above a level), with their sums, so gates are never rows; links between runs of neighbouring
rays come from one window over a sweep's rays; regions are the components of runs, by rounds over tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlake.functions.constants import CELL_LEVELS, CELL_MIN_AREA_KM2
from stormlake.sources.shared import checkpointed

#: Gates that a ray has at most: a run's node is its azimuth bin times this and its first gate.
RAY = 1 << 20


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) for the nodes of edges (keys, a, b): root is the least node of a component.

    Rounds of large-star and small-star: a node's larger neighbours go to its least neighbour, then a node with its smaller neighbours to
    the least of them, until nothing changes. Each round is cut by a checkpoint; the driver sees a count and a sum.
    """
    now = checkpointed(edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        both = now.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select(*keys, "e.u", "e.v")
        least = both.groupBy(*keys, F.col("u").alias("a")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = now.join(least, [*keys, "a"]).select(*keys, F.col("m").alias("a"), "b").distinct()
        low = large.groupBy(*keys, "b").agg(F.min("a").alias("m"))
        small = large.join(low, [*keys, "b"]).select(*keys, "m", F.explode(F.array("a", "b")).alias("v")).filter("m < v").select(*keys, F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        now = checkpointed(small)
        new = now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(*keys, F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(*keys, F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _runs_of(level: float) -> Column:
    """First and last gates of the runs of column v at or above a level."""
    on = lambda i: F.coalesce(F.get("v", i) >= level, F.lit(False))
    gates = F.sequence(F.lit(0), F.size("v") - 1)
    return F.arrays_zip(F.filter(gates, lambda i: on(i) & ~on(i - 1)).alias("lo"), F.filter(gates, lambda i: on(i) & ~on(i + 1)).alias("hi"))


def runs(rays: DataFrame, keys: list[str], levels: tuple[float, ...] = CELL_LEVELS) -> DataFrame:
    """(keys, az, v, runs): for each level an array of (lo, hi)."""
    return rays.select(*keys, "az", "v").filter(F.size("v") > 0).withColumn("runs", F.array(*[_runs_of(x) for x in levels]))


def run_links(found: DataFrame, keys: list[str], n_az: int) -> DataFrame:
    """(keys, level, a, b): nodes of runs of neighbouring rays that share a gate; level is the level's place."""
    order = Window.partitionBy(*keys).orderBy("az")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = found.select(*keys, "az", "runs", F.lead(F.struct("az", "runs")).over(order).alias("after"), F.first(F.struct("az", "runs")).over(whole).alias("start"))
    beside = F.when(F.col("after.az") == F.col("az") + 1, F.col("after")).when((F.col("az") == n_az - 1) & (F.col("start.az") == 0), F.col("start"))
    rows = rows.withColumn("beside", beside).filter("beside IS NOT NULL").select(*keys, "az", F.col("beside.az").alias("az1"), F.posexplode(F.arrays_zip(F.col("runs").alias("x"), F.col("beside.runs").alias("y"))).alias("level", "r"))
    meet = "flatten(transform(r.x, p -> transform(filter(r.y, q -> q.lo <= p.hi AND p.lo <= q.hi), q -> struct(p.lo AS a, q.lo AS b))))"
    rows = rows.select(*keys, "level", "az", "az1", F.explode(F.expr(meet)).alias("e"))
    return rows.select(*keys, "level", (F.col("az") * RAY + F.col("e.a")).alias("a"), (F.col("az1") * RAY + F.col("e.b")).alias("b"))


def regions(rays: DataFrame, keys: list[str], n_az: int, levels: tuple[float, ...] = CELL_LEVELS, first_km: float = 1.0, spacing_km: float = 1.0) -> DataFrame:
    """(keys, level, root, parent, n_gates, area_km2, max_dbz, x_km, y_km) of each connected region at each level.

    level is the level's place in ``levels`` (ascending), root the region's first run, parent the root of the region of the level below that holds it. Areas are
    arc times spacing, places weighted by linear reflectivity.
    """
    found = checkpointed(runs(rays, keys, levels))
    roots = components(run_links(found, keys, n_az), [*keys, "level"])
    step, turn = float(spacing_km), 2 * math.pi / n_az
    at = lambda g: f"({first_km!r}D + {step!r}D * {g})"
    sums = f"""transform(r, p -> struct(p.lo AS lo, p.hi - p.lo + 1 AS n, (p.hi - p.lo + 1) * {at("(p.lo + p.hi) / 2D")} * {turn * step!r}D AS area, array_max(slice(v, p.lo + 1, p.hi - p.lo + 1)) AS top,
        aggregate(slice(v, p.lo + 1, p.hi - p.lo + 1), 0D, (s, x) -> s + power(1e1, x / 1e1)) AS w, aggregate(sequence(p.lo, p.hi), 0D, (s, g) -> s + power(1e1, get(v, g) / 1e1) * {at("g")}) AS ws, array_max(filter(under.lo, x -> x <= p.lo)) AS under))"""
    each = found.select(*keys, "az", "v", F.col("runs").alias("all"), F.posexplode("runs").alias("level", "r")).withColumn("under", F.get("all", F.col("level") - 1))
    each = each.select(*keys, "level", "az", F.explode(F.expr(sums)).alias("s")).select(*keys, "level", "az", "s.*").withColumns({"node": F.col("az") * RAY + F.col("lo"), "angle": (F.col("az") + 0.5) * turn})
    named = each.join(roots, [*keys, "level", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    weight = F.sum("w")
    whole = checkpointed(named.groupBy(*keys, "level", "root").agg(
        F.sum("n").cast("bigint").alias("n_gates"), F.sum("area").alias("area_km2"), F.max("top").alias("max_dbz"), (F.sum(F.col("ws") * F.sin("angle")) / weight).alias("x_km"), (F.sum(F.col("ws") * F.cos("angle")) / weight).alias("y_km"),
        F.min(F.when(F.col("under").isNotNull(), F.col("az") * RAY + F.col("under"))).alias("held"),
    ))
    up = roots.select(*keys, (F.col("level") + 1).alias("level"), F.col("node").alias("held"), F.col("root").alias("parent"))
    return whole.join(up, [*keys, "level", "held"], "left").withColumn("parent", F.coalesce("parent", "held")).select(*keys, "level", "root", "parent", "n_gates", "area_km2", "max_dbz", "x_km", "y_km")


def cells(found: DataFrame, keys: list[str], n_levels: int = len(CELL_LEVELS), least_km2: float = CELL_MIN_AREA_KM2) -> DataFrame:
    """The storm cells among regions: a region of the least area is split into its cores, the regions of the next level within it of the least area, while
    there are two or more; what isn't split is a cell. rank orders a sweep's cells, strongest first, then largest, then by root."""
    large = checkpointed(found.filter(F.col("area_km2") >= least_km2))
    cores = large.filter("parent IS NOT NULL").groupBy(*keys, (F.col("level") - 1).alias("level"), F.col("parent").alias("root")).agg(F.count("*").alias("cores"))
    held = large.join(cores, [*keys, "level", "root"], "left").withColumn("split", F.coalesce(F.col("cores") >= 2, F.lit(False)))
    live, out = held.filter("level = 0"), None
    for level in range(n_levels):
        whole = live.filter("NOT split").drop("cores", "split")
        out = whole if out is None else out.unionByName(whole)
        if level + 1 < n_levels:
            live = held.filter(F.col("level") == level + 1).join(live.filter("split").select(*keys, F.col("root").alias("parent")), [*keys, "parent"], "left_semi")
    rounded = out.withColumns({"area_km2": F.round("area_km2", 1), "max_dbz": F.round("max_dbz", 1), "x_km": F.round("x_km", 2), "y_km": F.round("y_km", 2)})
    order = Window.partitionBy(*keys).orderBy(F.desc("max_dbz"), F.desc("area_km2"), "level", "root")
    return rounded.withColumn("rank", F.row_number().over(order).cast("bigint")).select(*keys, "rank", "level", "root", "n_gates", "area_km2", "max_dbz", "x_km", "y_km")

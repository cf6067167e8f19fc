"""Lines of a map: the graph of segments cut into chains between junctions, and chains simplified, in rounds over tables.

A junction is a vertex with any number of segments but two. A ring without one is cut at its least vertex. Chains are ranked by pointer doubling, so a chain of
n segments takes log2(n) rounds; Douglas-Peucker splits all intervals of all chains at once, a round for each depth. Nothing passes through the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlake.sources.shared import checkpointed, stored


def _ranked(directed: DataFrame, junctions: DataFrame) -> DataFrame:
    """(u, v, eu, ev, steps, done, least) of directed segments: the last segment of each one's chain, how many segments lie before it, whether it was reached, and the least
    vertex on the way. What isn't done are rings, whose least vertex then is known."""
    ends = junctions.select(F.col("vertex").alias("v"), F.lit(True).alias("ends"))
    edges = checkpointed(directed.join(ends, "v", "left").select("u", "v", F.coalesce("ends", F.lit(False)).alias("last")))
    after = edges.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("last").alias("next_last"))
    on = edges.filter("NOT last").join(after, "v").filter("w <> u")
    now = on.select("u", "v", F.col("v").alias("eu"), F.col("w").alias("ev"), F.lit(1).cast("long").alias("steps"), F.col("next_last").alias("done"), F.least("v", "w").alias("least"))
    now = checkpointed(now.unionByName(edges.filter("last").select("u", "v", F.col("u").alias("eu"), F.col("v").alias("ev"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("done"), F.col("v").alias("least"))))
    mark = None
    while True:
        open_, total = now.agg(F.count_if(~F.col("done")), F.sum(F.when(~F.col("done"), F.xxhash64("u", "v", "least").cast("decimal(38,0)")))).first()
        if not open_ or (open_, total) == mark:
            return now
        mark = (open_, total)
        there = now.select(F.col("u").alias("eu"), F.col("v").alias("ev"), F.col("eu").alias("fu"), F.col("ev").alias("fv"), F.col("steps").alias("more"), F.col("done").alias("there"), F.col("least").alias("low"))
        moved = now.filter("NOT done").join(there, ["eu", "ev"]).select("u", "v", F.col("fu").alias("eu"), F.col("fv").alias("ev"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"), F.least("least", "low").alias("least"))
        now = checkpointed(now.filter("done").unionByName(moved))


def chains(segments: DataFrame) -> DataFrame:
    """(first, second, pos, vertex): the vertices of each chain of undirected segments (a, b), in order from pos 0 on. A chain is named by its first
    two vertices; of its two directions it has that in which this name is the lesser one. A chain that begins and ends at one vertex has it twice."""
    once = checkpointed(segments.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    directed = once.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(once.select(F.col("b").alias("u"), F.col("a").alias("v")))
    junctions = directed.groupBy(F.col("u").alias("vertex")).agg(F.count("*").alias("n")).filter("n <> 2").select("vertex")
    ranked = _ranked(directed, junctions)
    rings = ranked.filter("NOT done")
    if rings.limit(1).count():
        again = _ranked(rings.select("u", "v"), rings.select(F.col("least").alias("vertex")).distinct())
        ranked = ranked.filter("done").unionByName(again)
    # a segment's chain ends with (eu, ev); seen the other way it begins with (ev, eu), and ends where this one begins
    back = ranked.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("eu").alias("bu"), F.col("ev").alias("bv"))
    chosen = ranked.join(back, ["u", "v"]).filter(F.struct("ev", "eu") < F.struct("bv", "bu"))
    # the chosen direction runs backwards from its name, so places count from the end
    rows = chosen.select(F.col("ev").alias("first"), F.col("eu").alias("second"), (F.col("steps") + 1).alias("pos"), F.col("u").alias("vertex"))
    return rows.unionByName(rows.select("first", "second").distinct().select("first", "second", F.lit(0).cast("long").alias("pos"), F.col("first").alias("vertex")))


def away(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the line through two others, from the one if they are the same place."""
    length = F.hypot(bx - ax, by - ay)
    return F.when(length == 0, F.hypot(x - ax, y - ay)).otherwise(F.abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / length)


def simplified(points: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The points (keys, pos, x, y) that stay by Douglas and Peucker: both ends of each line, and of each interval the farthest point from its chord if it is farther than the tolerance or the
    interval's ends are one place; of equally far points the first."""
    c = F.col
    place = F.struct("pos", "x", "y")
    ends = checkpointed(points.groupBy(*keys).agg(F.min(place).alias("a"), F.max(place).alias("b")))
    kept = ends.select(*keys, F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select(*keys, "p.*")
    inside = checkpointed(points.join(ends, keys).filter("pos > a.pos AND pos < b.pos"))
    while inside.limit(1).count():
        d = away(c("x"), c("y"), c("a.x"), c("a.y"), c("b.x"), c("b.y"))
        far = inside.groupBy(*keys, c("a.pos").alias("lo")).agg(F.max(F.struct(d.alias("d"), (-c("pos")).alias("back"), "x", "y", F.struct("a", "b").alias("ends"))).alias("m"))
        same = (c("m.ends.a.x") == c("m.ends.b.x")) & (c("m.ends.a.y") == c("m.ends.b.y"))
        split = stored(far.filter((c("m.d") > tolerance) | same).select(*keys, "lo", F.struct((-c("m.back")).alias("pos"), c("m.x").alias("x"), c("m.y").alias("y")).alias("s")))
        kept = kept.unionByName(split.select(*keys, "s.*"))
        rows = inside.withColumn("lo", c("a.pos")).join(split, [*keys, "lo"]).filter("pos <> s.pos")
        inside = stored(rows.select(*keys, "pos", "x", "y", F.when(c("pos") > c("s.pos"), c("s")).otherwise(c("a")).alias("a"), F.when(c("pos") < c("s.pos"), c("s")).otherwise(c("b")).alias("b")))
    return kept


def simplified_lines(vertices: DataFrame, segments: DataFrame, tolerance: float) -> DataFrame:
    """(a, b): segments of the simplified map, from (vertex, x, y) and (a, b). Borders that areas share stay one line, and junctions stay."""
    keys = ["first", "second"]
    points = chains(segments).join(vertices, "vertex").select(*keys, "pos", "x", "y", "vertex")
    kept = simplified(points.drop("vertex"), keys, tolerance).join(points.select(*keys, "pos", "vertex"), [*keys, "pos"])
    after = F.lead("vertex").over(Window.partitionBy(*keys).orderBy("pos"))
    return kept.select(F.col("vertex").alias("u"), after.alias("v")).filter("v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

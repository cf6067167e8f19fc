"""Radar tables bound to the driver's tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake.functions.constants import EARTH_43_M

Binding = tuple[Callable[[SparkSession, str], DataFrame], str]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _micros(name: str) -> F.Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def radials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of 10 tilts and 50 rays, 64 gates 1 km apart; dBZ from the vectors, the weakest missing."""
    gate = lambda x: F.when(x >= -0.18, F.round(30 + 150 * x.cast("double"), 1))
    tilt = F.floor((F.col("vec_id") % 500) / 50).cast("bigint")
    return _read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 500).cast("bigint").alias("vol"), tilt.alias("tilt"), (0.5 + 1.2 * tilt).alias("elev"), (F.col("vec_id") % 50).alias("az"), F.transform("embedding", gate).alias("v"))


RADIALS = """SELECT vec_id // 500 AS vol, (vec_id % 500) // 50 AS tilt, 0.5e0 + 1.2e0 * ((vec_id % 500) // 50) AS elev, vec_id % 50 AS az,
    list_transform(embedding, lambda x: CASE WHEN cast(x AS double) >= -0.18e0 THEN round(30e0 + 150e0 * cast(x AS double), 1) END) AS v FROM embeddings"""


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("bin"))


BINS = "SELECT cast(unnest(range(0, 64)) AS int) AS bin"


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("site"), _micros("ts").alias("ts_us"), "event_id", F.round(F.col("value") * 100).cast("bigint").alias("size"))


SCANS = "SELECT event_type AS site, epoch_us(ts) AS ts_us, event_id, cast(round(value * 100) AS bigint) AS size FROM events"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("req_id"), F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "error")]), (F.col("o_custkey") % 3 + 1).cast("int")).alias("site"), (F.lit(1_704_067_200_000_000) + (F.col("o_orderkey") * 7_919_000_003) % 2_600_000_000_000).alias("at_us"))


REQUESTS = "SELECT o_orderkey AS req_id, ['click', 'view', 'error'][cast(o_custkey % 3 + 1 AS int)] AS site, 1704067200000000 + (o_orderkey * 7919000003) % 2600000000000 AS at_us FROM orders"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(k.alias("site"), (25 + ((7 * k) % 240) / 10.0).alias("lat"), (-120 + ((13 * k) % 500) / 10.0).alias("lon"))


SITES = "SELECT s_suppkey AS site, 25e0 + ((7 * s_suppkey) % 240) / 1e1 AS lat, -120e0 + ((13 * s_suppkey) % 500) / 1e1 AS lon FROM supplier"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(k.alias("point_id"), (25 + ((37 * k) % 2411) / 100.0).alias("lat"), (-120 + ((53 * k) % 5003) / 100.0).alias("lon"))


POINTS = "SELECT c_custkey AS point_id, 25e0 + ((37 * c_custkey) % 2411) / 1e2 AS lat, -120e0 + ((53 * c_custkey) % 5003) / 1e2 AS lon FROM customer"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("kind"), _micros("l_shipdate").alias("begin_us"), (_micros("l_shipdate") + (F.col("l_partkey") % 10) * F.lit(86_400_000_000)).alias("end_us"))


INTERVALS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS kind, epoch_us(l_shipdate) AS begin_us, epoch_us(l_shipdate) + (l_partkey % 10) * 86400000000 AS end_us FROM lineitem"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(24).select((F.lit(725_846_400_000_000) + F.col("id") * F.lit(8_640_000_000_000)).alias("at_us"))


TICKS = "SELECT 725846400000000 + unnest(range(0, 24)) * 8640000000000 AS at_us"


#: Corners of a ring around its place, in units that vary from corner to corner.
_CORNERS = ((10, 0), (4, 8), (-6, 9), (-9, -1), (-3, -9), (7, -6), (2, -1))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ring of seven corners around each nation's place, none of them convex."""
    k = F.col("n_nationkey")
    place = (-118 + (k * 7 % 45), 26 + (k * 5 % 20))

    def at(axis: int, c: F.Column) -> F.Column:
        out = F.element_at(F.array(*[F.lit(x[axis]) for x in _CORNERS]), (c % 7 + 1).cast("int"))
        return place[axis].cast("double") + out * ((k * 3 + (c % 7) * 2) % 5 + 8) / F.lit(40.0)

    c = F.col("c")
    return _read(spark, sf_dir, "nation").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(6)))).select(k.cast("bigint").alias("ring_id"), at(0, c).alias("x0"), at(1, c).alias("y0"), at(0, c + 1).alias("x1"), at(1, c + 1).alias("y1"))


def _corner(axis: int, c: str) -> str:
    return f"{['lon', 'lat'][axis]}::double + {[x[axis] for x in _CORNERS]}[cast({c} % 7 + 1 AS int)] * ((k * 3 + ({c} % 7) * 2) % 5 + 8) / 4e1"


EDGES = f"""SELECT cast(k AS bigint) AS ring_id, {_corner(0, "c")} AS x0, {_corner(1, "c")} AS y0, {_corner(0, "(c + 1)")} AS x1, {_corner(1, "(c + 1)")} AS y1
    FROM (SELECT n_nationkey AS k, -118 + (n_nationkey * 7 % 45) AS lon, 26 + (n_nationkey * 5 % 20) AS lat, unnest(range(0, 7)) AS c FROM nation)"""


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), _micros("ts").alias("ts_us"), "event_id", F.col("value").alias("x"), (F.col("user_id") + F.col("value") / 7).alias("y"))


TRACK_POINTS = "SELECT user_id AS track, epoch_us(ts) AS ts_us, event_id, value AS x, user_id + value / 7 AS y FROM events"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(k.alias("point_id"), ((k * 37) % 3600 / 10.0).alias("az"), (0.2 + (k * 29) % 700 / 10.0).alias("range_km"))


SAMPLES = "SELECT s_suppkey AS point_id, (s_suppkey * 37) % 3600 / 1e1 AS az, 0.2e0 + (s_suppkey * 29) % 700 / 1e1 AS range_km FROM supplier"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six variables of a gate from an order line."""
    p, q = F.col("l_partkey"), F.col("l_orderkey")
    return _read(spark, sf_dir, "lineitem").select(
        (q * 10 + F.col("l_linenumber")).alias("gate_id"), ((p * 13) % 750 / 10.0).alias("z"), F.when(p % 17 > 0, (q * 7) % 80 / 10.0 - 3).alias("zdr"), F.when(q % 19 > 0, 0.7 + (p * 11) % 310 / 1000.0).alias("rho"),
        ((q * 3) % 300 / 10.0 - 20).alias("lkdp"), ((p + q) % 80 / 10.0).alias("sdz"), ((p * q) % 500 / 10.0).alias("sdphi"), F.element_at(F.array(*[F.lit(x) for x in ("below", "within", "above")]), (q % 3 + 1).cast("int")).alias("layer"), (0.5 + (p % 5) * 0.5).alias("elev"),
    )


GATES = """SELECT l_orderkey * 10 + l_linenumber AS gate_id, (l_partkey * 13) % 750 / 1e1 AS z, CASE WHEN l_partkey % 17 > 0 THEN (l_orderkey * 7) % 80 / 1e1 - 3e0 END AS zdr, CASE WHEN l_orderkey % 19 > 0 THEN 0.7e0 + (l_partkey * 11) % 310 / 1e3 END AS rho,
    (l_orderkey * 3) % 300 / 1e1 - 20e0 AS lkdp, (l_partkey + l_orderkey) % 80 / 1e1 AS sdz, (l_partkey * l_orderkey) % 500 / 1e1 AS sdphi, ['below', 'within', 'above'][cast(l_orderkey % 3 + 1 AS int)] AS layer, 0.5e0 + (l_partkey % 5) * 0.5e0 AS elev FROM lineitem"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive keys, one in seven of another kind of file."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss")
    site = F.concat(F.lit("K"), F.upper(F.substring("event_type", 1, 3)))
    tail = F.when(F.col("event_id") % 7 == 0, F.lit("_MDM")).otherwise("_V06")
    return _read(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy/MM/dd/"), site, F.lit("/"), site, stamp, tail).alias("key"), "props")


KEYS = """SELECT event_id, strftime(ts, '%Y/%m/%d/') || 'K' || upper(substr(event_type, 1, 3)) || '/K' || upper(substr(event_type, 1, 3)) || strftime(ts, '%Y%m%d_%H%M%S') || CASE WHEN event_id % 7 = 0 THEN '_MDM' ELSE '_V06' END AS key, props FROM events"""



def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), _micros("ts").alias("begin_us"), (_micros("ts") + 3_600_000_000).alias("end_us"))


ISSUES = "SELECT event_id AS id, event_type AS kind, epoch_us(ts) AS begin_us, epoch_us(ts) + 3600000000 AS end_us FROM events"


def outlooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a convective day's cycles, one of three without areas."""
    cycle = F.element_at(F.array(*[F.lit(x) for x in (6, 13, 16, 20, 1)]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = _read(spark, sf_dir, "events").select(F.floor(_micros("ts") / 86_400_000_000).cast("bigint").alias("day"), cycle.alias("cycle")).distinct()
    return rows.withColumn("n_areas", (F.col("day") * 7 + F.col("cycle")) % 3)


OUTLOOKS = "SELECT DISTINCT day, cycle, (day * 7 + cycle) % 3 AS n_areas FROM (SELECT epoch_us(ts) // 86400000000 AS day, [6, 13, 16, 20, 1][cast(event_id % 5 + 1 AS int)] AS cycle FROM events) q"


def shears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of a shear, one for each of radials."""
    return radials(spark, sf_dir).select("vol", "tilt", "elev", "az", F.transform(F.reverse("v"), lambda x: (x - 10) / 2).alias("v"))


SHEARS = f"SELECT vol, tilt, elev, az, list_transform(list_reverse(v), lambda x: (x - 10) / 2) AS v FROM ({RADIALS}) q"


def storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion of two volumes of three."""
    vols = radials(spark, sf_dir).select("vol").distinct().filter("vol % 3 < 2")
    return vols.select("vol", (10 + F.col("vol").cast("double")).alias("u"), (6 - F.col("vol") / 2).alias("v"))


STORMS = f"SELECT DISTINCT vol, 1e1 + vol AS u, 6e0 - vol / 2e0 AS v FROM ({RADIALS}) q WHERE vol % 3 < 2"


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of five moments, each from a vector read in another order: a phase that grows and wraps, a layer of low correlation around 2750 m, gates that are
    missing alike in reflectivity and phase."""
    at = F.col("vec_id")
    tilt = F.floor((at % 500) / 50).cast("bigint")
    rows = _read(spark, sf_dir, "embeddings").select(F.floor(at / 500).cast("bigint").alias("vol"), tilt.alias("tilt"), (0.5 + 1.2 * tilt).alias("elev"), (at % 50).alias("az"), F.col("embedding").cast("array<double>").alias("x"))
    height = f"sqrt(power(1e3 * (i + 1), 2) + power({EARTH_43_M!r}D, 2) + 2 * {EARTH_43_M!r}D * 1e3 * (i + 1) * sin(radians(elev))) - {EARTH_43_M!r}D"
    each = lambda text: F.expr(f"transform(x, (x0, i) -> {text})")
    y, w = "get(x, 63 - i)", "get(x, (i + 32) % 64)"
    return rows.select(
        "vol", "tilt", "elev", "az", each("CASE WHEN x0 >= -18e-2 THEN round(4e1 + 15e1 * x0, 1) END").alias("z"), each(f"CASE WHEN x0 >= -18e-2 THEN round(4e1 * {y}, 1) END").alias("vel"), each(f"round(16e-1 + 6e0 * {w}, 1)").alias("zdr"),
        each(f"CASE WHEN {y} >= -3e-1 THEN round(CASE WHEN abs({height} - 275e1) <= 5e2 THEN 935e-3 + 16e-2 * {y} ELSE 985e-3 + 5e-2 * {y} END, 3) END").alias("rho"),
        each(f"CASE WHEN x0 >= -18e-2 THEN round((25e1 + 5e0 * i + 6e1 * {y}) - 36e1 * floor((25e1 + 5e0 * i + 6e1 * {y}) / 36e1), 1) END").alias("phi"),
    )


_MOMENT_HEIGHT = f"sqrt(power(1e3 * (i + 1), 2) + power({EARTH_43_M!r}e0, 2) + 2 * {EARTH_43_M!r}e0 * 1e3 * (i + 1) * sin(radians(elev))) - {EARTH_43_M!r}e0"
#: One row a gate.
MOMENTS = f"""SELECT vol, tilt, elev, az, i AS bin, CASE WHEN x >= -18e-2 THEN round(4e1 + 15e1 * x, 1) END AS z, CASE WHEN x >= -18e-2 THEN round(4e1 * y, 1) END AS vel, round(16e-1 + 6e0 * w, 1) AS zdr,
    CASE WHEN y >= -3e-1 THEN round(CASE WHEN abs({_MOMENT_HEIGHT} - 275e1) <= 5e2 THEN 935e-3 + 16e-2 * y ELSE 985e-3 + 5e-2 * y END, 3) END AS rho,
    CASE WHEN x >= -18e-2 THEN round((25e1 + 5e0 * i + 6e1 * y) - 36e1 * floor((25e1 + 5e0 * i + 6e1 * y) / 36e1), 1) END AS phi
    FROM (SELECT vec_id // 500 AS vol, (vec_id % 500) // 50 AS tilt, 0.5e0 + 1.2e0 * ((vec_id % 500) // 50) AS elev, vec_id % 50 AS az, i, cast(embedding[i + 1] AS double) AS x, cast(embedding[64 - i] AS double) AS y, cast(embedding[(i + 32) % 64 + 1] AS double) AS w
        FROM embeddings, (SELECT unnest(range(64)) AS i) g) q"""


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes by the loop that they are frames of."""
    return radials(spark, sf_dir).select("vol").distinct().withColumn("loop", F.floor(F.col("vol") / 3))


LOOPS = f"SELECT DISTINCT vol, vol // 3 AS loop FROM ({RADIALS}) q"


def wind_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities of a uniform wind with each vector as its noise, more of it on higher tilts, and as folded at 10 m/s; two tilts of ten lack three sectors."""
    at = F.col("vec_id")
    tilt = F.floor((at % 500) / 50).cast("bigint")
    rows = _read(spark, sf_dir, "embeddings").select(F.floor(at / 500).cast("bigint").alias("vol"), tilt.alias("tilt"), (0.5 + 2.4 * tilt).alias("elev"), (at % 50).alias("az"), "embedding")
    gate = "CASE WHEN x >= -18e-2 AND NOT (tilt % 5 = 4 AND az < 19) THEN round(12e0 * sin(radians(az * 72e-1 + 36e-1)) - 7e0 * cos(radians(az * 72e-1 + 36e-1)) + (8e0 + 4e0 * tilt) * cast(x AS double), 2) END"
    return rows.withColumn("v", F.expr(f"transform(embedding, x -> {gate})")).select("vol", "tilt", "elev", "az", "v", F.expr("transform(v, x -> x - 2e1 * floor((x + 1e1) / 2e1))").alias("raw"))


#: One row a gate.
WIND_RAYS = """SELECT *, x - 2e1 * floor((x + 1e1) / 2e1) AS raw FROM (SELECT vol, tilt, elev, az, i AS bin, CASE WHEN x >= -18e-2 AND NOT (tilt % 5 = 4 AND az < 19) THEN round(12e0 * sin(radians(az * 72e-1 + 36e-1)) - 7e0 * cos(radians(az * 72e-1 + 36e-1)) + (8e0 + 4e0 * tilt) * cast(x AS double), 2) END AS x
    FROM (SELECT vec_id // 500 AS vol, (vec_id % 500) // 50 AS tilt, 0.5e0 + 2.4e0 * ((vec_id % 500) // 50) AS elev, vec_id % 50 AS az, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings) g) q"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays as radials has, in volumes of 8 tilts and 15 rays, so that a small table holds some."""
    at, gate = F.col("vec_id"), lambda x: F.when(x >= -0.18, F.round(30 + 150 * x.cast("double"), 1))
    return _read(spark, sf_dir, "embeddings").select(F.floor(at / 120).cast("bigint").alias("vol"), F.floor((at % 120) / 15).cast("bigint").alias("tilt"), (at % 15).alias("az"), F.transform("embedding", gate).alias("v"))


FRAMES = "SELECT vec_id // 120 AS vol, (vec_id % 120) // 15 AS tilt, vec_id % 15 AS az, list_transform(embedding, lambda x: CASE WHEN cast(x AS double) >= -0.18e0 THEN round(30e0 + 150e0 * cast(x AS double), 1) END) AS v FROM embeddings"


def frame_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of the volumes of frames, those of odd volumes a little higher and farther out, every third without a Nyquist velocity; the fourth tilt of every
    fourth volume lies too high for a partner."""
    odd, tilt, high = F.col("vol") % 2, F.col("tilt"), F.when((F.col("vol") % 4 == 2) & (F.col("tilt") == 3), 0.5).otherwise(0.0)
    rows = frames(spark, sf_dir).select("vol", "tilt").distinct()
    return rows.select("vol", "tilt", F.round(0.5 + 1.2 * tilt + 0.05 * odd + high, 2).alias("elev"), F.lit(15).alias("n_az"), F.when(tilt % 3 > 0, 15.0 + tilt).alias("nyquist"), (1000.0 + 2400.0 * odd).alias("first_m"), F.lit(1000.0).alias("spacing_m"))


FRAME_SWEEPS = f"SELECT DISTINCT vol, tilt, round(0.5e0 + 1.2e0 * tilt + 0.05e0 * (vol % 2) + CASE WHEN vol % 4 = 2 AND tilt = 3 THEN 0.5e0 ELSE 0e0 END, 2) AS elev, 15 AS n_az, CASE WHEN tilt % 3 > 0 THEN 15e0 + tilt END AS nyquist, 1e3 + 24e2 * (vol % 2) AS first_m, 1e3 AS spacing_m FROM ({FRAMES}) q"


def frame_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("vol").distinct().withColumn("loop", F.floor(F.col("vol") / 3))


FRAME_LOOPS = f"SELECT DISTINCT vol, vol // 3 AS loop FROM ({FRAMES}) q"


BINDINGS: dict[str, Binding] = {
    "radials": (radials, RADIALS), "bins": (bins, BINS), "scans": (scans, SCANS), "requests": (requests, REQUESTS), "sites": (sites, SITES), "points": (points, POINTS),
    "intervals": (intervals, INTERVALS), "ticks": (ticks, TICKS), "edges": (edges, EDGES), "track_points": (track_points, TRACK_POINTS), "samples": (samples, SAMPLES), "gates": (gates, GATES), "keys": (keys, KEYS), "issues": (issues, ISSUES), "outlooks": (outlooks, OUTLOOKS), "shears": (shears, SHEARS), "storms": (storms, STORMS), "moments": (moments, MOMENTS), "loops": (loops, LOOPS), "wind_rays": (wind_rays, WIND_RAYS), "frames": (frames, FRAMES), "frame_sweeps": (frame_sweeps, FRAME_SWEEPS), "frame_loops": (frame_loops, FRAME_LOOPS),
}

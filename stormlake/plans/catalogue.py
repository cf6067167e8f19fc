"""Registry of the queries over radar operators and of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake.functions import constants as C
from stormlake.functions import geometry, times
from stormlake.operators import columns, hydrometeors, places, scans, sections, texts, views
from stormlake.operators.sql import oracle, run
from stormlake.operators.tilts import select_tilts
from stormlake.plans import sweeps
from stormlake.plans.bindings import BINDINGS
from stormlake.plans.twins import _SEQUENCED, TWINS
from stormlake.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_DAY0 = 1_704_067_200_000_000
_DAY = 86_400_000_000


def _portable(name: str, text: str, **renamed: str) -> None:
    """Register a text over bound tables, with its twin if it has one, else with itself; renamed: a field's binding of another
    name."""
    fields = {f: renamed.get(f, f) for f in dict.fromkeys(re.findall(r"\{(\w+)\}", text))}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(text, **{f: BINDINGS[b][0](spark, sf_dir) for f, b in fields.items()})

    QUERIES[name] = query
    twin = TWINS.get(name, text)
    fields |= {f: renamed.get(f, f) for f in dict.fromkeys(re.findall(r"\{(\w+)\}", twin))}
    ORACLES[name] = oracle(twin, **{f: BINDINGS[b][1] for f, b in fields.items()})


def _frame(name: str, twin: str) -> Callable:
    """Register a DataFrame function with its SQL twin, in which ``{name}`` fields are bound tables."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        ORACLES[name] = oracle(twin, **{f: BINDINGS[f][1] for f in dict.fromkeys(re.findall(r"\{(\w+)\}", twin))})
        return function

    return add


#: Rows of scans and sites that a task works out partners of, about; and tasks at most.
_ROWS_A_TASK, _TASKS = 250_000, 10_000


def _partners(spark: SparkSession, sf_dir: str, *also: str) -> tuple[DataFrame, list[str]]:
    """Partners of the scans, and the columns that tell a scan: event_id alone if that repeats, else with those of ``also``. Ids and sites are counted first."""
    rows = BINDINGS["scans"][0](spark, sf_dir)
    n, most = rows.groupBy("event_id").count().agg(F.sum("count"), F.max("count")).head()
    repeated = (most or 0) > 1
    parts = min(_TASKS, max(spark.sparkContext.defaultParallelism, (n or 0) * rows.select("site").distinct().count() // _ROWS_A_TASK))
    return run(scans.mosaic_partners(repeated=repeated, parts=parts, also=also), scans=rows), ["event_id"] if repeated else [*also, "event_id"]


_portable("column_products", columns.column_products())
_portable("low_level_rotation", columns.low_level_rotation())
_portable("rotation_tracks", columns.rotation_tracks())
_portable("sweep_statistics", columns.sweep_statistics())
_portable("point_samples", columns.point_samples())
_portable("storm_relative", columns.storm_relative())
_portable("vad_ring_fits", columns.ring_fits())
_portable("vad_refined_fits", columns.refined_fits(10.0), radials="wind_rays")
_portable("fold_check", sections.fold_check(), radials="frames", sweeps="frame_sweeps", loops="frame_loops")
_portable("wind_profile", columns.wind_profile())
_portable("storm_motions", columns.storm_motions())
_portable("wind_levels", columns.wind_levels())
_portable("range_windows", columns.ring_windows())
_portable("hydrometeor_classes", hydrometeors.classify())
QUERIES["hydrometeor_classes"] = lambda spark, sf_dir: hydrometeors.classify_gates(BINDINGS["gates"][0](spark, sf_dir))
_portable("scan_sequences", scans.sequences())
_portable("newest_per_site", scans.newest_per_site())
_portable("scan_at_or_before", scans.scan_at())
_portable("scans_between", scans.scans_between(_DAY0 + 5 * _DAY, _DAY0 + 9 * _DAY))
_portable("prior_scans", scans.prior_scans())
_portable("mosaic_partners", scans.mosaic_partners())
QUERIES["mosaic_partners"] = lambda spark, sf_dir: _partners(spark, sf_dir)[0]
_portable("storm_motion_near", scans.storm_motion_near())
_portable("quota_prune", scans.quota_prune(3_000_000, _DAY0 + 5 * _DAY, _DAY0 + 6 * _DAY))
_portable("eviction_order", scans.eviction_order(_DAY0 + 20 * _DAY, _DAY0 + 25 * _DAY, 1_000_000))
_portable("next_frames", scans.next_frames())
_portable("hourly_counts", scans.hourly_counts())
_portable("new_keys", scans.new_keys())
_portable("site_shares", scans.sizes_summary())
_portable("cell_motion", scans.cell_motion(), points="track_points")
_portable("site_neighbours", places.neighbours())
_portable("nearest_sites", places.nearest_sites())
_portable("neighbour_offsets", places.offsets())
_portable("nearest_radar", places.nearest_radar())
_portable("warnings_active", places.active_at())
_portable("warnings_sweep", places.active_sweep())
_portable("outlook_in_effect", places.in_effect())
_portable("issue_at_or_before", places.latest_issue(), intervals="issues")
_portable("points_in_polygons", places.in_polygon())

_portable("cross_section", sections.cross_section())
_portable("tilt_resample", sections.tilt_resample())
_portable("phase_unwrap", sections.phase_unwrap())
_portable("mosaic_cells", sections.neighbour_cells())
_portable("hodograph_layers", sections.hodograph_layers(columns.wind_profile()))
_portable("freezing_level", sections.freezing_level())
_portable("nearest_tilt", sections.nearest_tilt())

@_frame("key_times", "SELECT event_id, substr(key, 17, 4) AS site, epoch_us(strptime(substr(key, 21, 15), '%Y%m%d_%H%M%S')) AS ts_us, substr(key, 17) AS base, substr(key, 17, 4) || '_' || substr(key, 21, 15) AS name FROM {keys} WHERE key NOT LIKE '%\\_MDM' ESCAPE '\\'")
def key_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = BINDINGS["keys"][0](spark, sf_dir).filter(~F.col("key").endswith("_MDM"))
    site, at = times.key_site(F.col("key")), times.key_time(F.col("key"))
    return keys.select("event_id", site.alias("site"), F.unix_micros(at).alias("ts_us"), times.base_name(F.col("key")).alias("base"), times.volume_name(site, at).alias("name"))


@_frame("catalogue_json", """SELECT event_id, '{"event_id":' || event_id || ',"k":' || json_extract(props, '$.k') || ',"complete":' || (cast(json_extract(props, '$.k') AS bigint) % 2 = 0) || CASE WHEN event_id % 3 = 0 THEN ',"provisional":true' ELSE '' END || '}' AS json FROM {keys}""")
def catalogue_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's row in from JSON and out as JSON, in which a flag that isn't set is left out."""
    rows = BINDINGS["keys"][0](spark, sf_dir).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    made = F.to_json(F.struct("event_id", "k", (F.col("k") % 2 == 0).alias("complete"), F.when(F.col("event_id") % 3 == 0, True).alias("provisional")))
    return rows.select("event_id", made.alias("json"))


@_frame("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN 'Z' ELSE '.' || lpad(cast(epoch_us(ts) % 1000000 AS varchar), 6, '0') || 'Z' END AS iso, cast(epoch_us(ts) // 86400000000 + 1 AS bigint) AS julian_day FROM (SELECT event_id, ts FROM events)")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    return events.select("event_id", times.iso(at).alias("iso"), (F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) + 1).cast("bigint").alias("julian_day"))


@_frame("window_files", """WITH e AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 * 1000000 AS s, epoch_us(ts) + event_id % 37 * 3600000000 AS now_us FROM events),
    w AS (SELECT *, CASE event_id % 5 WHEN 0 THEN us // 86400000000 * 86400000000 WHEN 1 THEN us // 60000000 * 60000000 WHEN 2 THEN s WHEN 3 THEN us END AS a, s + (event_id % 11 - 1) * 3600000000 AS b FROM e)
    SELECT event_id, cast(CASE WHEN event_id % 4 = 1 THEN now_us - b + a ELSE a END AS bigint) AS from_us, cast(CASE WHEN event_id % 4 <> 1 THEN b END AS bigint) AS to_us FROM w WHERE event_id % 12 <> 3 AND a <= b AND now_us - s <= 86400000000""")
def window_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window files written in every form that is read, some of them invalid or stale, at an instant up to 36 hours later."""
    at, k = F.col("ts").cast("timestamp"), F.col("event_id")
    us = F.unix_micros(at)
    said = lambda us, pattern: F.date_format(F.timestamp_micros(us), pattern)
    second = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    start = F.when(k % 5 == 0, said(us, "yyyy-MM-dd")).when(k % 5 == 1, said(us, "yyyy-MM-dd HH:mm")).when(k % 5 == 2, said(us, second)).when(k % 5 == 3, said(us + 7_200_000_000, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")).otherwise(F.lit("2024-02-30"))
    live = F.when(k % 12 == 3, F.lit(', "live": "yes"')).when(k % 4 == 3, F.lit(', "live": false')).when(k % 4 == 2, F.lit(', "live": null')).when(k % 4 == 1, F.lit(', "live": true')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"from": "'), start, F.lit('", "to": "'), said(us + (k % 11 - 1) * 3_600_000_000, second), F.lit('"'), live, F.lit(', "written": "'), said(us, second), F.lit('"}'))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", times.window_in_force(text, us + k % 37 * 3_600_000_000).alias("w"))
    return rows.filter("w IS NOT NULL").select("event_id", "w.from_us", "w.to_us")


@_frame("beam_geometry", """SELECT point_id, round(r, 4) AS slant_km, round(sqrt(r * r + k * k + 2e0 * r * k * sin(e)) - k, 4) AS height_km, round(k * atan2(r * cos(e), k + r * sin(e)), 4) AS ground_km, floor(az * 72e1 / 36e1) AS az_bin
    FROM (SELECT point_id, az, 8494.67e0 AS k, radians(2.5e0) AS e, 8494.67e0 * sin(range_km / 8494.67e0) / cos(radians(2.5e0) + range_km / 8494.67e0) AS r FROM {samples}) q""")
def beam_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = BINDINGS["samples"][0](spark, sf_dir)
    slant = geometry.slant_km(F.col("range_km"), 2.5)
    return points.select("point_id", F.round(slant, 4).alias("slant_km"), F.round(geometry.height_km(F.col("range_km"), 2.5), 4).alias("height_km"), F.round(geometry.ground_km(slant, 2.5), 4).alias("ground_km"), geometry.azimuth_bin(F.col("az"), 720).cast("double").alias("az_bin"))


@_frame("velocity_folds", "SELECT gate_id, round(z - 2e1 - 16e0 * floor((z - 2e1 + 8e0) / 16e0), 4) AS wrapped, round_even(z / 7e0, 2) AS rounded, CASE WHEN lkdp / 1e1 <= 1e-3 THEN -30e0 ELSE round(10e0 * log10(lkdp / 1e1), 4) END AS lkdp FROM {gates}")
def velocity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = BINDINGS["gates"][0](spark, sf_dir)
    return gates.select("gate_id", F.round(geometry.wrap_velocity(F.col("z") - 20, 8.0), 4).alias("wrapped"), geometry.round_even(F.col("z") / 7, 2).alias("rounded"), F.round(geometry.log_kdp(F.col("lkdp") / 10), 4).alias("lkdp"))


_TILTS = """
WITH RECURSIVE rows AS (SELECT event_type AS site, event_id AS i, cast(round(value) AS bigint) AS gates, cast(user_id AS double) / 1e1 AS elev, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS k FROM events),
fold(site, k, g, elev, gates, i) AS (SELECT site, k, 1, elev, gates, i FROM rows WHERE k = 1
    UNION ALL SELECT r.site, r.k, CASE WHEN r.elev - f.elev < 0.2e0 THEN f.g ELSE f.g + 1 END,
        CASE WHEN r.elev - f.elev < 0.2e0 AND NOT (r.gates > f.gates OR (r.gates = f.gates AND r.i > f.i)) THEN f.elev ELSE r.elev END,
        CASE WHEN r.elev - f.elev < 0.2e0 AND NOT (r.gates > f.gates OR (r.gates = f.gates AND r.i > f.i)) THEN f.gates ELSE r.gates END,
        CASE WHEN r.elev - f.elev < 0.2e0 AND NOT (r.gates > f.gates OR (r.gates = f.gates AND r.i > f.i)) THEN f.i ELSE r.i END
    FROM fold f JOIN rows r ON r.site = f.site AND r.k = f.k + 1)
SELECT site, cast(g - 1 AS bigint) AS place, max_by(i, k) AS sweep FROM fold GROUP BY site, g"""


def tilt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps of a site merged to tilts, a fold of its sorted sweeps."""
    sweeps = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("site"), F.col("event_id").alias("i"), F.round("value").cast("bigint").alias("gates"), (F.col("user_id").cast("double") / 10).alias("elev"))
    return select_tilts(sweeps).select("site", F.posexplode("tilts").alias("place", "t")).select("site", F.col("place").cast("bigint").alias("place"), F.col("t.i").alias("sweep"))


QUERIES["tilt_selection"], ORACLES["tilt_selection"] = tilt_selection, _TILTS


_SHOWN = ("REF", "VEL", "ZDR", "PHI", "RHO", "ET", "KDP", "AZSHR", "VIL", "HCA")
_SHOWN_VALUE = "CASE WHEN zdr IS NULL THEN -1000e0 WHEN z > 7e1 THEN -2000e0 WHEN gate_id % 10 = 3 THEN floor(z) WHEN gate_id % 10 = 4 THEN rho WHEN gate_id % 10 = 9 THEN 1 + floor(z / 7e0) ELSE z END"


@_frame("display_text", f"""SELECT gate_id, CASE WHEN v < -1500 THEN 'range folded' WHEN v < -900 THEN 'no data' ELSE CASE gate_id % 10 WHEN 0 THEN printf('%.1f dBZ', v) WHEN 1 THEN printf('%.1f m/s (%.0f kt)', v, v * 1.94384) WHEN 2 THEN printf('%.1f dB', v) WHEN 3 THEN printf('%d°', cast(v AS int))
    WHEN 4 THEN printf('%.3f', v) WHEN 5 THEN printf('%.1f km ARL (%.0f kft)', v, v * 3.28084) WHEN 6 THEN printf('%.2f °/km', v) WHEN 7 THEN printf('%.1f × 10⁻³/s', v) WHEN 8 THEN printf('%.1f kg/m²', v)
    ELSE ['ground clutter / AP (GC)', 'biological scatterers (BS)', 'dry snow (DS)', 'wet snow (WS)', 'ice crystals (CR)', 'graupel (GR)', 'big drops (BD)', 'light / moderate rain (RA)', 'heavy rain (HR)', 'rain / hail (RH)', 'unknown (UK)'][cast(least(v, 11) AS int)] END END AS text
    FROM (SELECT gate_id, coalesce({_SHOWN_VALUE}, -1e3) AS v FROM {{gates}}) q""")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate's value in one of ten fields, as it is shown; a gate without a value is missing."""
    gates = BINDINGS["gates"][0](spark, sf_dir)
    field = F.element_at(F.array(*[F.lit(x) for x in _SHOWN]), (F.col("gate_id") % 10 + 1).cast("int"))
    return gates.select("gate_id", field.alias("field"), F.coalesce(F.expr(_SHOWN_VALUE).cast("double"), F.lit(C.MISSING)).alias("v")).select("gate_id", texts.value_text(F.col("field"), F.col("v")).alias("text"))


@_frame("display_ranges", """SELECT gate_id, CASE gate_id % 10 WHEN 0 THEN -20 WHEN 1 THEN -64 WHEN 2 THEN -4 WHEN 4 THEN 0.2 WHEN 6 THEN -2 WHEN 7 THEN -10 WHEN 9 THEN 0.5 ELSE 0 END::double AS lo,
    CASE gate_id % 10 WHEN 0 THEN 75 WHEN 1 THEN 64 WHEN 2 THEN 8 WHEN 3 THEN 360 WHEN 4 THEN 1.05 WHEN 5 THEN 20 WHEN 6 THEN 7 WHEN 7 THEN 20 WHEN 8 THEN 80 ELSE 11.5 END::double AS hi, ['dBZ', 'm/s', 'dB', 'deg', 'CC', 'km ARL', '°/km', '10⁻³/s', 'kg/m²', 'class'][gate_id % 10 + 1] AS unit,
    CASE gate_id % 10 WHEN 0 THEN z < 5 WHEN 7 THEN abs(z - 30) < 2 WHEN 8 THEN z < 1 ELSE false END AS hidden FROM {gates}""")
def display_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and unit of ten fields, and whether a gate is below what a view shows of it."""
    field = F.element_at(F.array(*[F.lit(x) for x in _SHOWN]), (F.col("gate_id") % 10 + 1).cast("int"))
    rows = BINDINGS["gates"][0](spark, sf_dir).select("gate_id", field.alias("field"), F.when(field == "AZSHR", F.col("z") - 30).otherwise(F.col("z")).alias("v"))
    size = F.when(F.col("field").isin(*views.SIGNED), F.abs("v")).otherwise(F.col("v"))
    return rows.withColumn("r", texts.display_range(F.col("field"))).select("gate_id", "r.lo", "r.hi", "r.unit", F.coalesce(size < texts.least_shown(F.col("field")), F.lit(False)).alias("hidden"))


@_frame("warning_counts", """WITH a AS (SELECT t.at_us, i.kind, count(*) AS n FROM {ticks} t JOIN {intervals} i ON i.begin_us <= t.at_us AND t.at_us < i.end_us GROUP BY ALL)
    SELECT at_us, string_agg(n || ' ' || CASE kind WHEN 'A' THEN 'flash flood' WHEN 'N' THEN 'severe thunderstorm' ELSE 'tornado' END, ', ' ORDER BY kind DESC) AS text FROM a GROUP BY at_us""")
def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings in force at each instant by kind, the most important first."""
    order = {"A": "flash flood", "N": "severe thunderstorm", "R": "tornado"}
    counts = run(places.active_at(), ticks=BINDINGS["ticks"][0](spark, sf_dir), intervals=BINDINGS["intervals"][0](spark, sf_dir))
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(order) for x in (kind, -k)])
    name = F.create_map(*[F.lit(x) for kind in order.items() for x in kind])
    said = F.struct(rank[F.col("kind")].alias("rank"), F.concat_ws(" ", F.col("n_active").cast("string"), name[F.col("kind")]).alias("text"))
    return counts.groupBy("at_us").agg(F.array_sort(F.collect_list(said)).alias("s")).select("at_us", F.array_join(F.transform("s", lambda x: x["text"]), ", ").alias("text"))


@_frame("cell_counts", """SELECT site, 'cells: ' || count(*) || CASE WHEN count(*) FILTER (size >= 2000) > 0 THEN ', ' || count(*) FILTER (size >= 2000) || ' rotating' ELSE '' END || CASE WHEN count(*) FILTER (event_id % 97 = 0) > 0 THEN ', ' || count(*) FILTER (event_id % 97 = 0) || ' with a debris signature' ELSE '' END AS text FROM {scans} GROUP BY site""")
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a site, those that rotate, those with debris."""
    rows = BINDINGS["scans"][0](spark, sf_dir).withColumns({"rot": F.col("size") / 250, "debris": F.col("event_id") % 97 == 0})
    counts = rows.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("rot") >= C.MESO).alias("turning"), F.count_if("debris").alias("debris"))
    return counts.select("site", texts.cell_counts_text(F.col("n"), F.col("turning"), F.col("debris")).alias("text"))


@_frame("overlay_texts", """SELECT id, CASE kind WHEN 'A' THEN 'Flash Flood' WHEN 'N' THEN 'Severe Thunderstorm' ELSE 'Tornado' END || ' Warning' || CASE WHEN id % 11 = 0 THEN ' EMERGENCY' WHEN id % 7 = 0 THEN ' PDS' ELSE '' END || '  OUN ' || id % 100 || ' until ' || strftime(make_timestamp(end_us + id % 1440 * 60000000), '%H:%M') || 'Z' AS warning,
    'SPC day 1 (' || strftime(make_timestamp(begin_us + id % 720 * 60000000), '%H:%M') || 'Z): ' || CASE kind WHEN 'A' THEN 'slight risk' ELSE 'moderate risk' END AS outlook FROM {intervals}""")
def overlay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = BINDINGS["intervals"][0](spark, sf_dir)
    name = F.concat(F.when(F.col("kind") == "A", "Flash Flood").when(F.col("kind") == "N", "Severe Thunderstorm").otherwise("Tornado"), F.lit(" Warning"))
    at = lambda c, n: F.timestamp_micros(F.col(c) + F.col("id") % n * 60_000_000)
    warning = texts.warning_text(name, F.col("id") % 11 == 0, F.col("id") % 7 == 0, F.lit("OUN"), F.col("id") % 100, at("end_us", 1440))
    return rows.select("id", warning.alias("warning"), texts.outlook_text(at("begin_us", 720), F.when(F.col("kind") == "A", "Slight Risk").otherwise("Moderate Risk")).alias("outlook"))


@_frame("cell_texts", """SELECT gate_id, 'Cell ' || gate_id % 50 || printf('  %.0f dBZ  VIL %.0f kg/m²  top %.1f km', z + 0.01, z / 3 + 0.01, z / 5) || CASE WHEN zdr IS NULL THEN '' ELSE chr(10) || printf('moving from %03d° at %.0f m/s (%.0f kt)', cast(floor(d + 0.5) AS int) % 360, s, s * 1.94384) END
        || CASE WHEN sdz >= 7.8 OR gate_id % 13 = 0 THEN chr(10) || printf('rotation %.0f × 10⁻³/s', sdz * 1.03) || CASE WHEN gate_id % 13 = 0 THEN '  debris signature (TDS)' ELSE '' END ELSE '' END AS text
    FROM (SELECT *, sqrt(sdz * sdz + zdr * zdr) + 0.01 AS s, CASE WHEN degrees(atan2(-sdz - 0.01, -zdr)) < 0 THEN degrees(atan2(-sdz - 0.01, -zdr)) + 360 ELSE degrees(atan2(-sdz - 0.01, -zdr)) END AS d FROM {gates}) q""".replace("sqrt(sdz * sdz + zdr * zdr) + 0.01", "sqrt((sdz + 0.01) ** 2 + zdr * zdr)").replace("sdz >= 7.8", "sdz * 1.03 >= 8"))
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = BINDINGS["gates"][0](spark, sf_dir)
    c = F.col
    u = F.when(c("zdr").isNotNull(), c("sdz") + 0.01)
    return rows.select("gate_id", texts.cell_text(F.lit(None).cast("string"), c("gate_id") % 50, c("z") + 0.01, c("z") / 3 + 0.01, c("z") / 5, u, c("zdr"), c("sdz") * 1.03, c("gate_id") % 13 == 0).alias("text"))


@_frame("hover_readout", f"""SELECT gate_id, printf('REF  %.1f dBZ', z) || chr(10) || printf('KTST  %.1f km @ %03d°   %.2f° beam %.2f km ARL', r, cast(floor(az + 0.5) AS int) % 360, elev, h) || chr(10) || printf('%.3f°%s  %.3f°%s', abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lon), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS text
    FROM (SELECT *, sqrt(power(r * cos(radians(elev)), 2) + power({C.KE_A_KM} + r * sin(radians(elev)), 2)) - {C.KE_A_KM} AS h, (gate_id % 1797) / 10e0 - 89.80001 AS lat, (gate_id % 3593) / 10e0 - 179.60001 AS lon, (gate_id % 3591) / 10e0 + 0.01 AS az FROM (SELECT gate_id, z, elev, 1 + (gate_id % 2300) / 10e0 AS r FROM {{gates}}) p) q""")
def hover_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = BINDINGS["gates"][0](spark, sf_dir).select("gate_id", "z", "elev", (1 + (c("gate_id") % 2300) / 10).alias("r"), ((c("gate_id") % 1797) / 10 - 89.80001).alias("lat"), ((c("gate_id") % 3593) / 10 - 179.60001).alias("lon"), ((c("gate_id") % 3591) / 10 + 0.01).alias("az"))
    height = geometry.height_of_slant_km(c("r"), c("elev"))
    return rows.select("gate_id", texts.plan_readout(F.lit("REF"), c("z"), F.lit(False), texts.place_text(F.lit("KTST"), c("r"), c("az")), c("elev"), height, c("lat"), c("lon")).alias("text"))


@_frame("distinct_requests", "SELECT 'update ' || upper(site) || CASE req_id % 4 WHEN 0 THEN ' newest' WHEN 3 THEN ' range ' || s || ' ' || s + 3600 ELSE ' at ' || s END AS key, count(*) AS n_requests FROM (SELECT req_id, site, at_us // 60000000 // 30 * 1800 AS s FROM {requests}) q GROUP BY 1")
def distinct_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by key: instants with and without seconds, with a zone or without one, are the same."""
    at = F.timestamp_seconds(F.floor(F.col("at_us") / 1_800_000_000) * 1800)
    kind = F.col("req_id") % 4
    rows = BINDINGS["requests"][0](spark, sf_dir).withColumn("site", F.when(kind == 1, F.concat(F.lit(" "), "site")).otherwise(F.col("site")))
    said = F.when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm'Z'")).when(kind == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("")
    start = F.when(kind == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    end = F.when(kind == 3, F.date_format(at + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm"))
    return rows.select(texts.request_key(F.col("site"), said, start, end).alias("key")).groupBy("key").agg(F.count("*").alias("n_requests"))


@_frame("refetch", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 3 = 0 AND age >= 60 THEN true WHEN start + 3600 > now - 120 AND age >= 120 THEN true ELSE false END AS fetch
    FROM (SELECT event_id, ts_us // 3600000000 * 3600 AS start, ts_us // 3600000000 * 3600 + event_id % 9000 AS now, event_id % 241 AS age FROM {scans}) q""")
def refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hourly buckets are to be fetched again."""
    c = F.col
    rows = BINDINGS["scans"][0](spark, sf_dir).select("event_id", (F.floor(c("ts_us") / 3_600_000_000) * 3600).alias("start"))
    now = c("start") + c("event_id") % 9000
    fetched = F.when(c("event_id") % 5 != 0, now - c("event_id") % 241)
    return rows.select("event_id", texts.needs_fetch(c("start"), fetched, c("event_id") % 3 == 0, now).alias("fetch"))


@_frame("skew_summary", """WITH m AS (SELECT a.event_id, b.site, first(b.ts_us - a.ts_us ORDER BY abs(b.ts_us - a.ts_us), b.ts_us, b.event_id) AS o FROM {scans} a JOIN {scans} b ON abs(b.ts_us - a.ts_us) <= 600000000 AND a.site <> b.site GROUP BY ALL), t AS (SELECT event_id, site, cast(floor(o / 1e6) AS bigint) AS s FROM m)
    SELECT event_id, string_agg(site || CASE WHEN s < 0 THEN ' -' ELSE ' +' END || abs(s) // 60 || ':' || lpad(cast(abs(s) % 60 AS varchar), 2, '0'), ', ' ORDER BY site) AS text FROM t GROUP BY event_id""")
def skew_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the frames of other sites are off a scan."""
    met, key = _partners(spark, sf_dir, "b")
    said = met.select(*key, "other_site", texts.skew_text(F.col("other_site"), F.floor(F.col("offset_us") / 1_000_000)).alias("text"))
    return said.groupBy(*key).agg(F.array_sort(F.collect_list("text")).alias("t")).select("event_id", F.array_join("t", ", ").alias("text"))


@_frame("shown_in_loop", f"""WITH {_SEQUENCED}, last AS (SELECT site, max(head) AS head FROM owned GROUP BY site) SELECT o.event_id, o.head = l.head AS shown FROM owned o JOIN last l USING (site)""")
def shown_in_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a scan that was replaced belongs to the loop on screen, which is its site's newest sequence."""
    rows = BINDINGS["scans"][0](spark, sf_dir)
    loops = run(scans.sequences(), scans=rows).groupBy("site").agg(F.max("first_us").alias("from_us"))
    return rows.join(F.broadcast(loops), "site").select("event_id", (F.col("ts_us") >= F.col("from_us")).alias("shown"))


@_frame("prune_summary", """WITH p AS (SELECT * FROM {scans} s WHERE ts_us < (SELECT max(ts_us) FROM {scans} n WHERE n.site = s.site)), t AS (SELECT sum(size) AS bytes FROM {scans}),
    f AS (SELECT size, coalesce(sum(size) OVER (ORDER BY ts_us, site, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p), g AS (SELECT count(*) AS n, coalesce(sum(size), 0) AS freed FROM f WHERE (SELECT bytes FROM t) - b > 1700000)
    SELECT printf('quota 0.0 GB: removed %d oldest volumes and 0 raw files (%.2f GB)', n, freed / 1e9) || CASE WHEN bytes - freed > 2000000 THEN printf('; still over quota at %.2f GB: the time window and each site''s newest scan are kept', (bytes - freed) / 1e9) ELSE '' END AS text FROM g, t WHERE n > 0 OR bytes > 2000000""")
def prune_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line about pruning volumes to their share of a quota."""
    quota, table = 2_000_000, BINDINGS["scans"][0](spark, sf_dir)
    gone = run(scans.quota_prune(int(quota * C.VOLUME_SHARE), 0, -1), scans=table).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed"))
    both = gone.crossJoin(table.agg(F.sum("size").alias("bytes")))
    text = texts.prune_text(quota, F.col("n"), F.lit(0), F.col("freed"), F.col("bytes") - F.col("freed"))
    return both.select(text.alias("text")).filter("text IS NOT NULL")


@_frame("tilt_stack", """WITH x AS (SELECT vol, az, tilt, list_concat(v, list_reverse(v)[1:tilt]) AS v FROM {radials}), w AS (SELECT vol, max(len(v)) AS width, count(DISTINCT tilt) AS n FROM x GROUP BY vol)
    SELECT x.vol, x.az, any_value(w.n) AS n_tilts, any_value(w.width) AS width, cast(sum(len(list_filter(v, lambda x: x IS NOT NULL))) AS bigint) AS n_valid, round(sum((tilt + 1) * coalesce(list_sum(v), 0)), 3) AS mark FROM x JOIN w USING (vol) GROUP BY x.vol, x.az""")
def tilt_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilts of a ray as one array of layers, padded to the widest; here each tilt is a gate longer than the one below, by its own last gates."""
    longer = BINDINGS["radials"][0](spark, sf_dir).withColumn("v", F.concat("v", F.slice(F.reverse("v"), F.lit(1), F.col("tilt").cast("int"))))
    stack = views.tilt_stack(longer)
    valid = lambda layer: F.filter(layer["v"], lambda x: x > C.VALID_ABOVE)
    n = F.aggregate("layers", F.lit(0).cast("long"), lambda a, t: a + F.size(valid(t)))
    mark = F.aggregate("layers", F.lit(0.0), lambda a, t: a + (t["tilt"] + 1) * F.aggregate(valid(t), F.lit(0.0), lambda b, x: b + x))
    return stack.select("vol", "az", F.size("layers").cast("long").alias("n_tilts"), F.size(F.get("layers", F.lit(0))["v"]).cast("long").alias("width"), n.alias("n_valid"), F.round(mark, 3).alias("mark"))


@_frame("storm_vectors", "SELECT r.vol, r.n, coalesce(m.u, s.u, 0) AS u, coalesce(m.v, s.v, 0) AS v FROM (SELECT vol, count(*) AS n FROM {radials} GROUP BY vol) r LEFT JOIN {storms} s USING (vol) LEFT JOIN (SELECT 1 AS vol, 3e0 AS u, -4e0 AS v) m USING (vol)")
def storm_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storm motion that a view takes off: one set by hand before the volume's own, else none."""
    vols = BINDINGS["radials"][0](spark, sf_dir).groupBy("vol").agg(F.count("*").alias("n"))
    by_hand = spark.createDataFrame([(1, 3.0, -4.0)], "vol bigint, u double, v double")
    return views.storm_vectors(vols, BINDINGS["storms"][0](spark, sf_dir), by_hand)


@_frame("line_tables", "SELECT dense_rank() OVER (ORDER BY x, y) - 1 AS vertex, x, y, count(*) AS degree FROM (SELECT x0 AS x, y0 AS y FROM (SELECT DISTINCT least((x0, y0), (x1, y1)) AS a, greatest((x0, y0), (x1, y1)) AS b, unnest([x0, x1]) AS x0, unnest([y0, y1]) AS y0 FROM {edges}) q) p GROUP BY x, y")
def line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the borders, numbered, with the number of segments that meet there; shared segments count once."""
    e = BINDINGS["edges"][0](spark, sf_dir)
    vertices, segments = store.line_tables(e.select(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")).alias("a"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("b")))
    degree = segments.select(F.explode(F.array("a", "b")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))
    return vertices.join(degree, "vertex")


QUERIES |= sweeps.QUERIES
ORACLES |= sweeps.ORACLES

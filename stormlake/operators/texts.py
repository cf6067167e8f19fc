"""Words and figures that a viewer shows of values, warnings, cells, frames and requests, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormlake.functions.constants import KNOTS, MESO

#: Display range and unit of each field.
FIELDS = {
    "REF": (-20.0, 75.0, "dBZ"), "VEL": (-64.0, 64.0, "m/s"), "SW": (0.0, 15.0, "m/s"), "ZDR": (-4.0, 8.0, "dB"), "PHI": (0.0, 360.0, "deg"), "RHO": (0.2, 1.05, "CC"), "CFP": (-20.0, 20.0, "dB"), "DVEL": (-64.0, 64.0, "m/s"),
    "KDP": (-2.0, 7.0, "°/km"), "AZSHR": (-10.0, 20.0, "10⁻³/s"), "CREF": (-20.0, 75.0, "dBZ"), "ET": (0.0, 20.0, "km ARL"), "VIL": (0.0, 80.0, "kg/m²"), "ROT": (-10.0, 20.0, "10⁻³/s"), "TRACKS": (-10.0, 20.0, "10⁻³/s"), "HCA": (0.5, 11.5, "class"),
}
#: Names of the hydrometeor classes from code 1.
CLASS_NAMES = {
    "GC": "ground clutter / AP", "BS": "biological scatterers", "DS": "dry snow", "WS": "wet snow", "CR": "ice crystals", "GR": "graupel", "BD": "big drops", "RA": "light / moderate rain", "HR": "heavy rain", "RH": "rain / hail", "UK": "unknown",
}
#: Thresholds below which a view hides a gate unless it is told otherwise; fields that aren't named show all.
LEAST_SHOWN = {"REF": 5.0, "CREF": 5.0, "AZSHR": 2.0, "ROT": 2.0, "TRACKS": 5.0, "VIL": 1.0}
FEET_PER_M = 3.28084


def display_range(field: Column) -> Column:
    """(lo, hi, unit) of a field; 0 to 1 without unit for others."""
    out = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit("").alias("unit"))
    for name, (lo, hi, unit) in FIELDS.items():
        out = F.when(field == name, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(unit).alias("unit"))).otherwise(out)
    return out


def least_shown(field: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, least in LEAST_SHOWN.items():
        out = F.when(field == name, least).otherwise(out)
    return out


def value_text(field: Column, v: Column) -> Column:
    """A value with its unit, or what a sentinel means."""
    code = F.greatest(F.lit(1), F.least(F.floor(v + 0.5).cast("int"), F.lit(len(CLASS_NAMES))))
    names = F.array(*[F.lit(f"{name} ({short})") for short, name in CLASS_NAMES.items()])
    return (
        F.when(v < -1500, "range folded").when(v < -900, "no data").when(field == "HCA", F.element_at(names, code)).when(field == "RHO", F.format_string("%.3f", v)).when(field == "PHI", F.format_string("%.0f°", v))
        .when(field.isin("VEL", "DVEL", "SW"), F.format_string("%.1f m/s (%.0f kt)", v, v * KNOTS)).when(field == "ET", F.format_string("%.1f km ARL (%.0f kft)", v, v * FEET_PER_M)).when(field == "KDP", F.format_string("%.2f °/km", v))
        .when(field.isin("AZSHR", "ROT", "TRACKS"), F.format_string("%.1f × 10⁻³/s", v)).otherwise(F.format_string("%.1f %s", v, display_range(field)["unit"]))
    )


def place_text(icao: Column, r_km: Column, az: Column) -> Column:
    return F.format_string("%s  %.1f km @ %03d°", icao, r_km, F.pmod(F.floor(az + 0.5), F.lit(360)))


def beam_text(elev: Column, height_km: Column) -> Column:
    return F.format_string("%.2f° beam %.2f km ARL", elev, height_km)


def lat_lon_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.3f°%s  %.3f°%s", F.abs(lat), F.when(lat >= 0, "N").otherwise("S"), F.abs(lon), F.when(lon >= 0, "E").otherwise("W"))


def plan_readout(field: Column, v: Column, storm_relative: Column, place: Column, elev: Column, height_km: Column, lat: Column, lon: Column) -> Column:
    """Lines of a hover over the plan view: the value, where its gate and beam are, and the place on earth."""
    said = F.concat(field, F.lit("  "), value_text(field, v), F.when(storm_relative & (v > -900), "  storm-rel.").otherwise(""))
    return F.concat_ws("\n", said, F.concat(place, F.lit("   "), beam_text(elev, height_km)), lat_lon_text(lat, lon))


def cone_readout(field: Column, v: Column, elev: Column, place: Column, height_km: Column, lat: Column, lon: Column) -> Column:
    """Lines of a hover over a tilt's surface in space."""
    return F.concat_ws("\n", F.concat(field, F.lit("  "), value_text(field, v), F.format_string("   tilt %.2f°", elev)), F.concat(place, F.format_string("   beam %.2f km ARL", height_km)), lat_lon_text(lat, lon))


def warning_text(name: Column, emergency: Column, pds: Column, office: Column, event: Column, until: Column) -> Column:
    tag = F.when(emergency, " EMERGENCY").when(pds, " PDS").otherwise("")
    return F.format_string("%s%s  %s %d until %sZ", name, tag, office, event, F.date_format(until, "HH:mm"))


def cell_text(site: Column, number: Column, dbz: Column, vil: Column, top_km: Column, u: Column, v: Column, rot: Column, debris: Column) -> Column:
    """Lines of a cell: what it is, its motion where it is known, its rotation where it is strong."""
    first = F.format_string("%sCell %d  %.0f dBZ  VIL %.0f kg/m²  top %.1f km", F.when(site.isNotNull(), F.concat(site, F.lit(" "))).otherwise(""), number, dbz, vil, top_km)
    speed = F.hypot(u, v)
    origin = F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))
    moving = F.when(u.isNotNull(), F.format_string("moving from %03d° at %.0f m/s (%.0f kt)", F.pmod(F.floor(origin + 0.5), F.lit(360)), speed, speed * KNOTS))
    turning = F.when((rot >= MESO) | debris, F.format_string("rotation %.0f × 10⁻³/s%s", rot, F.when(debris, "  debris signature (TDS)").otherwise("")))
    return F.concat_ws("\n", first, moving, turning)


def outlook_text(issued: Column, name: Column) -> Column:
    return F.format_string("SPC day 1 (%sZ): %s", F.date_format(issued, "HH:mm"), F.lower(name))


def cell_counts_text(total: Column, rotating: Column, debris: Column) -> Column:
    return F.concat(F.format_string("cells: %d", total), F.when(rotating > 0, F.format_string(", %d rotating", rotating)).otherwise(""), F.when(debris > 0, F.format_string(", %d with a debris signature", debris)).otherwise(""))


def skew_text(site: Column, skew_s: Column) -> Column:
    """How far another site's frame is off."""
    return F.format_string("%s %s%d:%02d", site, F.when(skew_s < 0, "-").otherwise("+"), F.floor(F.abs(skew_s) / 60), F.abs(skew_s) % 60)


def request_key(site: Column, at: Column, start: Column, end: Column) -> Column:
    """Equal for requests of one site and equal instants, however written: a range wins over an instant, an instant over the
    newest. Texts that aren't instants stand for themselves."""

    def key(text: Column) -> Column:
        trimmed = F.trim(F.coalesce(text, F.lit("")))
        forms = [F.try_to_timestamp(trimmed, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")]
        return F.coalesce(F.unix_timestamp(F.coalesce(*forms)).cast("string"), trimmed)

    a, f, t = key(at), key(start), key(end)
    what = F.when((f != "") & (t != ""), F.concat_ws(" ", F.lit("range"), f, t)).when(a != "", F.concat_ws(" ", F.lit("at"), a)).otherwise("newest")
    return F.concat_ws(" ", F.lit("update"), F.upper(F.trim(site)), what)


def needs_fetch(start_s: Column, fetched_s: Column, failed: Column, now_s: Column, length_s: int = 3600, refresh_s: int = 120, retry_s: int = 60) -> Column:
    """Whether a bucket of an hour is to be fetched: never fetched, still growing and older than the refresh, or failed and older
    than the retry."""
    age = now_s - fetched_s
    live = start_s + length_s > now_s - refresh_s
    return fetched_s.isNull() | (live & (age >= refresh_s)) | (failed & (age >= retry_s))


def prune_text(quota_bytes: int, n_volumes: Column, n_raw: Column, freed: Column, remaining: Column) -> Column:
    """One line about a pruning; null if nothing went and nothing is over."""
    said = F.format_string(f"quota {quota_bytes / 1e9:.1f} GB: removed %d oldest volumes and %d raw files (%.2f GB)", n_volumes, n_raw, freed / 1e9)
    over = F.when(remaining > quota_bytes, F.format_string("; still over quota at %.2f GB: the time window and each site's newest scan are kept", remaining / 1e9)).otherwise("")
    return F.when((n_volumes > 0) | (n_raw > 0) | (remaining > quota_bytes), F.concat(said, over))


def declutter(labels: Column, most: int = 40) -> Column:
    """Labels that are shown of an array of (rank, x0, y0, x1, y1): in order of rank, each unless its box meets one that is
    shown already, up to ``most``. A fold over an array that is as long as what one view holds."""
    meets = lambda a, b: (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    kind = "array<struct<rank:bigint,x0:double,y0:double,x1:double,y1:double>>"
    return F.aggregate(F.array_sort(labels), F.array().cast(kind), lambda shown, x: F.when((F.size(shown) >= most) | F.exists(shown, lambda o: meets(o, x)), shown).otherwise(F.concat(shown, F.array(x))))

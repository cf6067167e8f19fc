"""Volumes on Spark: archive files to radials, and one pass over radials to everything that is computed of a volume.

``analysed`` reads each volume once and unfolds it once; rows of all its results leave together, told apart by kind.
A site's scans are dealt into blocks of three hours. Within a block each volume is unfolded against the one before; a
block also gets copies of the scans of the 15 minutes before it, which are unfolded first and not reported, so that its
first volume has a prior too. A task holds one volume and the prior's unfolded velocity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake.functions import constants as C
from stormlake.functions import geometry
from stormlake.operators import grids, hydrometeors, winds
from stormlake.sources import level2

RADIALS = "icao string, scan_time timestamp, complete boolean, lat double, lon double, height_m double, vcp int, elevation_number int, elevation double, azimuth double, resolution double, ray_time timestamp, nyquist double, unambiguous_km double, field string, first_gate_m double, spacing_m double, v array<float>"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Radials of every archive file under a path; files that aren't archives give none."""
    return decode(spark.read.format("binaryFile").load(path).select("path", "content"))


def decode(files: DataFrame) -> DataFrame:
    """(path, content) to one row for each ray and field; values keep the sentinels -1000 and -2000."""
    names = [x.split()[0] for x in RADIALS.split(", ")]
    shape = pa.schema([("icao", pa.string()), ("scan_time", pa.timestamp("us", "UTC")), ("complete", pa.bool_()), ("lat", pa.float64()), ("lon", pa.float64()), ("height_m", pa.float64()), ("vcp", pa.int32()), ("elevation_number", pa.int32()), ("elevation", pa.float64()), ("azimuth", pa.float64()), ("resolution", pa.float64()), ("ray_time", pa.timestamp("us", "UTC")), ("nyquist", pa.float64()), ("unambiguous_km", pa.float64()), ("field", pa.string()), ("first_gate_m", pa.float64()), ("spacing_m", pa.float64()), ("v", pa.list_(pa.float32()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    v = level2.read_volume(content.as_py(), path.as_py().rpartition("/")[2])
                except (ValueError, OSError, EOFError):
                    continue
                rows = [(v.icao, v.time_ms * 1000, v.complete, v.lat, v.lon, v.height_m, v.vcp, r.elevation_number, r.elevation, r.azimuth, r.resolution, r.time_ms * 1000, r.nyquist, r.unambiguous_km, m.name, m.first_gate_m, m.spacing_m, m.values) for r in v.radials for m in r.moments]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    return files.mapInArrow(each, RADIALS).select(*names)


def rays_of(volume: level2.Volume) -> pd.DataFrame:
    """A decoded volume's rays as ``sweeps_of`` reads them."""
    rows = [(r.elevation_number, r.elevation, r.azimuth, r.resolution, r.time_ms, r.nyquist, m.name, m.first_gate_m, m.spacing_m, m.values) for r in volume.radials for m in r.moments]
    return pd.DataFrame(rows, columns=["elevation_number", "elevation", "azimuth", "resolution", "ray_time", "nyquist", "field", "first_gate_m", "spacing_m", "v"])


def with_site(radials: DataFrame, sites: DataFrame) -> DataFrame:
    """Fill missing places from the site dimension (icao, lat, lon, height_m)."""
    known = sites.select(F.col("icao").alias("__i"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("height_m").alias("__h"))
    met = radials.join(F.broadcast(known), radials["icao"] == known["__i"], "left")
    return met.withColumns({"lat": F.coalesce("lat", "__lat"), "lon": F.coalesce("lon", "__lon"), "height_m": F.coalesce("height_m", "__h")}).drop("__i", "__lat", "__lon", "__h")


def sweeps_of(rows: pd.DataFrame) -> list[dict]:
    """Sweeps of one volume in scan order, each with its grids by field."""
    out = []
    for number, sweep in rows.sort_values(["elevation_number", "ray_time", "field"]).groupby("elevation_number"):
        n_az = 720 if sweep["resolution"].iloc[0] < 0.75 else 360
        one = {"number": int(number), "elevation": round(float(sweep["elevation"].mean()), 3), "n_az": n_az, "nyquist": float(sweep["nyquist"].iloc[0]), "n_rays": int(sweep["azimuth"].nunique()), "fields": {}, "geometry": {}}
        for name, rays in sweep.groupby("field"):
            one["fields"][name] = grids.nan_grid(grids.rasterise(rays["azimuth"].to_numpy(), list(rays["v"]), n_az))
            one["geometry"][name] = (float(rays["first_gate_m"].iloc[0]), float(rays["spacing_m"].iloc[0]))
        out.append(one)
    return out


def _tilts(sweeps: list[dict], field: str) -> list[dict]:
    some = [s for s in sweeps if field in s["fields"]]
    return [some[i] for i in grids.select_tilts([(s["elevation"], s["fields"][field].shape[1]) for s in some])]


def _beam(ground_km: np.ndarray, elev: float) -> tuple[np.ndarray, np.ndarray]:
    e, phi = np.radians(elev), ground_km / C.KE_A_KM
    r = C.KE_A_KM * np.sin(phi) / np.cos(e + phi)
    return r, np.sqrt(r**2 + C.KE_A_KM**2 + 2 * r * C.KE_A_KM * np.sin(e)) - C.KE_A_KM


def _over_ground(tilt: dict, field: str, ground_km: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values over ground bins on 720 rows, beam heights)."""
    grid, (first, spacing) = tilt["fields"][field], tilt["geometry"][field]
    r, h = _beam(np.maximum(ground_km, 0), tilt["elevation"])
    gate = np.floor((r * 1000 - first) / spacing + 0.5).astype(int)
    rows = np.arange(C.PRODUCT_ROWS) * grid.shape[0] // C.PRODUCT_ROWS
    out = np.full((C.PRODUCT_ROWS, len(ground_km)), np.nan)
    ok = (gate >= 0) & (gate < grid.shape[1])
    out[:, ok] = grid[rows][:, gate[ok]]
    return out, h


def column_grids(sweeps: list[dict]) -> dict[str, np.ndarray]:
    """CREF, ET, VIL and ROT on the lowest tilt's geometry, 720 rows."""
    tilts = _tilts(sweeps, "REF")
    if not tilts:
        return {}
    first, spacing = tilts[0]["geometry"]["REF"]
    ground = (first + spacing * np.arange(tilts[0]["fields"]["REF"].shape[1])) / 1000
    stack = [_over_ground(t, "REF", ground) for t in tilts]
    dbz, h = np.stack([s[0] for s in stack]), np.stack([s[1] for s in stack])
    cref = np.nanmax(np.where(np.isfinite(dbz), dbz, -np.inf), axis=0)
    cref = np.where(np.isfinite(cref), cref, np.nan)
    top = np.full(cref.shape, np.nan)
    for k in range(len(tilts)):
        high = dbz[k] >= C.ECHO_TOP_DBZ
        level = np.broadcast_to(h[k], cref.shape)
        if k + 1 < len(tilts):
            with np.errstate(all="ignore"):
                f = (dbz[k] - C.ECHO_TOP_DBZ) / (dbz[k] - dbz[k + 1])
            level = np.where(dbz[k + 1] < C.ECHO_TOP_DBZ, h[k] + f * (h[k + 1] - h[k]), level)
        top = np.where(high, level, top)
    z = np.where(dbz >= C.VIL_MIN_DBZ, 10 ** (np.minimum(dbz, C.VIL_CAP_DBZ) / 10), 0.0)
    vil = (3.44e-6 * (0.5 * (z[1:] + z[:-1])) ** (4 / 7) * ((h[1:] - h[:-1])[:, None, :] * 1000)).sum(axis=0)
    out = {"CREF": cref, "ET": top, "VIL": np.where(np.isfinite(cref) & (vil >= C.VIL_MIN), vil, np.nan)}
    rot = np.full(cref.shape, np.nan)
    for t in _tilts(sweeps, "AZSHR"):
        value, height = _over_ground(t, "AZSHR", ground)
        rot = np.fmax(rot, np.where(height <= C.ROT_TOP_KM, value, np.nan))
    out["ROT"] = np.where(cref >= C.ROT_MIN_CREF, rot, np.nan)
    return out


def resampled(sweep: dict, field: str, other: dict, of: str = "DVEL") -> np.ndarray:
    """Another sweep's field on this one's grid at equal ground range over a flat earth; NaN where it has none."""
    first, spacing = sweep["geometry"][field]
    f0, ds = other["geometry"][of]
    shape, grid = sweep["fields"][field].shape, other["fields"][of]
    ground = (first + spacing * np.arange(shape[1])) * np.cos(np.radians(sweep["elevation"]))
    gate = np.rint((ground / np.cos(np.radians(other["elevation"])) - f0) / ds).astype(int)
    out = np.full(shape, np.nan)
    ok = (gate >= 0) & (gate < grid.shape[1])
    out[:, ok] = grid[np.arange(shape[0]) * grid.shape[0] // shape[0]][:, gate[ok]]
    return out


def _at_range(sweep: dict, field: str, n_az: int, slant_m: np.ndarray) -> np.ndarray:
    """A field at slant ranges on n_az rows by the nearest gate; NaN outside."""
    grid, (first, spacing) = sweep["fields"][field], sweep["geometry"][field]
    place = (slant_m - first) / spacing
    gate = (np.sign(place) * np.floor(np.abs(place) + 0.5)).astype(int)
    ok = (gate >= 0) & (gate < grid.shape[1])
    out = np.full((n_az, len(slant_m)), np.nan)
    out[:, ok] = grid[np.arange(n_az) * grid.shape[0] // n_az][:, gate[ok]]
    return out


def unfold(sweeps: list[dict], prior: list[dict] | None = None) -> np.ndarray:
    """Add DVEL to every sweep with velocity and a Nyquist velocity, bottom up: first against the prior volume's nearest
    tilt within a quarter degree, then also against the wind profile that the first pass gives. Returns the profile."""
    tilts = sorted((s for s in sweeps if "VEL" in s["fields"] and s["nyquist"] > 0), key=lambda s: (s["elevation"], s["number"]))
    before = {}
    for t in tilts:
        near = [p for p in prior or () if abs(p["elevation"] - t["elevation"]) <= C.PRIOR_ELEV_DEG]
        before[t["number"]] = [resampled(t, "VEL", min(near, key=lambda p: abs(p["elevation"] - t["elevation"])))] if near else []  # noqa: B023
    wind = np.zeros((0, 4))
    for turn in range(2):
        under = None
        for t in tilts:
            vel, (first, spacing) = t["fields"]["VEL"], t["geometry"]["VEL"]
            fallbacks = list(before[t["number"]])
            if turn:
                fallbacks.append(winds.predicted(wind, vel.shape, t["elevation"], first, spacing))
            t["fields"]["DVEL"] = grids.dealias(vel, t["nyquist"], None if under is None else resampled(t, "VEL", under), tuple(fallbacks))
            t["geometry"]["DVEL"] = (first, spacing)
            under = t
        rings = [x for t in tilts for x in winds.fit_rings(t["fields"]["DVEL"], t["elevation"], *t["geometry"]["DVEL"], t["fields"]["VEL"], t["nyquist"])]
        wind = winds.profile(rings)
        if not len(wind):
            break
    return wind


def add_derived(sweeps: list[dict]) -> None:
    """Add AZSHR beside DVEL and KDP beside PHI with RHO, on the geometry of what they come from."""
    for s in sweeps:
        f, at = s["fields"], s["geometry"]
        if "DVEL" in f:
            f["AZSHR"], at["AZSHR"] = grids.azimuthal_shear(f["DVEL"], *at["DVEL"]), at["DVEL"]
        if {"PHI", "RHO"} <= set(f):
            n_az, n = f["PHI"].shape
            slant = at["PHI"][0] + at["PHI"][1] * np.arange(n)
            ref = _at_range(s, "REF", n_az, slant) if "REF" in f else np.full((n_az, n), np.nan)
            f["KDP"], at["KDP"] = grids.specific_phase(f["PHI"], _at_range(s, "RHO", n_az, slant), ref, at["PHI"][1]), at["PHI"]


#: Tilts, slant ranges and gates that show a bright band, and how many must lie how close together.
BAND_ELEVATIONS, BAND_RANGE_M, BAND_RHO, BAND_DBZ, BAND_ZDR = (3.5, 10.5), (5000.0, 80_000.0), (0.90, 0.97), (30.0, 47.0), (0.8, 2.5)
BAND_GATES, BAND_IQR_M, BAND_DEPTH_M = 300, 1000.0, 600.0


def bright_band(sweeps: list[dict]) -> tuple[float, float, int] | None:
    """(bottom, top, gates) of the melting layer in metres above the radar: nearest-rank 10th and 90th percentiles of the
    heights of wet-snow-like gates, where there are enough and they lie close together."""
    heights = []
    for s in sweeps:
        f = s["fields"]
        if not BAND_ELEVATIONS[0] <= s["elevation"] <= BAND_ELEVATIONS[1] or not {"REF", "ZDR", "RHO"} <= set(f):
            continue
        n_az, n = f["RHO"].shape
        slant = s["geometry"]["RHO"][0] + s["geometry"]["RHO"][1] * np.arange(n)
        inside = (slant >= BAND_RANGE_M[0]) & (slant <= BAND_RANGE_M[1])
        if not inside.any():
            continue
        hit = np.ones((n_az, int(inside.sum())), bool)
        for name, (lo, hi) in (("RHO", BAND_RHO), ("REF", BAND_DBZ), ("ZDR", BAND_ZDR)):
            value = _at_range(s, name, n_az, slant[inside]).astype(np.float32)
            with np.errstate(invalid="ignore"):
                hit &= (value >= np.float32(lo)) & (value <= np.float32(hi))
        heights.append(np.broadcast_to(winds.beam_height(slant[inside], s["elevation"]), hit.shape)[hit])
    h = np.sort(np.concatenate(heights)) if heights else np.zeros(0)
    at = lambda p: float(h[int(np.floor((len(h) - 1) * p + 0.5))])
    if len(h) < BAND_GATES or at(0.75) - at(0.25) > BAND_IQR_M:
        return None
    return float(np.floor(at(0.1) + 0.5)), float(np.floor(at(0.9) + 0.5)), len(h)


def melting_layer_of(sweeps: list[dict], lat: float | None, height_m: float | None, at: pd.Timestamp) -> tuple[float, float, str, int] | None:
    """(bottom, top, source, gates): the volume's bright band, else the climate of its place and day, else none."""
    if found := bright_band(sweeps):
        return found[0], found[1], "detected", found[2]
    if lat is None or not np.isfinite(lat):
        return None
    days = int(np.floor(at.timestamp() / 86_400))
    top = float(np.floor(geometry.climate_freezing_m(lat, days) - (height_m if height_m is not None and np.isfinite(height_m) else 0.0) + 0.5))
    return top - BAND_DEPTH_M, top, "climatology", 0


def _windowed(x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of valid gates within +-half along a ray, where half of the window is valid."""
    n = x.shape[1]
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    have = np.isfinite(x)
    y = np.where(have, x, 0.0)
    c, s, ss = (np.pad(np.cumsum(t, axis=1), ((0, 0), (1, 0))) for t in (have, y, y * y))
    c, s, ss = c[:, hi] - c[:, lo], s[:, hi] - s[:, lo], ss[:, hi] - ss[:, lo]
    with np.errstate(all="ignore"):
        ok = 2 * c >= hi - lo
        mean = s / c
        return np.where(ok, mean, np.nan), np.where(ok, np.sqrt(np.maximum(0, ss / c - mean**2)), np.nan)


def _phase_texture(phase: np.ndarray, half: int) -> np.ndarray:
    """Standard deviation of phase within +-half gates about the centre gate's, differences wrapped to half a turn; where the
    centre and half of the window are valid."""
    n = phase.shape[1]
    padded = np.pad(phase, ((0, 0), (half, half)), constant_values=np.nan)
    count, s, ss = (np.zeros(phase.shape) for _ in range(3))
    for k in range(2 * half + 1):
        d = padded[:, k : k + n] - phase
        with np.errstate(invalid="ignore"):
            d = d - 360.0 * (d >= 180.0) + 360.0 * (d < -180.0)
        have = np.isfinite(d)
        d = np.where(have, d, 0.0)
        count, s, ss = count + have, s + d, ss + d * d
    width = np.minimum(np.arange(n) + half + 1, n) - np.maximum(np.arange(n) - half, 0)
    with np.errstate(all="ignore"):
        return np.where(np.isfinite(phase) & (2 * count >= width), np.sqrt(np.maximum(0, ss / count - (s / count) ** 2)), np.nan)


def dual_polarisation(sweep: dict, bottom_m: float, top_m: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray] | None:
    """(variables by name, layer, valid) of a sweep's gates on the geometry of ZDR; moments of other gates are read at
    equal range. Layers are 0 below, 1 within and 2 above the melting layer, for half a beam's width either way."""
    f = sweep["fields"]
    if not {"REF", "ZDR", "RHO"} <= set(f):
        return None
    n_az, n = f["ZDR"].shape
    first, spacing = sweep["geometry"]["ZDR"]
    slant = first + spacing * np.arange(n)
    ref, rho = _at_range(sweep, "REF", n_az, slant), _at_range(sweep, "RHO", n_az, slant)
    half, wide = (max(1, int(np.floor(m / spacing + 0.5))) for m in (500, 1000))
    (z, sdz), (zdr, _), (mean_rho, _) = (_windowed(x, half) for x in (ref, f["ZDR"], rho))
    none = np.full((n_az, n), np.nan)
    kdp = _at_range(sweep, "KDP", n_az, slant) if "KDP" in f else none
    with np.errstate(all="ignore"):
        lkdp = np.where(kdp > 0.001, 10 * np.log10(kdp), np.where(np.isfinite(kdp), -30.0, np.nan))
    sdphi = _phase_texture(_at_range(sweep, "PHI", n_az, slant), wide) if "PHI" in f else none
    e = sweep["elevation"]
    layer = np.where(winds.beam_height(slant, e + hydrometeors.HALF_BEAM) <= bottom_m, 0, np.where(winds.beam_height(slant, e - hydrometeors.HALF_BEAM) >= top_m, 2, 1))
    valid = np.isfinite(ref) & np.isfinite(f["ZDR"]) & np.isfinite(rho) & np.isfinite(z) & np.isfinite(zdr) & np.isfinite(mean_rho)
    return {"z": z, "zdr": zdr, "rho": mean_rho, "lkdp": lkdp, "sdz": sdz, "sdphi": sdphi}, np.broadcast_to(layer, (n_az, n)), valid


def add_hydrometeors(sweeps: list[dict], bottom_m: float, top_m: float) -> None:
    """Add HCA, the code of each dual-polarisation gate, on the geometry of ZDR."""
    for s in sweeps:
        if (found := dual_polarisation(s, bottom_m, top_m)) is None:
            continue
        variables, layer, valid = found
        grid = np.full(valid.shape, np.nan)
        best = hydrometeors.scores({k: v[valid] for k, v in variables.items()}, layer[valid], np.full(int(valid.sum()), s["elevation"]))
        grid[valid] = hydrometeors.codes(best)[0]
        s["fields"]["HCA"], s["geometry"]["HCA"] = grid, s["geometry"]["ZDR"]


def cells_of(sweeps: list[dict], products: dict[str, np.ndarray]) -> list[dict]:
    """Storm cells of a volume from its products and the lowest tilt with REF, RHO and ZDR."""
    if not products:
        return []
    first, spacing = _tilts(sweeps, "REF")[0]["geometry"]["REF"]
    dual = [t for t in _tilts(sweeps, "RHO") if {"REF", "ZDR"} <= set(t["fields"])][:1]
    low = None
    if dual:
        n_az, n = dual[0]["fields"]["REF"].shape
        f0, ds = dual[0]["geometry"]["REF"]
        low = {k: _at_range(dual[0], k, n_az, f0 + ds * np.arange(n)) for k in ("REF", "RHO", "ZDR")} | {"first_km": f0 / 1000, "spacing_km": ds / 1000}
    return grids.find_cells(products["CREF"], first / 1000, spacing / 1000, {"vil": products["VIL"], "et": products["ET"], "rot": products["ROT"]}, low)


def _frames(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[tuple]:
    """(keys..., rows) of each run of rows with equal keys, from batches in that order; holds one run and a batch."""
    name, held = None, []
    for batch in batches:
        for key, rows in batch.groupby(list(keys), sort=True):
            if held and key != name:
                yield *name, pd.concat(held)
                held = []
            name = key
            held.append(rows)
    if held:
        yield *name, pd.concat(held)


#: Seconds of a block of a site's scans.
BLOCK_S = 3 * 3600

DERIVED = ("DVEL", "AZSHR", "KDP", "HCA")
RAY = "field string, elevation_number int, elevation double, az_bin int, first_gate_m double, spacing_m double, v array<float>"
CELL = "rank int, x_km double, y_km double, area_km2 double, max_dbz double, max_vil double, max_et double, max_rot double, debris boolean"
WIND = "height_m double, u_ms double, v_ms double, n int"
MOTION = "right_u double, right_v double, left_u double, left_v double, mean_u double, mean_v double, srh1 double, srh3 double"
LAYER = "bottom_m double, top_m double, source string, n int"
HYDROMETEOR = "elevation_number int, elevation double, code int, n_gates long"
KINDS = {"field": RAY, "product": RAY, "cell": CELL, "wind_profile": WIND, "storm_motion": MOTION, "melting_layer": LAYER, "hydrometeor": HYDROMETEOR}
ANALYSED = "kind string, icao string, scan_time timestamp, " + ", ".join(f"{k} struct<{v.replace(' ', ':')}>".replace(",:", ",") for k, v in {"ray": RAY, **{k: v for k, v in KINDS.items() if v is not RAY}}.items())
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}


def _shape(fields: str) -> list[tuple[str, pa.DataType]]:
    return [(x.split(" ")[0], _ARROW[x.split(" ")[1]]) for x in fields.split(", ")]


def _rays(name: str, sweep: dict) -> dict[str, list]:
    """A grid's rays that have a valid gate; missing gates as the sentinel."""
    grid, (first, spacing) = sweep["fields"][name], sweep["geometry"][name]
    rows = np.flatnonzero(np.isfinite(grid).any(axis=1))
    values = np.where(np.isfinite(grid[rows]), grid[rows], C.MISSING).astype(np.float32)
    many = lambda x: [x] * len(rows)
    v = pa.ListArray.from_arrays(np.arange(0, values.size + 1, grid.shape[1], dtype=np.int32), values.ravel()) if len(rows) else pa.array([], pa.list_(pa.float32()))
    return {"field": many(name), "elevation_number": many(sweep["number"]), "elevation": many(sweep["elevation"]), "az_bin": rows.tolist(), "first_gate_m": many(first), "spacing_m": many(spacing), "v": v}


def _rows(columns: list[str], *rows: tuple) -> dict[str, list]:
    return dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)) if rows else {}


def analyse(sweeps: list[dict], wind: np.ndarray, lat: float | None, height_m: float | None, at: pd.Timestamp, kinds: set[str]) -> Iterator[tuple[str, dict[str, list]]]:
    """(kind, columns) of all results of one unfolded volume."""
    names = {k: [n for n, _ in _shape(v)] for k, v in KINDS.items()}
    if kinds & {"field", "product", "cell", "hydrometeor"}:
        add_derived(sweeps)
    layer = melting_layer_of(sweeps, lat, height_m, at) if kinds & {"field", "melting_layer", "hydrometeor"} else None
    if layer:
        yield "melting_layer", _rows(names["melting_layer"], layer)
    if layer and kinds & {"field", "hydrometeor"}:
        add_hydrometeors(sweeps, layer[0], layer[1])
        for s in sweeps:
            if "HCA" in s["fields"]:
                code, n = np.unique(s["fields"]["HCA"][np.isfinite(s["fields"]["HCA"])].astype(int), return_counts=True)
                yield "hydrometeor", _rows(names["hydrometeor"], *((s["number"], s["elevation"], int(c), int(k)) for c, k in zip(code, n, strict=True)))
    if "field" in kinds:
        for s in sweeps:
            for name in DERIVED:
                if name in s["fields"]:
                    yield "field", _rays(name, s)
    if kinds & {"product", "cell"}:
        products = column_grids(sweeps)
        for name, grid in products.items():
            lowest = _tilts(sweeps, "REF")[0]
            yield "product", _rays(name, {"fields": {name: grid}, "geometry": {name: lowest["geometry"]["REF"]}, "number": lowest["number"], "elevation": lowest["elevation"]})
        found = cells_of(sweeps, products)
        yield "cell", _rows(names["cell"], *((k, *(round(c[x], 3) for x in names["cell"][1:-1]), bool(c.get("debris", False))) for k, c in enumerate(found)))
    yield "wind_profile", _rows(names["wind_profile"], *((float(h), float(u), float(v), int(n)) for h, u, v, n in wind))
    if m := winds.bunkers(wind):
        yield "storm_motion", _rows(names["storm_motion"], (*m["right"], *m["left"], *m["mean"], m["srh1"], m["srh3"]))


def chained(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.Timestamp, pd.DataFrame, list[dict], np.ndarray]]:
    """Volumes of each block in time order, each unfolded against the block's last complete one if it is at most 15 minutes old;
    those that only lead into the block aren't given."""
    last = None
    for icao, block, at, volume in _frames(batches, "icao", "block", "scan_time"):
        sweeps = sweeps_of(volume)
        fresh = last is not None and last[:2] == (icao, block) and 0 < (at - last[2]).total_seconds() <= C.PRIOR_MAX_AGE_S
        wind = unfold(sweeps, last[3] if fresh else None)
        if bool(volume["complete"].iloc[0]):
            keep = [{**t, "fields": {"DVEL": t["fields"]["DVEL"]}} for t in _tilts(sweeps, "DVEL")]
            last = (icao, block, at, keep)
        if not volume["leads"].iloc[0]:
            yield icao, at, volume, sweeps, wind


def blocks(radials: DataFrame, block_s: int = BLOCK_S, lead_s: int = C.PRIOR_MAX_AGE_S) -> DataFrame:
    """Rows by site and block, in time order; scans of the last 15 minutes (lead_s) of a block also lead into the next."""
    at = F.unix_micros("scan_time")
    own = F.floor(at / (block_s * 1_000_000)).cast("long")
    near = at >= (own + 1) * F.lit(block_s * 1_000_000) - F.lit(lead_s * 1_000_000)
    place = F.struct(own.alias("block"), F.lit(False).alias("leads"))
    lead = F.struct((own + 1).alias("block"), F.lit(True).alias("leads"))
    rows = radials.filter(F.col("icao").isNotNull() & F.col("scan_time").isNotNull()).withColumn("__b", F.explode(F.when(near, F.array(place, lead)).otherwise(F.array(place))))
    return rows.select(*radials.columns, "__b.block", "__b.leads").repartition("icao", "block").sortWithinPartitions("icao", "block", "scan_time")


def analysed(radials: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), block_s: int = BLOCK_S, lead_s: int = C.PRIOR_MAX_AGE_S) -> DataFrame:
    """Everything that is computed of each volume: rows (kind, icao, scan_time, and a struct for each kind)."""
    wanted = set(kinds)
    structs = {"ray": RAY, **{k: v for k, v in KINDS.items() if v is not RAY}}
    shape = pa.schema([("kind", pa.string()), ("icao", pa.string()), ("scan_time", pa.timestamp("us", "UTC")), *((k, pa.struct(_shape(v))) for k, v in structs.items())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for icao, at, volume, sweeps, wind in chained(b.to_pandas() for b in batches):
            for kind, columns in analyse(sweeps, wind, _number(volume["lat"]), _number(volume["height_m"]), at, wanted):
                if kind not in wanted or not columns:
                    continue
                own = "ray" if KINDS[kind] is RAY else kind
                fields = _shape(KINDS[kind])
                made = pa.StructArray.from_arrays([columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], t) for n, t in fields], fields=[pa.field(n, t) for n, t in fields])
                n = len(made)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([icao] * n), pa.array([at] * n, pa.timestamp("us", "UTC")), *(made if k == own else pa.nulls(n, shape.field(k).type) for k in structs)], schema=shape)

    return blocks(radials, block_s, lead_s).mapInArrow(each, ANALYSED)


def _number(column: pd.Series) -> float | None:
    found = column.iloc[0]
    return None if pd.isna(found) else float(found)


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    """The table of one kind out of ``analysed``."""
    return found.filter(F.col("kind") == kind).select("icao", "scan_time", f"{'ray' if KINDS[kind] is RAY else kind}.*")


def derived_fields(radials: DataFrame) -> DataFrame:
    """Rays of DVEL, AZSHR, KDP and HCA; missing gates -1000."""
    return of_kind(analysed(radials, ("field",)), "field")


def wind_profiles(radials: DataFrame) -> DataFrame:
    return of_kind(analysed(radials, ("wind_profile",)), "wind_profile")


def storm_motions(radials: DataFrame) -> DataFrame:
    return of_kind(analysed(radials, ("storm_motion",)), "storm_motion")


def products(radials: DataFrame) -> DataFrame:
    """Rays of CREF, ET, VIL and ROT over ground bins that have a value; missing bins -1000."""
    return of_kind(analysed(radials, ("product",)), "product")


def cells(radials: DataFrame) -> DataFrame:
    """Storm cells of each volume, strongest first."""
    return of_kind(analysed(radials, ("cell",)), "cell")


def melting_layer(radials: DataFrame) -> DataFrame:
    """The melting layer of each volume and whether it was detected or is the climate's."""
    return of_kind(analysed(radials, ("melting_layer",)), "melting_layer")


def hydrometeor_counts(radials: DataFrame) -> DataFrame:
    """Gates of each class, volume and sweep."""
    return of_kind(analysed(radials, ("hydrometeor",)), "hydrometeor")


TRACK = "icao string, scan_time timestamp, track_id int, x_km double, y_km double, u_ms double, v_ms double, n_frames int"


def cell_tracks(found: DataFrame) -> DataFrame:
    """Cells linked from frame to frame of a site; ids count up through all of its frames. A site's cells are some dozens of narrow
    rows a scan; a task streams them and holds two frames."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, previous, new, before = None, [], 1, None
        for icao, at, frame in _frames(batches, "icao", "scan_time"):
            if icao != site:
                site, previous, new, before = icao, [], 1, None
            current = [{"time_s": at.timestamp(), "x_km": r.x_km, "y_km": r.y_km} for r in frame.itertuples()]
            new = grids.link_cells(previous, current, (at - before).total_seconds() if before is not None else 0, new)
            out = [(icao, at, c["id"], c["x_km"], c["y_km"], *(c["motion"] or (None, None)), len(c["track"])) for c in current]
            previous, before = current, at
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TRACK.split(", ")])

    rows = found.filter(F.col("icao").isNotNull() & F.col("scan_time").isNotNull())
    return rows.repartition("icao").sortWithinPartitions("icao", "scan_time", "rank").mapInPandas(each, TRACK)

"""Beam, projection and rounding as Column functions. Angles in degrees; every constant is a double literal."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormlake.functions.constants import EARTH_43_M, EARTH_KM, KE_A_KM, KNOTS, VALID_ABOVE

Value = Column | float


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def round_even(x: Value, digits: int = 0) -> Column:
    """Ties to even on the scaled value, which decimal rounding isn't."""
    scale = float(10**digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def is_valid(v: Column) -> Column:
    return v > F.lit(VALID_ABOVE)


def is_folded(v: Column) -> Column:
    return v < F.lit(-1500.0)


def valid_or_null(v: Column) -> Column:
    return F.when(is_valid(v), v)


def beam_height_m(slant_m: Value, elev: Value) -> Column:
    """Height above the radar of a gate at a slant range, metres."""
    r, big = _c(slant_m), F.lit(EARTH_43_M)
    return F.sqrt(r * r + big * big + 2.0 * r * big * F.sin(F.radians(_c(elev)))) - big


def slant_km(ground_km: Value, elev: Value) -> Column:
    """Slant range of a beam over a point of the ground."""
    phi = _c(ground_km) / F.lit(KE_A_KM)
    return F.lit(KE_A_KM) * F.sin(phi) / F.cos(F.radians(_c(elev)) + phi)


def height_of_slant_km(r_km: Value, elev: Value) -> Column:
    """Height of the beam above the radar at a slant range."""
    r, k = _c(r_km), F.lit(KE_A_KM)
    return F.sqrt(r * r + k * k + 2.0 * r * k * F.sin(F.radians(_c(elev)))) - k


def height_km(ground_km: Value, elev: Value) -> Column:
    """Height of a beam over a point of the ground."""
    r, k = slant_km(ground_km, elev), F.lit(KE_A_KM)
    return F.sqrt(r * r + k * k + 2.0 * r * k * F.sin(F.radians(_c(elev)))) - k


def ground_km(slant: Value, elev: Value) -> Column:
    """Ground range of a gate at a slant range."""
    r, k, e = _c(slant), F.lit(KE_A_KM), F.radians(_c(elev))
    return k * F.atan2(r * F.cos(e), k + r * F.sin(e))


def elevation_of(ground: Value, height: Value) -> tuple[Column, Column]:
    """(elevation in degrees, slant range in km) of a point; the form that loses no digits near the ground."""
    phi = _c(ground) / F.lit(KE_A_KM)
    x = (F.lit(KE_A_KM) + _c(height)) * F.sin(phi)
    half = F.sin(phi / 2.0)
    z = _c(height) * F.cos(phi) - 2.0 * F.lit(KE_A_KM) * half * half
    return F.degrees(F.atan2(z, x)), F.hypot(x, z)


def project(lat: Value, lon: Value, lat0: Value, lon0: Value) -> tuple[Column, Column]:
    """(x, y) km east and north of an origin, azimuthal equidistant."""
    a, b, dlon = F.radians(_c(lat)), F.radians(_c(lat0)), F.radians(_c(lon) - _c(lon0))
    s, t = F.sin((a - b) / 2.0), F.sin(dlon / 2.0)
    hav = F.least(F.greatest(s * s + F.cos(b) * F.cos(a) * t * t, F.lit(0.0)), F.lit(1.0))
    c = 2.0 * F.asin(F.sqrt(hav))
    k = F.when(c < 1e-9, F.lit(1.0)).otherwise(c / F.sin(c)) * F.lit(EARTH_KM)
    return k * F.cos(a) * F.sin(dlon), k * (F.cos(b) * F.sin(a) - F.sin(b) * F.cos(a) * F.cos(dlon))


def unproject(x: Value, y: Value, lat0: Value, lon0: Value) -> tuple[Column, Column]:
    """(lat, lon) of a projected point."""
    rho = F.hypot(_c(x), _c(y))
    c, b = rho / F.lit(EARTH_KM), F.radians(_c(lat0))
    near = rho < 1e-9
    lat = F.asin(F.cos(c) * F.sin(b) + F.when(near, F.lit(0.0)).otherwise(_c(y) * F.sin(c) * F.cos(b) / rho))
    lon = F.atan2(_c(x) * F.sin(c), rho * F.cos(b) * F.cos(c) - _c(y) * F.sin(b) * F.sin(c))
    return F.when(near, _c(lat0)).otherwise(F.degrees(lat)), F.when(near, _c(lon0)).otherwise(_c(lon0) + F.degrees(lon))


def range_bearing(x: Value, y: Value) -> tuple[Column, Column]:
    """(range, bearing clockwise from north)."""
    return F.hypot(_c(x), _c(y)), F.pmod(F.degrees(F.atan2(_c(x), _c(y))), F.lit(360.0))


def convergence(lat: Value, lon: Value, lat0: Value, lon0: Value) -> Column:
    """Angle in degrees by which another site's north is turned in this frame: a probe 0.05 degrees north is projected."""
    x0, y0 = project(lat, lon, lat0, lon0)
    x1, y1 = project(_c(lat) + 0.05, lon, lat0, lon0)
    return F.degrees(F.atan2(x1 - x0, y1 - y0))


def direction_from(u: Value, v: Value) -> Column:
    """Meteorological direction: where the vector comes from."""
    return F.pmod(F.degrees(F.atan2(-_c(u), -_c(v))), F.lit(360.0))


def knots(u: Value, v: Value) -> Column:
    return F.hypot(_c(u), _c(v)) * F.lit(KNOTS)


def storm_relative(v: Column, u_storm: Value, v_storm: Value, az: Value, elev: Value) -> Column:
    """Radial velocity less the storm's part along the beam; sentinels pass."""
    a = F.radians(_c(az))
    along = (_c(u_storm) * F.sin(a) + _c(v_storm) * F.cos(a)) * F.cos(F.radians(_c(elev)))
    return F.when(is_valid(v), v - along).otherwise(v)


def wrap_velocity(v: Column, nyquist: Value) -> Column:
    """Into [-nyquist, nyquist)."""
    n = _c(nyquist)
    return F.pmod(v + n, 2.0 * n) - n


def nearest_gate(range_km: Value, first_km: Value, spacing_km: Value) -> Column:
    """Index of the gate whose centre is nearest, halves up."""
    return F.floor((_c(range_km) - _c(first_km)) / _c(spacing_km) + 0.5).cast("int")


def azimuth_bin(az: Value, n_az: Value) -> Column:
    n = _c(n_az)
    return F.pmod(F.floor(_c(az) * n / 360.0), n).cast("int")


def other_row(row: Column, n: Value, other_n: Value) -> Column:
    """Azimuth row of another grid, by integer division."""
    return F.floor(row * _c(other_n) / _c(n)).cast("int")


def log_kdp(k: Column) -> Column:
    return F.when(k <= 0.001, F.lit(-30.0)).otherwise(10.0 * F.log10(k))


def trapezoid(x: Column, a: Value, b: Value, c: Value, d: Value) -> Column:
    """Membership: 0 outside, a ramp up, 1, a ramp down, tested in this order."""
    a, b, c, d = map(_c, (a, b, c, d))
    return F.when((x < a) | (x > d), F.lit(0.0)).when(x < b, (x - a) / (b - a)).when(x <= c, F.lit(1.0)).otherwise((d - x) / (d - c))


def interpolate(z: Column, heights: Column, values: Column) -> Column:
    """Linear interpolation in ascending arrays, clamped at both ends; null where arrays are empty."""
    below = F.size(F.filter(heights, lambda h: h <= z))
    i = F.greatest(F.least(below, F.size(heights) - 1), F.lit(1)) - 1
    h0, h1, v0, v1 = F.get(heights, i), F.get(heights, i + 1), F.get(values, i), F.get(values, i + 1)
    t = F.least(F.greatest((z - h0) / (h1 - h0), F.lit(0.0)), F.lit(1.0))
    return F.when(F.size(heights) == 0, F.lit(None).cast("double")).when(F.size(heights) == 1, v0).otherwise(v0 + t * (v1 - v0))


def climate_freezing_m(lat: float, days: int) -> float:
    """Height above the sea of 0 degrees Celsius by latitude and days since 1970: highest in late July, a mean that falls
    and a swing that grows poleward; seasons are turned round in the south."""
    a = min(max(abs(lat), 10.0), 70.0)
    swing = min(max(50.0 * a - 350.0, 300.0), 1900.0)
    season = math.cos(2 * math.pi * (days % 365.2425 - 205.0) / 365.2425)
    return max(0.0, 5900.0 - 75.0 * a + (season if lat >= 0 else -season) * swing)

"""Wind profiles of a volume and what follows from them (numpy, one volume at a time)."""

from __future__ import annotations

import numpy as np

from stormlake.functions.constants import EARTH_43_M


def beam_height(r: np.ndarray, elev: float) -> np.ndarray:
    return np.sqrt(r**2 + EARTH_43_M**2 + 2 * r * EARTH_43_M * np.sin(np.radians(elev))) - EARTH_43_M


def _solve(s: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    a = np.stack([np.ones_like(s), s, c], axis=1)
    normal = a.T @ a
    if abs(np.linalg.det(normal)) <= 1e-6 * max(len(y), 1) ** 3:
        return None
    return np.linalg.solve(normal, a.T @ y)


def fit_rings(velocity: np.ndarray, elev: float, first_m: float, spacing_m: float, raw: np.ndarray | None = None, nyquist: float = 0.0) -> list[tuple[float, float, float]]:
    """(height, u, v) of rings of four gates between 5 and 60 km, two passes.

    A ring needs a quarter of its gates, six of eight sectors with some, and a residual of at most 4.5 m/s. In the second
    pass raw velocity is unfolded around the first fit.
    """
    n_az, n_gates = velocity.shape
    if elev > 20:
        return []
    az = np.radians((np.arange(n_az) + 0.5) * 360 / n_az)
    g0 = max(0, int(np.ceil((5000 - first_m) / spacing_m)))
    out = []
    for ring in range(max(0, (min(n_gates, int((60_000 - first_m) / spacing_m) + 1) - g0) // 4)):
        block = slice(g0 + ring * 4, g0 + ring * 4 + 4)
        v = velocity[:, block]
        m = np.isfinite(v)
        s, c = np.broadcast_to(np.sin(az)[:, None], v.shape), np.broadcast_to(np.cos(az)[:, None], v.shape)
        if m.sum() < 0.25 * v.size:
            continue
        found = _solve(s[m], c[m], v[m])
        if found is None:
            continue
        y = v
        if raw is not None and nyquist > 0:
            model = found[0] + found[1] * s + found[2] * c
            res = np.mod(raw[:, block] - model + nyquist, 2 * nyquist) - nyquist
            rms = np.sqrt(np.nanmean((v - model)[m] ** 2))
            y = np.where(np.abs(res) < 3 * max(rms, 2.0), model + res, np.nan)
            m = np.isfinite(y)
            found = _solve(s[m], c[m], y[m]) if m.sum() >= 0.25 * v.size else None
            if found is None:
                continue
        rms = np.sqrt(np.mean((y[m] - found[0] - found[1] * s[m] - found[2] * c[m]) ** 2))
        sectors = len(np.unique(np.broadcast_to((np.arange(n_az) * 8 // n_az)[:, None], v.shape)[m]))
        if rms > 4.5 or sectors < 6:
            continue
        slant = first_m + (g0 + (ring + 0.5) * 4 - 0.5) * spacing_m
        cosine = np.cos(np.radians(elev))
        out.append((float(beam_height(np.array(slant), elev)), float(found[1] / cosine), float(found[2] / cosine)))
    return out


def profile(rings: list[tuple[float, float, float]]) -> np.ndarray:
    """(height, u, v, n) medians of 250 m bins under 12 km with two rings or more."""
    rows = []
    held = np.array(rings).reshape(-1, 3)
    for b in np.unique(np.floor(held[held[:, 0] < 12_000, 0] / 250)):
        some = held[np.floor(held[:, 0] / 250) == b]
        if len(some) >= 2:
            rows.append(((b + 0.5) * 250, np.median(some[:, 1]), np.median(some[:, 2]), len(some)))
    return np.array(rows).reshape(-1, 4)


def predicted(wind: np.ndarray, shape: tuple[int, int], elev: float, first_m: float, spacing_m: float, reach: float = 500.0) -> np.ndarray:
    """Radial velocity of a profile on a sweep's grid; NaN more than 500 m outside the profile."""
    h = beam_height(first_m + spacing_m * np.arange(shape[1]), elev)
    z = wind[:, 0]
    near = (h >= z[0] - reach) & (h <= z[-1] + reach)
    u, v = np.interp(h, z, wind[:, 1]), np.interp(h, z, wind[:, 2])
    az = np.radians((np.arange(shape[0]) + 0.5) * 360 / shape[0])[:, None]
    return np.where(near, (u * np.sin(az) + v * np.cos(az)) * np.cos(np.radians(elev)), np.nan)


def _even(x: float, digits: int) -> float:
    return float(np.rint(x * 10**digits) / 10**digits)


def bunkers(wind: np.ndarray) -> dict | None:
    """Right and left movers, mean and shear vectors and helicity to 1 and 3 km; None without levels from 1 to 5 km."""
    if not len(wind) or wind[0, 0] > 1000 or wind[-1, 0] < 5000:
        return None
    z = np.arange(0, 6001, 250.0)
    u, v = np.interp(z, wind[:, 0], wind[:, 1]), np.interp(z, wind[:, 0], wind[:, 2])
    mean = np.array([u.mean(), v.mean()])
    shear = np.array([u[z >= 5500].mean() - u[z <= 500].mean(), v[z >= 5500].mean() - v[z <= 500].mean()])
    size = np.hypot(*shear)
    if size < 1e-3:
        return None
    away = 7.5 * np.array([shear[1], -shear[0]]) / size
    right = mean + away

    def helicity(top: float) -> float:
        m = z <= top
        su, sv = u[m] - right[0], v[m] - right[1]
        return float((su[1:] * sv[:-1] - su[:-1] * sv[1:]).sum())

    two = lambda x: [_even(x[0], 2), _even(x[1], 2)]
    return {"right": two(right), "left": two(mean - away), "mean": two(mean), "shear": two(shear), "srh1": _even(helicity(1000), 1), "srh3": _even(helicity(3000), 1)}

"""Fuzzy-logic hydrometeor classification of gates, as a table of bounds and portable SQL.

Table: gates(gate_id, z, zdr, rho, lkdp, sdz, sdphi, layer, elev), missing variables null, layer below, within or above.

``classify`` is the rule as SQL. Its sixty trapezoids make a generated method that the JVM won't compile, so ``classify_gates``
does the same on Arrow batches, four times as fast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CLASSES = ("GC", "BS", "DS", "WS", "CR", "GR", "BD", "RA", "HR", "RH")
UNKNOWN = 11
VARIABLES = ("z", "zdr", "rho", "lkdp", "sdz", "sdphi")
MIN_SCORE, CLUTTER_ELEV = 0.5, 1.6

#: Weights of the six variables for each class.
WEIGHTS = {
    "GC": (0.2, 0.4, 1, 0, 0.6, 0.8), "BS": (0.4, 0.6, 1, 0, 0.8, 0.8), "DS": (1, 0.8, 0.6, 0, 0.2, 0.2), "WS": (0.6, 0.8, 1, 0, 0.2, 0.2), "CR": (1, 0.6, 0.4, 0.5, 0.2, 0.2),
    "GR": (0.8, 1, 0.4, 0, 0.2, 0.2), "BD": (0.8, 1, 0.6, 0, 0.2, 0.2), "RA": (1, 0.8, 0.6, 0, 0.2, 0.2), "HR": (1, 0.8, 0.6, 1, 0.2, 0.2), "RH": (1, 0.8, 0.6, 1, 0.2, 0.2),
}

#: Curves over z, as factors of 1, z and z squared.
CURVES = {"f1": (-0.50, 2.50e-3, 7.50e-4), "f2": (0.68, -4.81e-2, 2.92e-3), "f3": (1.42, 6.67e-2, 4.85e-4), "g1": (-44.0, 0.8, 0.0), "g2": (-22.0, 0.5, 0.0)}

#: Trapezoids of each class and variable; a bound is a number, or a curve over z and what is added to it.
BOUNDS = {
    "GC": ((15, 20, 70, 80), (-4, -2, 1, 2), (0.5, 0.6, 0.9, 0.95), (-30, -25, 10, 20), (2, 4, 10, 15), (30, 40, 50, 60)),
    "BS": ((5, 10, 20, 30), (0, 2, 10, 12), (0.3, 0.5, 0.8, 0.83), (-30, -25, 10, 10), (1, 2, 4, 7), (8, 10, 40, 60)),
    "DS": ((5, 10, 35, 40), (-0.3, 0, 0.3, 0.6), (0.95, 0.98, 1, 1.01), (-30, -25, 10, 20), (0, 0.5, 3, 6), (0, 1, 15, 30)),
    "WS": ((25, 30, 40, 50), (0.5, 1, 2, 3), (0.88, 0.92, 0.95, 0.985), (-30, -25, 10, 20), (0, 0.5, 3, 6), (0, 1, 15, 30)),
    "CR": ((0, 5, 20, 25), (0.1, 0.4, 3, 3.3), (0.95, 0.98, 1, 1.01), (-5, 0, 10, 15), (0, 0.5, 3, 6), (0, 1, 15, 30)),
    "GR": ((25, 35, 50, 55), (-0.3, 0, ("f1", 0), ("f1", 0.3)), (0.90, 0.97, 1, 1.01), (-30, -25, 10, 20), (0, 0.5, 3, 6), (0, 1, 15, 30)),
    "BD": ((20, 25, 45, 50), (("f2", -0.3), ("f2", 0), ("f3", 0), ("f3", 1)), (0.92, 0.95, 1, 1.01), (("g1", -1), ("g1", 0), ("g2", 0), ("g2", 1)), (0, 0.5, 3, 6), (0, 1, 15, 30)),
    "RA": ((5, 10, 45, 50), (("f1", -0.3), ("f1", 0), ("f2", 0), ("f2", 0.5)), (0.95, 0.98, 1, 1.01), (("g1", -1), ("g1", 0), ("g2", 0), ("g2", 1)), (0, 0.5, 3, 6), (0, 1, 15, 30)),
    "HR": ((40, 45, 55, 60), (("f1", -0.3), ("f1", 0), ("f2", 0), ("f2", 0.5)), (0.92, 0.95, 1, 1.01), (("g1", -1), ("g1", 0), ("g2", 0), ("g2", 1)), (0, 0.5, 3, 6), (0, 1, 15, 30)),
    "RH": ((45, 50, 75, 80), (-0.3, 0, ("f1", 0), ("f1", 0.5)), (0.85, 0.90, 1, 1.01), (-10, -4, ("g1", 0), ("g1", 1)), (0, 0.5, 3, 6), (0, 1, 15, 30)),
}

#: Classes that each layer allows; clutter only on low tilts and never above.
ALLOWED = {"below": ("BS", "BD", "RA", "HR", "RH"), "within": ("BS", "DS", "WS", "GR", "BD", "RA", "HR", "RH"), "above": ("DS", "CR", "GR", "RH")}

LAYERS = tuple(ALLOWED)
#: Half the width of the beam in degrees.
HALF_BEAM = 0.475


def _sql(x: float) -> str:
    return f"({float(x)!r}e0)" if "e" not in repr(float(x)) else f"({float(x)!r})"


def _bound(bound: float | tuple[str, float]) -> str:
    return f"({bound[0]} + {_sql(bound[1])})" if isinstance(bound, tuple) else _sql(bound)


def membership(variable: str, bounds: tuple) -> str:
    """Outside 0, a ramp up, 1, a ramp down, tested in this order as bounds may cross."""
    a, b, c, d = map(_bound, bounds)
    x = variable
    return f"(CASE WHEN {x} < {a} OR {x} > {d} THEN 0e0 WHEN {x} < {b} THEN ({x} - {a}) / ({b} - {a}) WHEN {x} <= {c} THEN 1e0 ELSE ({d} - {x}) / ({d} - {c}) END)"


def classify() -> str:
    """(gate_id, code, score): the allowed class of highest score above 0.5, ties to the lowest code; else unknown (11).

    A score is the weighted mean of memberships over the variables that are there.
    """
    scores = []
    for name in CLASSES:
        have = [(v, w, b) for v, w, b in zip(VARIABLES, WEIGHTS[name], BOUNDS[name], strict=True) if w]
        top = " + ".join(f"CASE WHEN {v} IS NULL THEN 0e0 ELSE {float(w)}e0 * {membership(v, b)} END" for v, w, b in have)
        bottom = " + ".join(f"CASE WHEN {v} IS NULL THEN 0e0 ELSE {float(w)}e0 END" for v, w, b in have)
        layers = [layer for layer, names in ALLOWED.items() if name in names]
        allowed = f"layer IN ({', '.join(repr(x) for x in layers)})" if name != "GC" else f"layer IN ('below', 'within') AND elev <= {CLUTTER_ELEV}e0"
        scores.append(f"CASE WHEN z IS NOT NULL AND {allowed} THEN ({top}) / nullif({bottom}, 0e0) ELSE 0e0 END AS s{CLASSES.index(name) + 1}")
    best = "greatest(" + ", ".join(f"coalesce(s{i}, 0e0)" for i in range(1, 11)) + ")"
    code = "CASE " + " ".join(f"WHEN s{i} = best THEN {i}" for i in range(1, 11)) + f" ELSE {UNKNOWN} END"
    return f"""
    WITH curved AS (SELECT *, {", ".join(f"({_sql(p)} + {_sql(q)} * z + {_sql(r)} * z * z) AS {k}" for k, (p, q, r) in CURVES.items())} FROM {{gates}}),
    scored AS (SELECT gate_id, {", ".join(scores)} FROM curved),
    ranked AS (SELECT *, {best} AS best FROM scored)
    SELECT gate_id, CASE WHEN best > {MIN_SCORE}e0 THEN {code} ELSE {UNKNOWN} END AS code, round(best, 6) AS score FROM ranked"""


def _member(v: np.ndarray, bounds: tuple, curves: dict[str, np.ndarray]) -> np.ndarray:
    """Membership of each value, tested in the order of ``membership``."""
    if not any(isinstance(t, tuple) for t in bounds) and bounds[0] < bounds[1] and bounds[2] < bounds[3]:
        a, b, c, d = map(float, bounds)
        return np.clip(np.minimum((v - a) / (b - a), (d - v) / (d - c)), 0.0, 1.0)
    a, b, c, d = (curves[t[0]] + t[1] if isinstance(t, tuple) else float(t) for t in bounds)
    with np.errstate(all="ignore"):
        return np.where((v < a) | (v > d), 0.0, np.where(v < b, (v - a) / (np.asarray(b) - a), np.where(v <= c, 1.0, (d - v) / (np.asarray(d) - c))))


def scores(x: dict[str, np.ndarray], layer: np.ndarray, elev: np.ndarray) -> np.ndarray:
    """(gates, classes): scores of allowed classes, 0 for others. x: the six variables, NaN where missing; layer: index into
    LAYERS."""
    out = np.zeros((len(layer), len(CLASSES)))
    for index, allowed in enumerate(ALLOWED.values()):
        some = np.flatnonzero((layer == index) & np.isfinite(x["z"]))
        if not len(some):
            continue
        held = {k: v[some] for k, v in x.items()}
        z = held["z"]
        curves = {k: p + q * z + r * z * z for k, (p, q, r) in CURVES.items()}
        have = {k: np.isfinite(v) for k, v in held.items()}
        low = elev[some] <= CLUTTER_ELEV
        for k, name in enumerate(CLASSES):
            if name not in allowed and (name != "GC" or index == 2 or not low.any()):
                continue
            top, bottom = np.zeros(len(some)), np.zeros(len(some))
            for variable, weight, bounds in zip(VARIABLES, WEIGHTS[name], BOUNDS[name], strict=True):
                if weight:
                    top += np.where(have[variable], weight * _member(held[variable], bounds, curves), 0.0)
                    bottom += np.where(have[variable], float(weight), 0.0)
            with np.errstate(all="ignore"):
                out[some, k] = np.where((bottom > 0) & (low if name == "GC" else True), top / bottom, 0.0)
    return out


def codes(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, score) of the best class, the lowest code on ties; unknown up to the least score."""
    best = found.max(axis=1) if len(found) else np.zeros(0)
    return np.where(best > MIN_SCORE, found.argmax(axis=1) + 1 if len(found) else 0, UNKNOWN).astype(np.int32), best


CODED = "gate_id long, code int, score double"


def classify_gates(gates: DataFrame) -> DataFrame:
    """(gate_id, code, score) of a table of gates, as ``classify``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {v: batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k, v in enumerate(VARIABLES)}
            layer = np.array([{name: i for i, name in enumerate(LAYERS)}.get(n, -1) for n in batch.column(7).to_pylist()], np.int64)
            code, best = codes(scores(x, layer, batch.column(8).to_numpy(zero_copy_only=False).astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code), pa.array(np.round(best, 6))], names=["gate_id", "code", "score"])

    return gates.select("gate_id", *VARIABLES, "layer", "elev").mapInArrow(each, CODED)

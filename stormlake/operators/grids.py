"""Operators over one sweep or volume as numpy grids (azimuth, gate), missing gates NaN. They run inside grouped-map
functions: a group is one volume, which is bounded by the scan strategy."""

from __future__ import annotations

import heapq

import numpy as np

from stormlake.functions import constants as C


def nan_grid(values: np.ndarray) -> np.ndarray:
    return np.where(values > C.VALID_ABOVE, values.astype(np.float64), np.nan)


def rasterise(azimuths: np.ndarray, rays: list[np.ndarray], n_az: int) -> np.ndarray:
    """Rays to azimuth bins by floor; a later ray overwrites only the gates that it has. Sentinels stay."""
    width = max((len(r) for r in rays), default=0)
    out = np.full((n_az, width), C.MISSING, np.float32)
    for az, ray in zip(azimuths, rays, strict=True):
        out[int(np.floor(az * n_az / 360.0)) % n_az, : len(ray)] = ray
    return out


def select_tilts(sweeps: list[tuple[float, int]]) -> list[int]:
    """One sweep for each elevation from (elevation, gates) in scan order, lowest first: within 0.2 degrees of the last
    one kept the one with most gates stays, then the latest."""
    kept: list[int] = []
    for i in sorted(range(len(sweeps)), key=lambda i: (sweeps[i][0], i)):
        if kept and sweeps[i][0] - sweeps[kept[-1]][0] < C.TILT_MERGE_DEG:
            if (sweeps[i][1], i) > (sweeps[kept[-1]][1], kept[-1]):
                kept[-1] = i
        else:
            kept.append(i)
    return kept


def azimuthal_shear(velocity: np.ndarray, first_m: float, spacing_m: float, half_m: float = 750.0, most: int = 10, residual: float = 6.0) -> np.ndarray:
    """Least-squares slope of velocity across the beam, 1e-3 per second, over 2n+1 rays and 3 gates.

    n follows the range; needs gates on both sides, half of the window and a small residual.
    """
    v = nan_grid(velocity) if np.nanmin(velocity, initial=0) < C.VALID_ABOVE else velocity.astype(float)
    n_az, n_gates = v.shape
    r = first_m + spacing_m * np.arange(n_gates)
    step = r * 2 * np.pi / n_az
    half = np.clip(np.floor(half_m / np.maximum(step, 1e-9) + 0.5), 1, most).astype(int)
    have = np.isfinite(v)
    filled = np.where(have, v, 0.0)

    def across(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((0, 0), (1, 1)))
        return padded[:, :-2] + padded[:, 1:-1] + padded[:, 2:]

    reach = int(half.max(initial=1))
    turned = [np.concatenate([x[-reach:], x, x[:reach]]) for x in (across(have.astype(float)), across(filled), across(filled**2))]
    width = across(np.ones((1, n_gates)))[0]
    out = np.full(v.shape, np.nan)
    # n falls with range, so the gates of one n lie together
    for n in np.unique(half):
        gates = np.flatnonzero((half == n) & (r > 2000.0 - 1e-9))
        if not len(gates):
            continue
        some = slice(gates[0], gates[-1] + 1)
        c = sv = svv = sx = sxx = sxv = left = right = 0
        for k in range(-n, n + 1):
            m, y, yy = (t[reach + k : reach + k + n_az, some] for t in turned)
            x = k * step[some]
            c, sv, svv = c + m, sv + y, svv + yy
            sx, sxx, sxv = sx + m * x, sxx + m * (x * x), sxv + y * x
            if k < 0:
                left = left + m
            elif k > 0:
                right = right + m
        with np.errstate(all="ignore"):
            cov = sxv - sx * sv / c
            slope = cov / (sxx - sx * sx / c)
            spread = np.sqrt(np.maximum(0, svv - sv * sv / c - slope * cov) / c)
            ok = (left > 0) & (right > 0) & (2 * c >= (2 * n + 1) * width[some]) & (spread <= residual) & have[:, some]
        out[:, some] = np.where(ok, slope * 1000, np.nan)
    return out


def unwrap_phase(phase: np.ndarray, jump: float = 270.0) -> np.ndarray:
    """Add 360 degrees after each fall of more than ``jump`` from the last valid gate; a ray at a time."""
    out = phase.astype(float).copy()
    for ray in out:
        at = np.flatnonzero(np.isfinite(ray))
        step = np.diff(ray[at])
        turns = np.cumsum(np.where(step < -jump, 1, np.where(step > jump, -1, 0)))
        ray[at[1:]] += 360 * turns
    return out


def median5(x: np.ndarray) -> np.ndarray:
    """Median of the valid gates of five, the upper of two middles."""
    padded = np.pad(x, ((0, 0), (2, 2)), constant_values=np.nan)
    window = np.sort(np.stack([padded[:, k : k + x.shape[1]] for k in range(5)]), axis=0)
    n = np.isfinite(window).sum(axis=0)
    found = np.take_along_axis(window, np.minimum(n // 2, 4)[None], axis=0)[0]
    return np.where((n > 0) & np.isfinite(x), found, np.nan)


def specific_phase(phase: np.ndarray, rho: np.ndarray, ref: np.ndarray, spacing_m: float) -> np.ndarray:
    """Half the slope of the unwrapped, filtered phase in degrees per km: over +-1 km in strong echo, else +-3 km."""
    usable = np.isfinite(phase) & (rho >= 0.9) & (np.where(np.isfinite(ref), ref, 40.0) >= 20.0)
    smooth = median5(unwrap_phase(np.where(usable, phase, np.nan)))
    n_gates = phase.shape[1]
    x = np.arange(n_gates) * spacing_m / 1000.0
    have = np.isfinite(smooth)
    y = np.where(have, smooth, 0.0)
    sums = [np.pad(np.cumsum(t, axis=1), ((0, 0), (1, 0))) for t in (have, y, have * x, have * x * x, y * x, y * y)]
    out = np.full(phase.shape, np.nan)
    strong = np.where(np.isfinite(ref), ref, 40.0) >= 40.0
    for reach, which in ((1000.0, strong), (3000.0, ~strong)):
        k = max(1, int(round(reach / spacing_m)))
        lo, hi = np.maximum(np.arange(n_gates) - k, 0), np.minimum(np.arange(n_gates) + k + 1, n_gates)
        c, sy, sx, sxx, sxy, syy = (t[:, hi] - t[:, lo] for t in sums)
        with np.errstate(all="ignore"):
            cov = sxy - sx * sy / c
            slope = cov / (sxx - sx * sx / c)
            spread = np.sqrt(np.maximum(0, syy - sy * sy / c - slope * cov) / c)
            ok = usable & which & (3 * c >= 2 * (hi - lo)) & (spread <= 6.0)
        out = np.where(ok, np.clip(0.5 * slope, -2.0, 10.0), out)
    return out


def labels(group: np.ndarray) -> np.ndarray:
    """Labels from 1 of 4-neighbour components of equal positive values, azimuth wrapping, numbered by their first cell; 0
    where the value is 0. Runs along rays are joined across rays by rounds of least labels."""
    inside = group > 0
    new = inside.copy()
    new[:, 1:] &= group[:, 1:] != group[:, :-1]
    run = np.cumsum(new.ravel()).reshape(group.shape) - 1
    after, run_after, new_after = (np.roll(x, -1, axis=0) for x in (group, run, new))
    meet = inside & (group == after)
    meet[:, 1:] &= new[:, 1:] | new_after[:, 1:]
    u, v = run[meet], run_after[meet]
    root = np.arange(int(run.max(initial=-1)) + 1)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    number = np.cumsum(root == np.arange(len(root)))
    out = np.zeros(group.shape, np.int64)
    out[inside] = number[root[run[inside]]]
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of the components of a mask."""
    return labels(mask.astype(np.int8))


def _votes(group: np.ndarray, step: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, all votes, most voted step, its votes) of each group; the least step wins ties."""
    if not len(group):
        return (np.zeros(0, np.int64),) * 4
    low = int(step.min())
    width = int(step.max()) - low + 1
    key, place = np.unique(group.astype(np.int64) * width + (step - low), return_inverse=True)
    count = np.bincount(place, weights=weight)
    of, step = key // width, key % width + low
    order = np.lexsort((step, -count, of))
    first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    return of[first], np.bincount(of, weights=count)[of[first]], step[first], count[first]


def _boundaries(region: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, other region, step of v to the other) at each place where two regions meet, once in each direction."""
    out = []
    for a, b, x, y in ((region, np.roll(region, -1, axis=0), v, np.roll(v, -1, axis=0)), (region[:, :-1], region[:, 1:], v[:, :-1], v[:, 1:])):
        m = (a > 0) & (b > 0) & (a != b)
        step = (y - x)[m]
        out += [(a[m], b[m], step), (b[m], a[m], -step)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def dealias(velocity: np.ndarray, nyquist: float, reference: np.ndarray | None = None, fallbacks: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Unfold one sweep: regions of three velocity bands are merged along their longest boundaries by whole folds, then
    each merged component is placed by votes of a reference, of fallbacks that agree, or by its most common fold.

    velocity in m/s with NaN; reference and fallbacks are grids of the same shape of unfolded velocity.
    """
    v = np.clip(velocity.astype(float), -nyquist, nyquist)
    valid = np.isfinite(v)
    if nyquist <= 0 or valid.sum() < 2:
        return v.astype(np.float32)
    period = 2 * nyquist
    band = np.minimum(np.floor((np.where(valid, v, 0) + nyquist) / period * 3), 2).astype(np.int8)
    region = labels(np.where(valid, band + 1, 0).astype(np.int8))
    n = int(region.max()) + 1
    size = np.bincount(region.ravel(), minlength=n)
    owner, fold = _merged(region, v, size, period)
    folds = fold[region]
    unfolded = np.where(valid, v + folds * period, np.nan)
    part = owner[region]
    shift, placed = np.zeros(n, np.int64), np.zeros(n, bool)
    for grid, share in [(reference, 0.0)] * (reference is not None) + [(f, 0.7) for f in fallbacks]:
        both = valid & np.isfinite(grid) & ~placed[part]
        names, total, step, best = _votes(part[both], np.round((grid[both] - unfolded[both]) / period).astype(np.int64))
        good = (total >= 20) & (best >= share * total)
        shift[names[good]], placed[names[good]] = step[good], True
    names, _, step, _ = _votes(owner[1:], fold[1:], size[1:].astype(float))
    shift[names] = np.where(placed[names], shift[names], -step)
    unfolded += shift[part] * period
    if reference is not None:
        _follow_reference(unfolded, region, reference, period)
    return _islands(unfolded, region, size, period).astype(np.float32)


def _merged(region: np.ndarray, v: np.ndarray, size: np.ndarray, period: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, fold) of each region after merging along boundaries, the longest first, where the mean step is near a whole
    fold; the smaller part moves."""
    n = len(size)
    a, b, step = _boundaries(region, v)
    once = a < b
    key, place = np.unique(a[once] * n + b[once], return_inverse=True)
    count, jump = np.bincount(place), np.bincount(place, weights=step[once])
    links: list[dict[int, tuple[int, float]]] = [{} for _ in range(n)]
    heap = []
    for i, j, c, s in zip((key // n).tolist(), (key % n).tolist(), count.tolist(), jump.tolist(), strict=True):
        links[i][j], links[j][i] = (c, s), (c, -s)
        heap.append((-c, i, j))
    heapq.heapify(heap)
    owner, fold = list(range(n)), [0] * n
    members = [[i] for i in range(n)]
    weight = size.tolist()
    while heap:
        c, i, j = heapq.heappop(heap)
        held = links[i].get(j)
        if held is None or held[0] != -c:
            continue
        mean = held[1] / -c / period
        k = -round(mean)
        if abs(mean + k) > 0.4:
            continue
        stay, go, shift = (i, j, k) if weight[i] >= weight[j] else (j, i, -k)
        for m in members[go]:
            fold[m] += shift
            owner[m] = stay
        members[stay] += members[go]
        members[go] = []
        weight[stay] += weight[go]
        moved, links[go] = links[go], {}
        of_stay = links[stay]
        of_stay.pop(go, None)
        for other, (count_, jump_) in moved.items():
            of_other = links[other]
            of_other.pop(go, None)
            if other == stay:
                continue
            old = of_stay.get(other, (0, 0.0))
            # the jump is other minus go; go has moved up by its shift
            total = old[0] + count_
            sums = old[1] + jump_ - shift * period * count_
            of_stay[other], of_other[stay] = (total, sums), (total, -sums)
            heapq.heappush(heap, (-total, stay, other) if stay < other else (-total, other, stay))
    return np.array(owner), np.array(fold)


def _follow_reference(v: np.ndarray, region: np.ndarray, reference: np.ndarray, period: float, least: int = 100, share: float = 0.8) -> None:
    """Move single regions with many reference gates of which most lie on another fold, in place."""
    both = np.isfinite(v) & np.isfinite(reference) & (region > 0)
    names, total, step, best = _votes(region[both], np.round((reference - v)[both] / period).astype(np.int64))
    move = np.zeros(int(region.max()) + 1)
    good = (total >= least) & (best >= share * total)
    move[names[good]] = step[good]
    v += move[region] * period


def _islands(v: np.ndarray, region: np.ndarray, size: np.ndarray, period: float, passes: int = 3) -> np.ndarray:
    """Move regions that are a whole fold off most of their boundary, all of a pass at once."""
    n = len(size)
    for _ in range(passes):
        a, b, step = _boundaries(region, v)
        d = step / period
        k = np.floor(np.abs(d) + 0.5) * np.sign(d)
        near = np.abs(d - k) * period <= 0.3 * period
        a, b, k = a[near], b[near], k[near].astype(np.int64)
        names, total, k, best = _votes(a, k)
        pairs = np.unique(a * n + b)
        around = np.bincount(pairs // n, weights=size[pairs % n], minlength=n)
        move = np.zeros(n)
        good = (k != 0) & (total >= 8) & (best >= 0.8 * total) & (size[names] < around[names])
        move[names[good]] = k[good]
        if not move.any():
            break
        v = v + move[region] * period
    return v


def find_cells(cref: np.ndarray, first_km: float, spacing_km: float, extra: dict[str, np.ndarray] | None = None, low: dict | None = None) -> list[dict]:
    """Storm cells: components at 40 dBZ of 8 km2 or more, replaced by their cores at 50 and 60 where they have two or
    more; strongest first.

    extra: further maxima by name, 0 where absent; rotation counts within 8 km of the centroid. low: REF, RHO and ZDR of
    the lowest tilt with first_km and spacing_km; with it a cell has a debris flag.
    """
    n_az, n_gates = cref.shape
    r = first_km + spacing_km * np.arange(n_gates)
    area = np.broadcast_to(r * (2 * np.pi / n_az) * spacing_km, cref.shape)
    ref = np.where(np.isfinite(cref), cref, -np.inf)

    def parts(inside: np.ndarray, level: float) -> list[np.ndarray]:
        label = components(inside & (ref >= level))
        large = np.bincount(label.ravel(), weights=area.ravel()) >= C.CELL_MIN_AREA_KM2
        return [label == k for k in np.flatnonzero(large) if k]

    def split(mask: np.ndarray, levels: tuple[float, ...]) -> list[np.ndarray]:
        inner = parts(mask, levels[0]) if levels else []
        return [x for m in inner for x in split(m, levels[1:])] if len(inner) >= 2 else [mask]

    az = np.radians((np.arange(n_az) + 0.5) * 360 / n_az)
    x, y = np.sin(az)[:, None] * r, np.cos(az)[:, None] * r
    out = []
    for whole in parts(np.ones(cref.shape, bool), C.CELL_LEVELS[0]):
        for m in split(whole, C.CELL_LEVELS[1:]):
            w = 10 ** (cref[m] / 10)
            cell = {"x_km": float((w * x[m]).sum() / w.sum()), "y_km": float((w * y[m]).sum() / w.sum()), "area_km2": float(area[m].sum()), "max_dbz": float(cref[m].max())}
            for name, grid in (extra or {}).items():
                near = m if name != "rot" else np.hypot(x - cell["x_km"], y - cell["y_km"]) <= C.CELL_SEARCH_KM
                cell[f"max_{name}"] = float(max(0.0, np.nanmax(np.where(np.isfinite(grid[near]), grid[near], 0.0), initial=0.0)))
                if name == "rot" and low is not None:
                    cell["debris"] = cell["max_rot"] >= C.TDS_MIN_ROT and _debris(low, *(float(t[near & (grid == cell["max_rot"])][0]) for t in (x, y)))
            out.append(cell)
    return sorted(out, key=lambda c: (-c["max_dbz"], -c["area_km2"]))


def _debris(low: dict, x0: float, y0: float) -> bool:
    """Whether enough gates around a rotation maximum are strong, badly correlated and low in differential reflectivity."""
    n_az, n_gates = low["REF"].shape
    az = np.radians((np.arange(n_az) + 0.5) * 360 / n_az)[:, None]
    r = low["first_km"] + low["spacing_km"] * np.arange(n_gates)
    near = np.hypot(np.sin(az) * r - x0, np.cos(az) * r - y0) <= C.TDS_RADIUS_KM
    with np.errstate(invalid="ignore"):
        hit = near & (low["REF"] >= C.TDS_MIN_DBZ) & (low["RHO"] <= C.TDS_MAX_RHO) & (low["ZDR"] <= C.TDS_MAX_ZDR)
    return int(hit.sum()) >= C.TDS_MIN_GATES


def link_cells(previous: list[dict], current: list[dict], dt_s: float, next_id: int) -> int:
    """Carry ids, tracks and motion from one frame to the next: closest pairs first, one to one, ties by index; within
    10 km of where known motion leads, else 15 km. Returns the next free id."""
    pairs = []
    if 0 < dt_s <= C.TRACK_GAP_S:
        for i, cell in enumerate(current):
            for j, old in enumerate(previous):
                known = old.get("motion")
                dx, dy = (known[0] * dt_s / 1000, known[1] * dt_s / 1000) if known else (0.0, 0.0)
                d = float(np.hypot(cell["x_km"] - old["x_km"] - dx, cell["y_km"] - old["y_km"] - dy))
                if d <= (C.TRACK_MATCH_KM if known else C.TRACK_NEW_KM):
                    pairs.append((d, i, j))
    used_i, used_j = set(), set()
    for _, i, j in sorted(pairs):
        if i in used_i or j in used_j:
            continue
        used_i.add(i)
        used_j.add(j)
        current[i]["id"] = previous[j]["id"]
        current[i]["track"] = [*previous[j]["track"], (current[i]["time_s"], current[i]["x_km"], current[i]["y_km"])]
    for cell in current:
        if "id" not in cell:
            cell["id"], cell["track"] = next_id, [(cell["time_s"], cell["x_km"], cell["y_km"])]
            next_id += 1
        track = cell["track"]
        then, now = track[max(0, len(track) - C.TRACK_FRAMES)], track[-1]
        cell["motion"] = ((now[1] - then[1]) * 1000 / (now[0] - then[0]), (now[2] - then[2]) * 1000 / (now[0] - then[0])) if now[0] > then[0] else None
    return next_id


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the points that stay, ends included."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q = points[a], points[b]
        d = q - p
        rel = points[a + 1 : b] - p
        norm = np.hypot(*d)
        far = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / norm if norm else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]

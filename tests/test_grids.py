"""Grid operators against analytic truth and the synthetic scene."""

from __future__ import annotations

import numpy as np
import pytest

from stormlake.operators import grids, winds
from stormlake.sources import level2


def test_rasterise_keeps_the_tail_of_a_longer_earlier_ray():
    rays = [np.array([1, 2, 3], np.float32), np.array([9], np.float32)]
    assert grids.rasterise(np.array([10.2, 10.4]), rays, 360)[10].tolist() == [9, 2, 3]


def test_tilts_compare_with_the_last_one_kept():
    assert grids.select_tilts([(0.5, 100), (0.5, 100), (1.5, 50), (0.65, 120)]) == [3, 2]
    assert grids.select_tilts([]) == []


def test_shear_of_a_solid_body_vortex():
    n_az, n_gates, spacing = 720, 120, 250.0
    r = 2000 + spacing * np.arange(n_gates)
    az = np.radians((np.arange(n_az) + 0.5) * 360 / n_az)
    x0, y0, omega = 0.0, 17_000.0, 0.01
    x, y = np.sin(az)[:, None] * r, np.cos(az)[:, None] * r
    u, v = omega * (y - y0), -omega * (x - x0)
    radial = u * np.sin(az)[:, None] + v * np.cos(az)[:, None]
    inside = np.hypot(x - x0, y - y0) < 1000
    found = grids.azimuthal_shear(radial, 2000.0, spacing)
    truth = np.broadcast_to(-10.0 * y0 / r, found.shape)  # of the radial part
    m = inside & np.isfinite(found)
    assert m.sum() > 20 and np.abs(found[m] - truth[m]).max() < 0.3


def test_specific_phase_of_a_ramp():
    gates = np.arange(200)
    phase = np.tile(60 + 3.0 * gates * 0.25, (4, 1)) % 360
    found = grids.specific_phase(phase, np.full_like(phase, 0.99), np.full_like(phase, 45.0), 250.0)
    assert np.nanmax(np.abs(found[:, 10:-10] - 1.5)) < 0.05


def test_median_takes_the_upper_of_two_middles():
    x = np.array([[1.0, 4.0, np.nan, np.nan, np.nan]])
    assert grids.median5(x)[0, 0] == 4.0


@pytest.mark.parametrize("wrap", [True, False])
def test_components_wrap_in_azimuth_only(wrap):
    mask = np.zeros((6, 4), bool)
    mask[[0, 5] if wrap else [0, 2], 1] = True
    assert grids.components(mask).max() == (1 if wrap else 2)
    mask[:] = False
    mask[0, [0, 3]] = True
    assert grids.components(mask).max() == 2


@pytest.mark.parametrize("nyquist", [20.0, 15.0, 12.0])
def test_dealiasing_restores_a_uniform_wind(nyquist):
    az = np.radians((np.arange(360) + 0.5))
    truth = np.repeat(nyquist * (1.4 * np.sin(az) + 0.3 * np.cos(az))[:, None], 60, axis=1)
    folded = np.mod(truth + nyquist, 2 * nyquist) - nyquist
    found = grids.dealias(folded, nyquist)
    assert (np.abs(found - truth) > nyquist).mean() < 1e-3


def test_dealiasing_follows_a_reference_and_leaves_gaps():
    truth = np.full((36, 30), 33.0)
    folded = np.mod(truth + 15, 30) - 15
    folded[3, 4] = np.nan
    found = grids.dealias(folded, 15.0, reference=truth)
    assert np.isnan(found[3, 4]) and np.nanmax(np.abs(found - 33)) < 1e-3


def test_wind_profile_motion_and_helicity():
    rings = []
    for elev in (1.5, 3.0, 5.0, 8.0, 12.0, 16.0):
        az = np.radians(np.arange(360) + 0.5)
        h = winds.beam_height(1000 + 250 * np.arange(240.0), elev)
        u, v = h / 300, 5 + 0 * h
        rings += winds.fit_rings((u * np.sin(az)[:, None] + v * np.cos(az)[:, None]) * np.cos(np.radians(elev)), elev, 1000.0, 250.0)
    table = winds.profile(rings)
    assert np.abs(table[:, 1] - table[:, 0] / 300).max() < 1 and np.abs(table[:, 2] - 5).max() < 0.5
    motion = winds.bunkers(table)
    assert motion is not None and abs(motion["right"][1] - (5 - 7.5)) < 0.3 and motion["srh3"] > 0
    assert winds.bunkers(table[:3]) is None


def test_scene_has_one_strong_cell_and_velocities_unfold():
    volume = level2.storm_scene(sweeps=(0.5, 1.5))
    rays = [r for r in volume.radials if r.elevation_number == 2]
    ref = grids.nan_grid(grids.rasterise(np.array([r.azimuth for r in rays]), [r.moments[0].values for r in rays], 360))
    cells = grids.find_cells(ref, 1.0, 1.0)
    assert len(cells) == 1 and cells[0]["max_dbz"] > 55 and np.hypot(cells[0]["x_km"] - 18, cells[0]["y_km"] - 14) < 1.5
    vel = grids.nan_grid(grids.rasterise(np.array([r.azimuth for r in rays]), [r.moments[1].values for r in rays], 360))
    found = grids.dealias(vel, 20.0)
    steps = np.abs(np.diff(found, axis=0))
    assert (steps > 20).mean() < 0.01


def test_tracking_links_closest_first_and_carries_ids():
    frame = lambda t, *xy: [{"time_s": t, "x_km": x, "y_km": y} for x, y in xy]
    first, second, late = frame(0, (0, 0), (30, 0)), frame(300, (3, 0), (33, 0)), frame(9000, (3, 0))
    new = grids.link_cells([], first, 0, 1)
    new = grids.link_cells(first, second, 300, new)
    assert [c["id"] for c in second] == [1, 2] and second[0]["motion"] == (10.0, 0.0)
    assert grids.link_cells(second, late, 8700, new) == 4 and late[0]["id"] == 3


def test_simplify_keeps_corners():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [2, 2]], float)
    assert grids.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [2, 2]]


@pytest.mark.parametrize("layout", ["bzip2", "gzip"])
def test_archive_round_trip(layout):
    volume = level2.storm_scene(sweeps=(1.5,), gates=20)
    back = level2.read_volume(level2.write_volume(volume, layout))
    assert (back.icao, back.time_ms, back.vcp, len(back.radials), back.complete) == ("KTST", volume.time_ms, 212, 360, True)
    a, b = volume.radials[5], back.radials[5]
    assert abs(a.azimuth - b.azimuth) < 1e-3 and b.nyquist == 20.0 and [m.name for m in b.moments] == [m.name for m in a.moments]
    assert np.abs(a.moments[0].values - b.moments[0].values).max() <= 0.26


def test_torn_and_foreign_input():
    raw = level2.write_volume(level2.storm_scene(sweeps=(1.5,), gates=10))
    assert 0 < len(level2.read_volume(raw[: len(raw) * 2 // 3]).radials) < 360
    with pytest.raises(ValueError):
        level2.read_volume(b"not radar")


def test_debris_needs_rotation_and_bad_correlation():
    n_az, n_gates = 360, 60
    az = np.radians((np.arange(n_az) + 0.5))[:, None]
    r = 1.0 + 0.5 * np.arange(n_gates)
    d = np.hypot(np.sin(az) * r - 10, np.cos(az) * r - 10)
    ref = np.where(d < 4, 52.0, 10.0)
    rot = np.where(d < 0.6, 15.0, 1.0)
    low = {"REF": ref, "RHO": np.where(d < 2, 0.7, 0.98), "ZDR": np.zeros_like(ref), "first_km": 1.0, "spacing_km": 0.5}
    flag = lambda rot, low: grids.find_cells(ref, 1.0, 0.5, {"rot": rot}, low)[0]["debris"]
    assert flag(rot, low) and not flag(rot / 2, low) and not flag(rot, {**low, "RHO": np.full_like(ref, 0.98)})


def test_a_single_region_follows_the_reference():
    reference = np.zeros((36, 40))
    reference[10:25, 10:30] = 30.0
    v = np.zeros((36, 40))
    v[:, 9] = v[9, 9:31] = np.nan
    region = np.ones(v.shape, int)
    region[10:25, 10:30] = 2
    grids._follow_reference(v, region, reference, 30.0)
    assert v[12, 15] == 30.0 and v[0, 0] == 0.0

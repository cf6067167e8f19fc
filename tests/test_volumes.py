"""From archive files to products, cells, tracks and winds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stormlake.operators import hydrometeors, volumes
from stormlake.sources import level2

T0 = 1_714_600_800_000


@pytest.fixture(scope="module")
def radials(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    for k, layout in enumerate(["bzip2", "gzip"]):
        (folder / f"KTST_{k}").write_bytes(level2.write_volume(level2.storm_scene(time_ms=T0 + k * 300_000, sweeps=(0.5, 1.5, 3.0, 5.0, 7.5)), layout))
    (folder / "broken").write_bytes(b"nothing")
    return volumes.read_archive(spark, str(folder)).cache()


def test_radials(radials):
    assert radials.select("scan_time").distinct().count() == 2
    row = radials.filter("field = 'REF'").agg(F.countDistinct("elevation_number"), F.max(F.size("v"))).first()
    assert tuple(row) == (5, 48)


def test_products_and_cells(radials):
    names = {r["field"] for r in volumes.products(radials).select("field").distinct().collect()}
    assert names == {"CREF", "ET", "VIL", "ROT"} and volumes.products(radials).filter("field = 'CREF'").count() == 1440
    found = volumes.cells(radials).cache()
    strong = found.filter("rank = 0").collect()
    assert len(strong) == 2 and all(c["max_dbz"] > 55 and c["area_km2"] > 50 and c["max_et"] > 3 for c in strong)
    tracks = volumes.cell_tracks(found).orderBy("scan_time").collect()
    assert tracks[0]["track_id"] == tracks[-1]["track_id"] == 1 and tracks[-1]["n_frames"] == 2
    assert abs(tracks[-1]["u_ms"] - 10) < 3 and abs(tracks[-1]["v_ms"] - 6) < 3


def test_winds(radials):
    low = volumes.wind_profiles(radials).filter("height_m < 1000").collect()
    assert low and all(abs(r["v_ms"] - 10) < 5 for r in low)


def test_every_result_leaves_one_pass(radials):
    kinds = {r["kind"]: r["n"] for r in volumes.analysed(radials).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert {"field", "product", "cell", "wind_profile", "melting_layer", "hydrometeor"} <= set(kinds) <= set(volumes.KINDS) and kinds["melting_layer"] == 2
    fields = {r["field"] for r in volumes.derived_fields(radials).select("field").distinct().collect()}
    assert fields == set(volumes.DERIVED)


def test_volumes_are_unfolded_once(radials):
    rows = radials.toPandas().sort_values("scan_time").assign(block=0, leads=False)
    calls = []
    taken = volumes.unfold
    volumes.unfold = lambda sweeps, prior=None: calls.append(prior is not None) or taken(sweeps, prior)
    try:
        for icao, at, volume, sweeps, wind in volumes.chained(iter([rows[:500], rows[500:]])):
            assert icao == "KTST"
            assert {k for k, _ in volumes.analyse(sweeps, wind, None, None, at, set(volumes.KINDS))} >= {"field", "product", "cell", "wind_profile"}
    finally:
        volumes.unfold = taken
    assert calls == [False, True]


def test_two_sites_at_one_second_count_their_own_gates(radials):
    one = radials.filter(F.col("scan_time") == F.timestamp_millis(F.lit(T0)))
    both = one.unionByName(one.withColumn("icao", F.lit("KTWO")))
    counts = {(r["icao"], r["elevation_number"], r["code"]): r["n_gates"] for r in volumes.hydrometeor_counts(both).collect()}
    assert counts and {k[0] for k in counts} == {"KTST", "KTWO"}
    assert all(counts["KTWO", *k[1:]] == n for k, n in counts.items())
    assert sum(n for k, n in counts.items() if k[0] == "KTST") == volumes.hydrometeor_counts(one).agg(F.sum("n_gates")).first()[0]


def _sweep(n_ref, n_dual, **more):
    rng = np.random.default_rng(5)
    n_az = 360
    fields = {"REF": np.full((n_az, n_ref), 35.0), "ZDR": np.full((n_az, n_dual), 1.0), "RHO": np.full((n_az, n_dual), 0.99), "PHI": np.tile(np.mod(100 + 1.0 * np.arange(n_dual), 360), (n_az, 1))}
    fields |= {k: np.full((n_az, n_dual), v) for k, v in more.items()}
    fields["REF"] += rng.normal(0, 0.1, fields["REF"].shape)
    return {"number": 1, "elevation": 0.5, "n_az": n_az, "nyquist": 20.0, "n_rays": n_az, "fields": fields, "geometry": {"REF": (2125.0, 250.0), **{k: (2250.0, 250.0) for k in fields if k != "REF"}}}


def test_moments_of_unequal_gates_meet_at_equal_range():
    sweep = _sweep(1832, 1192)
    sweep["fields"]["REF"] = np.tile(np.arange(1832.0) / 100 + 20, (360, 1))
    volumes.add_derived([sweep])
    variables, layer, valid = volumes.dual_polarisation(sweep, 3000.0, 3600.0)
    assert variables["z"].shape == (360, 1192) and valid[:, 5:-5].all() and layer[0, 0] == 0 and layer[0, -1] == 2
    # gate g of ZDR lies half a gate beyond gate g of REF: the nearest is g + 1
    assert abs(variables["z"][0, 100] - (20 + 101 / 100)) < 1e-9
    volumes.add_hydrometeors([sweep], 3000.0, 3600.0)
    volumes.add_hydrometeors([_sweep(60, 40), _sweep(40, 60)], 3000.0, 3600.0)
    assert np.isfinite(sweep["fields"]["HCA"]).sum() == valid.sum()


def test_phase_texture_of_a_ramp_is_taken_about_the_centre():
    # a slope of 10 degrees a gate through a turn: nine gates at -40 to 40 degrees from the centre
    ramp = np.mod(300.0 + 10 * np.arange(40), 360)[None]
    got = volumes._phase_texture(ramp, 4)
    assert np.abs(got[0, 4:-4] - np.sqrt(600 * 10 / 9)).max() < 1e-9
    ramp[0, 12] = np.nan
    assert np.isnan(volumes._phase_texture(ramp, 4)[0, 12])


def test_melting_layer_is_detected_or_the_climates():
    at = pd.Timestamp("2024-07-23 12:00")
    bottom, top, source, n = volumes.melting_layer_of([_sweep(60, 40)], 35.0, 370.0, at)
    assert (source, n, top - bottom) == ("climatology", 0, 600.0) and abs(top - (5900 - 75 * 35 + 1400 - 370)) < 5
    assert volumes.melting_layer_of([_sweep(60, 40)], None, None, at) is None
    assert volumes.melting_layer_of([], -35.0, 0.0, at)[1] < top
    band = _sweep(400, 400, ZDR=1.5, RHO=0.95)
    band["elevation"] = 4.0
    slant = 2250 + 250.0 * np.arange(400)
    height = volumes.winds.beam_height(slant, 4.0)
    band["fields"]["RHO"][:, (height < 2500) | (height > 2900)] = 0.99
    bottom, top, source, n = volumes.melting_layer_of([band], 35.0, 370.0, at)
    assert source == "detected" and n == 360 * int(((height >= 2500) & (height <= 2900)).sum()) and 2500 <= bottom < top <= 2900


def test_classes_follow_the_melting_layer():
    sweep = _sweep(400, 400, ZDR=0.2)
    sweep["elevation"] = 2.0
    volumes.add_hydrometeors([sweep], 20_000.0, 21_000.0)
    below = set(np.unique(sweep["fields"]["HCA"][np.isfinite(sweep["fields"]["HCA"])]))
    volumes.add_hydrometeors([sweep], -2000.0, -1000.0)
    above = set(np.unique(sweep["fields"]["HCA"][np.isfinite(sweep["fields"]["HCA"])]))
    code = {n: i + 1 for i, n in enumerate(hydrometeors.CLASSES)}
    assert below <= {code[n] for n in hydrometeors.ALLOWED["below"]} | {11} and above <= {code[n] for n in hydrometeors.ALLOWED["above"]} | {11} and code["DS"] in above


def test_chains_run_through_midnight_and_blocks(spark):
    files = [(f"K_{k}", level2.write_volume(level2.storm_scene(time_ms=T0 + k * 300_000, sweeps=(0.5, 1.5, 3.0, 5.0, 7.5)))) for k in range(3)]
    rows = volumes.decode(spark.createDataFrame(files, "path string, content binary")).withColumn("scan_time", F.expr("scan_time + INTERVAL 113 MINUTES")).cache()  # 23:53, 23:58 and 00:03
    assert rows.select(F.to_date("scan_time")).distinct().count() == 2
    tracks = volumes.cell_tracks(volumes.cells(rows)).orderBy("scan_time", "track_id").collect()
    assert tracks[0]["track_id"] == tracks[-1]["track_id"] == 1 and [t["n_frames"] for t in tracks] == [1, 2, 3] and tracks[-1]["u_ms"] is not None
    dealt = volumes.blocks(rows).groupBy("block", "leads").agg(F.countDistinct("scan_time").alias("n")).orderBy("block", "leads").collect()
    assert [(r["leads"], r["n"]) for r in dealt] == [(False, 2), (False, 1), (True, 2)]
    # as one block the third volume's prior is the second's, unfolded against the first's: here the blocks agree
    order = ("scan_time", "field", "elevation_number", "az_bin")
    cut, whole = (volumes.derived_fields(rows.filter("elevation_number <= 2")).orderBy(*order).collect() if b is None else volumes.of_kind(volumes.analysed(rows.filter("elevation_number <= 2"), ("field",), b), "field").orderBy(*order).collect() for b in (None, 86_400 * 400))
    assert cut == whole
    at = lambda text: pd.Timestamp(text)
    cells = pd.DataFrame([("KA", at("2024-05-01 23:58"), 0, 0.0, 0.0), ("KA", at("2024-05-02 00:03"), 0, 1.0, 0.0), ("KA", at("2024-05-02 00:24"), 0, 1.0, 0.0), ("KB", at("2024-05-02 00:25"), 0, 1.0, 0.0)], columns=["icao", "scan_time", "rank", "x_km", "y_km"])
    got = volumes.cell_tracks(spark.createDataFrame(cells)).orderBy("icao", "scan_time").collect()
    assert [(t["track_id"], t["n_frames"]) for t in got] == [(1, 1), (1, 2), (2, 1), (1, 1)]

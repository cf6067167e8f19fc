"""Buckets, the real-time ring, the store, overlays and streams."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlake.functions import times
from stormlake.operators import volumes
from stormlake.sources import bucket, level2, store
from stormlake.streaming import live

T0 = 1_714_600_800_000


@pytest.fixture()
def archive(tmp_path):
    for name in ("2024/05/01/KTST/KTST20240501_220000_V06", "2024/05/01/KTST/KTST20240501_220500_V06", "2024/05/01/KTST/KTST20240501_220500_V06_MDM", "2024/05/02/KTST/KTST20240502_000100_V06", "2024/05/02/KTST/readme"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    return bucket.FolderBucket(str(tmp_path))


def at(*x):
    return datetime(2024, 5, *x, tzinfo=UTC)


def test_key_selection(archive):
    short = lambda keys: [k[-11:-4] for k in keys]
    assert short(bucket.list_keys(archive, "KTST", at(1))) == ["_220000"[0:7], "_220500"]
    assert bucket.latest_key(archive, "KTST", at(3)).endswith("000100_V06") and bucket.latest_key(archive, "KTST", at(4)) is None
    assert bucket.key_at(archive, "KTST", at(2, 0, 0)).endswith("220500_V06") and bucket.key_at(archive, "KTST", at(1, 1)) is None
    assert len(bucket.keys_between(archive, "KTST", at(1, 22, 5), at(2, 0, 1))) == 2
    assert len(bucket.resolve_keys(archive, "KTST", at(3), start=at(1), end=at(2))) == 2
    with pytest.raises(ValueError):
        bucket.resolve_keys(archive, "KTST", at(3), start=at(1))
    assert bucket.parse_listing('<L xmlns="x"><Contents><Key>a&amp;b</Key></Contents></L>') == ["a&b"]


def test_download_is_cached(archive, tmp_path):
    key = bucket.latest_key(archive, "KTST", at(3))
    path = bucket.download(archive, key, str(tmp_path / "raw"))
    path.write_bytes(b"kept")
    assert bucket.download(archive, key, str(tmp_path / "raw")).read_bytes() == b"kept"


class Ring:
    def __init__(self, newest, filled=999):
        self.keys, self.asked = {}, 0
        for back in range(filled):
            slot = (newest - 1 - back) % 999 + 1
            t = datetime.fromtimestamp(T0 / 1000 - back * 300, UTC)
            self.keys[slot] = [f"KTST/{slot}/{t:%Y%m%d-%H%M%S}-001-S"]

    def list(self, prefix):
        self.asked += 1
        return self.keys.get(int(prefix.split("/")[1]), [])


@pytest.mark.parametrize("newest", [1, 2, 500, 998, 999])
def test_ring_search(newest):
    ring = Ring(newest)
    assert bucket.find_latest_volume(ring, "KTST") == newest and ring.asked <= 20
    ring.asked = 0
    known = (newest - 4) % 999 + 1
    assert bucket.find_latest_volume_from(ring, "KTST", known, bucket.volume_time(ring, "KTST", known), datetime.fromtimestamp(T0 / 1000, UTC)) == newest and ring.asked <= 8


def test_chunks_of_the_newest_stamp(tmp_path):
    for name in ("20240501-220000-001-S", "20240501-220000-010-I", "20240501-220000-002-I", "20240430-100000-099-E"):
        path = tmp_path / "KTST/7" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
    found = bucket.list_chunks(bucket.FolderBucket(str(tmp_path)), "KTST", 7)
    assert [bucket.chunk_number(k) for k in found] == [1, 2, 10]
    assert bucket.list_chunks(bucket.FolderBucket(str(tmp_path)), "KTST", 7, at(2)) == [] and bucket.next_volume(999) == 1


def test_bucket_source(spark, tmp_path):
    raw = level2.write_volume(level2.storm_scene(sweeps=(1.5,), gates=10))
    path = tmp_path / "2024/05/01/KTST/KTST20240501_220000_V06"
    path.parent.mkdir(parents=True)
    path.write_bytes(raw)
    spark.dataSource.register(bucket.RadarBucket)
    rows = spark.read.format("radar_bucket").option("path", str(tmp_path)).load()
    assert [(r["site"], len(r["content"])) for r in rows.collect()] == [("KTST", len(raw))]
    assert volumes.decode(rows.select(F.col("key").alias("path"), "content")).filter("field = 'VEL'").count() == 360


def test_store_replaces_a_provisional_volume(spark, tmp_path):
    path = str(tmp_path / "raw")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a").write_bytes(level2.write_volume(level2.storm_scene(sweeps=(1.5,), gates=10)))
    radials = volumes.read_archive(spark, path)
    write = lambda rows, provisional: store.write_volumes(rows, store.scan_rows(rows, provisional), str(tmp_path / "out"))
    write(radials.filter("azimuth < 90"), True)
    write(radials, False)
    index = store.read_index(spark, str(tmp_path / "out"))
    row = index.first()
    assert index.count() == 1 and not row["provisional"] and row["n_sweeps"] == 1 and row["fields"] == ["PHI", "REF", "RHO", "VEL", "ZDR"]
    field = store.read_field(spark, str(tmp_path / "out"), "VEL")
    assert field.count() == 360 and "PushedFilters: [IsNotNull(field), EqualTo(field,VEL)]" in field._jdf.queryExecution().toString()
    keys = spark.createDataFrame([(row["name"],), ("KTST_20240501_230000",)], "name string")
    assert [r["name"] for r in store.not_stored(keys, index).collect()] == ["KTST_20240501_230000"]


def test_half_floats():
    grid = np.array([[1.5, -1000], [-2000, 0.1]], np.float32)
    assert np.allclose(store.from_half(2, 2, store.to_half(grid)), grid, atol=1e-3) and store.from_half(2, 3, b"xx") is None


def test_polygons_and_borders(spark):
    square = lambda x, n: [[x, 0], [x + n, 0], [x + n, n], [x, n], [x, 0]]
    text = json.dumps({"features": [{"properties": {"kind": "TO"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 4), square(1, 1)]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(4, 4)], [square(9, 1)]]}}]})
    found = store.polygons(spark.createDataFrame([(1, text), (2, "not json"), (3, None)], "doc_id int, text string")).collect()
    assert [(r["feature"], len(r["outer"]), len(r["holes"])) for r in found] == [(0, 5, 1), (1, 5, 0), (1, 5, 0)]
    rings = spark.createDataFrame([(i, k, float(x), float(y)) for i, ring in enumerate([square(0, 4), square(4, 4)]) for k, (x, y) in enumerate(ring)], "ring_id int, seq int, x double, y double")
    assert store.border_segments(rings).count() == 7


def test_windows_and_iso_times():
    now = 1_714_600_800
    parse = times.TimeWindow.parse
    assert parse("live:90", now) == times.TimeWindow(now - 5400, None, 90) and parse("live:0", now) is None
    assert parse("2024-05-01T22:00Z", now) == times.TimeWindow(now - 1800, now + 1800)
    assert parse("2024-05-01T22:00:00Z/2024-05-01T21:00:00Z", now) is None and parse("2024-02-31/2024-03-01", now) is None
    fixed = times.TimeWindow.fixed(now, now + 60)
    assert fixed.contains(now + 60) and not fixed.contains(now + 61) and fixed.clip(times.TimeWindow.live(now + 30, 1)) == times.TimeWindow(now, now + 60)
    assert parse(fixed.option(), now) == fixed and times.TimeWindow.live(now).tick(now + 5).start == now + 5 - 3600
    assert times.parse_iso("2024-05-01T22:00:00.5+02:00") == datetime(2024, 5, 1, 20, 0, 0, 500_000, UTC)
    assert times.request_key("at", "ktst", at="2024-05-01T22:00Z") == times.request_key("at", "KTST", at="2024-05-01T22:00:00+00:00")
    assert times.TimeWindow.of_request(now, start="2024-05-01") is None


def run_stream(frame, spark, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_growing_volume(spark, tmp_path):
    raw = level2.write_volume(level2.storm_scene(sweeps=(1.5,), gates=10), record=120)
    cuts = [0, 24, len(raw) // 2, len(raw)]
    parts = [(chr(83 if n == 1 else 69 if n == 3 else 73), raw[cuts[n - 1] : cuts[n]]) for n in (1, 2, 3)]
    rows = [("KTST", "20240501-220000", n, kind, content) for n, (kind, content) in enumerate(parts, 1)]
    rows += [("KTST", "20240430-100000", 50, "E", b"old"), ("KJON", "20240501-220000", 5, "I", b"joined late")]
    shape = "site string, stamp string, number int, kind string, content binary"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run_stream(live.growing_volumes(spark.readStream.schema(shape).parquet(str(tmp_path / "in"))), spark, "growing").collect()
    assert [(r["icao"], r["n_chunks"], r["n_radials"], r["complete"]) for r in got] == [("KTST", 3, 360, True)]


def test_stream_tracks_equal_batch(spark, tmp_path):
    shape = "site string, time_s long, x_km double, y_km double"
    rows = [("A", t * 300, 10.0 + 3 * t, 5.0) for t in range(4)] + [("A", t * 300, 60.0 - 2 * t, 40.0) for t in range(4)] + [("A", 9000, 20.0, 5.0)]
    for k in range(2):
        spark.createDataFrame([r for r in rows if (r[1] > 300) == bool(k)], shape).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(shape + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["time_s"], r["track_id"], r["n_frames"]) for r in run_stream(live.track_cells(stream), spark, "tracks").collect())
    assert got[:8] == [(t * 300, i, t + 1) for t in range(4) for i in (1, 2)] and got[8] == (9000, 3, 1)


def test_sessions(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [("A", datetime.fromtimestamp(base.timestamp() + s)) for s in (0, 1800, 3600, 9000, 90_000)]
    spark.createDataFrame(rows, "site string, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    got = run_stream(live.sessions(stream), spark, "loops", "append").orderBy("first").collect()
    assert [r["n_scans"] for r in got] == [3, 1]
    hours = run_stream(live.hour_buckets(stream), spark, "hours", "append").collect()
    assert sum(r["n_scans"] for r in hours) == 4


def test_dimensions(spark):
    from stormlake.functions import dimensions

    lat, lon, height = dimensions.location("KTLX")
    assert abs(lat - 35.3334) < 1e-3 and abs(lon + 97.2778) < 1e-3 and abs(height - 390) < 5 and dimensions.location("KXXX") is None
    assert dimensions.sites(spark).count() > 150 and dimensions.events(spark).filter("peak_time BETWEEN from_time AND to_time").count() == dimensions.events(spark).count() == 16
    scans = spark.createDataFrame([("KTLX", datetime(1999, 5, 4, 0, m), f"n{m}") for m in (0, 4, 7)] + [("KTLX", datetime(2001, 1, 1), "other")], "icao string, scan_time timestamp, name string")
    assert [(r["name"], r["at_peak"]) for r in dimensions.event_scans(scans, dimensions.events(spark)).orderBy("name").collect()] == [("n0", False), ("n4", True), ("n7", False)]
    blank = spark.createDataFrame([("KTLX", None, None, None)], "icao string, lat double, lon double, height_m double")
    assert volumes.with_site(blank, dimensions.sites(spark)).first()["height_m"] == height

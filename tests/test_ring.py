"""The ring as a stream: sites that grow side by side, late chunks, wraps, restarts, listings, and what comes of it."""

from __future__ import annotations

import threading
import time
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from stormlake.sources import bucket, level2, ring
from stormlake.streaming import live

NOW = datetime.now(UTC).replace(microsecond=0)


def stamp(minutes):
    return f"{NOW - timedelta(minutes=minutes):%Y%m%d-%H%M%S}"


class Shelf:
    """A bucket in memory that counts its listings."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def put(self, site, slot, minutes, number, kind="I", content=b"x"):
        self.held[f"{site}/{slot}/{stamp(minutes)}-{number:03d}-{kind}"] = content

    def list(self, prefix):
        self.asked += 1
        return sorted(k for k in self.held if k.startswith(prefix))

    def get(self, key):
        return self.held[key]


def reader(shelf, sites="KAAA,KBBB"):
    made = ring.RingReader({"path": "/none", "sites": sites})
    made.bucket = shelf
    return made


def poll(made, start):
    end = made.latestOffset()
    return end, [r[0] for p in made.partitions(start, end) for r in made.read(p)]


def test_two_sites_lose_nothing():
    shelf = Shelf()
    made = reader(shelf)
    shelf.put("KAAA", 7, 12, 1, "S")
    shelf.put("KBBB", 400, 10, 1, "S")
    shelf.put("KBBB", 400, 9000, 9, "E")  # of an earlier trip
    at, first = poll(made, {})
    assert [k.split("/")[0] for k in first] == ["KAAA", "KBBB"]
    shelf.put("KAAA", 7, 12, 2)
    shelf.put("KAAA", 7, 12, 3)
    at, second = poll(made, at)
    assert [k[-5:] for k in second] == ["002-I", "003-I"] and {k[:4] for k in second} == {"KAAA"}
    assert poll(made, at)[1] == []


def test_gaps_are_waited_for():
    shelf = Shelf()
    made = reader(shelf, "KAAA")
    shelf.put("KAAA", 999, 12, 1, "S")
    shelf.put("KAAA", 999, 12, 3)
    at, got = poll(made, {})
    assert [k[-5:] for k in got] == ["001-S"]
    # the next volume has begun, beyond the wrap, while a chunk is missing
    shelf.put("KAAA", 1, 6, 1, "S")
    at, got = poll(made, at)
    assert got == []
    shelf.put("KAAA", 999, 12, 2)
    at, got = poll(made, at)
    assert [k[-5:] for k in got] == ["002-I", "003-I"]
    shelf.put("KAAA", 999, 12, 4, "E")
    at, got = poll(made, at)
    assert [k.split("/", 1)[1] for k in got] == [f"999/{stamp(12)}-004-E", f"1/{stamp(6)}-001-S"]
    # two newer volumes: what came of this one is all there will be
    shelf.put("KAAA", 1, 6, 3)
    at, got = poll(made, at)
    assert got == []
    shelf.put("KAAA", 2, 4, 1, "S")
    shelf.put("KAAA", 2, 4, 2, "E")
    shelf.put("KAAA", 3, 1, 1, "S")
    at, got = poll(made, at)
    assert [k.split("/", 1)[1] for k in got] == [f"1/{stamp(6)}-003-I", f"2/{stamp(4)}-001-S", f"2/{stamp(4)}-002-E", f"3/{stamp(1)}-001-S"]


def full_ring(newest):
    """A full ring, the newest volume at a slot, one each five minutes."""
    shelf = Shelf()
    for k in range(999):
        shelf.put("KAAA", (newest - 1 - k) % 999 + 1, 5 * k + 1, 1, "S")
        shelf.put("KAAA", (newest - 1 - k) % 999 + 1, 5 * k + 1, 2, "E")
    return shelf


@pytest.mark.parametrize("newest", [1, 57, 437, 999])
def test_listings(newest):
    shelf = full_ring(newest)
    made = reader(shelf, "KAAA")
    at, got = poll(made, {})
    assert at["KAAA"]["slot"] == newest and len(got) == 2
    shelf.asked = 0
    made.at = {}
    made.latestOffset()
    assert shelf.asked <= 20
    shelf.asked = 0
    made.latestOffset()
    assert shelf.asked <= 8
    # from a volume of half an hour ago
    old = (newest - 7) % 999 + 1
    made.at = {"KAAA": {"slot": old, "stamp": stamp(31), "chunk": 1}}
    shelf.asked = 0
    assert made.latestOffset()["KAAA"]["slot"] == newest and shelf.asked <= 8


def test_a_restart_goes_on_from_its_checkpoint():
    shelf = full_ring(3)
    then = {"KAAA": {"slot": 998, "stamp": stamp(21), "chunk": 1}}
    end, got = poll(reader(shelf, "KAAA"), then)
    assert [k.split("/")[1] for k in got] == ["998", "999", "999", "1", "1", "2", "2", "3", "3"] and got[0].endswith("-002-E")
    # planned again from the same offsets, later: the same chunks
    shelf.put("KAAA", 4, 0, 1, "S")
    again = reader(shelf, "KAAA")
    assert [r[0] for p in again.partitions(then, end) for r in again.read(p)] == got


def _write(root, site, slot, minutes, number, kind, content):
    path = Path(root) / f"{site}/{slot}/{stamp(minutes)}-{number:03d}-{kind}"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.with_name("." + path.name).write_bytes(content)
    path.with_name("." + path.name).rename(path)


def _parts(minutes, icao):
    at = int((NOW - timedelta(minutes=minutes)).timestamp() * 1000)
    raw = level2.write_volume(level2.storm_scene(icao=icao, time_ms=at, sweeps=(1.5, 3.0, 5.0)), record=120)
    return [raw[:24], raw[24 : len(raw) // 2], raw[len(raw) // 2 :]]


def _run(stream, path, mark):
    query = stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(processingTime="0 seconds").start(path)
    last = time.time() + 90
    while time.time() < last:
        query.processAllAvailable()
        break
    query.stop()


def test_from_ring_to_winds(spark, tmp_path):
    spark.dataSource.register(bucket.RadarBucket)
    root, out, mark = str(tmp_path / "ring"), str(tmp_path / "grown"), str(tmp_path / "mark")
    a, b = _parts(10, "KAAA"), _parts(8, "KBBB")
    chunks = lambda: live.chunk_rows(spark.readStream.format("radar_bucket").option("path", root).option("sites", "KAAA,KBBB").load())
    _write(root, "KAAA", 5, 10, 1, "S", a[0])
    _write(root, "KAAA", 5, 10, 2, "I", a[1])
    _write(root, "KBBB", 9, 8, 1, "S", b[0])
    _run(live.growing_volumes(chunks()), out, mark)
    _write(root, "KAAA", 5, 10, 3, "E", a[2])
    _write(root, "KBBB", 9, 8, 2, "I", b[1])
    _write(root, "KBBB", 9, 8, 3, "E", b[2])
    _run(live.growing_volumes(chunks()), out, mark)
    grown = spark.read.parquet(out)
    ended = {r["icao"]: r for r in grown.filter("complete").collect()}
    assert set(ended) == {"KAAA", "KBBB"} and all(r["n_chunks"] == 3 and r["n_radials"] == 1080 for r in ended.values())
    assert bytes(ended["KAAA"]["content"]) == b"".join(a) and ended["KBBB"]["time_s"] == int((NOW - timedelta(minutes=8)).timestamp())
    assert grown.groupBy("icao", "n_chunks").count().filter("count > 1").count() == 0
    files = spark.readStream.schema(grown.schema).parquet(out).select(F.col("icao").alias("site"), "time_s", "complete", "content")
    _run(live.chain_volumes(files), str(tmp_path / "winds"), str(tmp_path / "mark2"))
    winds = spark.read.parquet(str(tmp_path / "winds"))
    assert {r["icao"] for r in winds.filter("complete").select("icao").distinct().collect()} == {"KAAA", "KBBB"}


def test_archive_over_http(spark, tmp_path):
    raw = level2.write_volume(level2.storm_scene(sweeps=(1.5,), gates=10))
    keys = {"2024/05/01/KTST/KTST20240501_220000_V06": raw, "2024/05/01/KTST/KTST20240501_220000_V06_MDM": b"", "2024/05/02/KTST/KTST20240502_000000_V06": b"other day"}

    class Store(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = urlparse(self.path)
            if asked.query:
                prefix = parse_qs(asked.query)["prefix"][0] if "prefix=" in asked.query and parse_qs(asked.query).get("prefix") else ""
                body = ("<List>" + "".join(f"<Contents><Key>{k}</Key></Contents>" for k in keys if k.startswith(prefix)) + "</List>").encode()
            else:
                body = keys[unquote(asked.path[1:])]
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(bucket.RadarBucket)
        rows = spark.read.format("radar_bucket").options(url=f"http://127.0.0.1:{server.server_port}", site="KTST", day="2024-05-01").load().collect()
        assert [(r["site"], bytes(r["content"]) == raw) for r in rows] == [("KTST", True)]
    finally:
        server.shutdown()

"""What views show, options, buckets over HTTP, cities and the live chain."""

from __future__ import annotations

import json
import random
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from stormlake import options
from stormlake.functions import dimensions
from stormlake.operators import texts
from stormlake.sources import bucket, level2, store
from stormlake.streaming import live


def test_declutter_against_brute_force(spark):
    rng = random.Random(3)
    views = []
    for k in range(20):
        boxes = [(i, x, y, x + 4.0, y + 1.0) for i, (x, y) in enumerate((rng.uniform(0, 30), rng.uniform(0, 12)) for _ in range(rng.randint(0, 60)))]
        rng.shuffle(boxes)
        views.append((k, boxes))
    frame = spark.createDataFrame(views, "view int, labels array<struct<rank:bigint,x0:double,y0:double,x1:double,y1:double>>")
    for r in frame.select("view", texts.declutter(F.col("labels"), 15).alias("shown")).collect():
        want = []
        for b in sorted(views[r["view"]][1]):
            if len(want) < 15 and not any(b[1] < o[3] and o[1] < b[3] and b[2] < o[4] and o[2] < b[4] for o in want):
                want.append(b)
        assert [tuple(x) for x in r["shown"]] == want


def test_texts_of_sentinels_and_corners(spark):
    row = spark.range(1).select(
        texts.value_text(F.lit("REF"), F.lit(-2000.0)).alias("folded"), texts.value_text(F.lit("VEL"), F.lit(-1000.0)).alias("none"), texts.value_text(F.lit("HCA"), F.lit(10.0)).alias("hail"),
        texts.cone_readout(F.lit("REF"), F.lit(41.5), F.lit(0.5), texts.place_text(F.lit("KTST"), F.lit(30.0), F.lit(359.6)), F.lit(0.31), F.lit(-35.0), F.lit(97.0)).alias("cone"),
        texts.request_key(F.lit(" ktst "), F.lit(""), F.lit("2024-05-01T22:00Z"), F.lit("")).alias("half"), texts.request_key(F.lit("KTST"), F.lit("soon"), F.lit(None), F.lit(None)).alias("other"),
    ).first()
    assert (row["folded"], row["none"], row["hail"]) == ("range folded", "no data", "rain / hail (RH)")
    assert row["cone"] == "REF  41.5 dBZ   tilt 0.50°\nKTST  30.0 km @ 000°   beam 0.31 km ARL\n35.000°S  97.000°E"
    assert (row["half"], row["other"]) == ("update KTST newest", "update KTST at soon")


def test_options():
    got = options.selection(["ktlx", "--from", "2013-05-20T19:30Z", "--to", "2013-05-20T20:30:00Z"])
    assert got.site == "KTLX" and got.at is None and (got.end - got.start).total_seconds() == 3600
    assert options.following(["ktlx", "KINX", "--since-minutes", "100000"]) == (["KTLX", "KINX"], 5.0, 1440)
    for wrong in (["--at", "2013"], ["KTLX", "--at"], ["KTLX", "--at", "2013-13-01"], ["KTLX", "--other", "1"]):
        with pytest.raises(ValueError):
            options.selection(wrong)
    for wrong in ([], ["KTLX", "--since-minutes", "1.5"], ["KTLX", "--interval", "x"]):
        with pytest.raises(ValueError):
            options.following(wrong)


def test_first_site_and_context():
    assert dimensions.startup_site("KXXX", "KXXX", []) == "KXXX" and dimensions.startup_site("", "KTLX", []) == "KTLX" and dimensions.startup_site("KTLX", "KXXX", []) == "" and dimensions.startup_site(None, "", []) == ""
    now, then = datetime(2024, 1, 1, tzinfo=UTC), datetime(2020, 1, 1, tzinfo=UTC)
    assert dimensions.view_context("a", then, (35.0, -97.0), False, now) == (then, (35.0, -97.0)) and dimensions.view_context(None, None, None, True, now) == (now, dimensions.CENTER) and dimensions.view_context(None, None, None, False, now) is None


def test_bucket_over_http():
    objects = {f"2024/05/01/KTST/KTST20240501_{h:02d}0000_V06": bytes([h]) for h in range(5)} | {"2024/05/01/KTST/KTST20240501_000000_V06_MDM": b"", "odd & name": b"x"}

    class Store(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            if url.path == "/":
                asked = {k: v[0] for k, v in parse_qs(url.query).items()}
                found = sorted(k for k in objects if k.startswith(asked.get("prefix", "")))
                at = int(asked.get("continuation-token", 0))
                more = f"<NextContinuationToken>{at + 2}</NextContinuationToken>" if at + 2 < len(found) else ""
                body = ("<ListBucketResult>" + "".join(f"<Contents><Key>{k.replace('&', '&amp;')}</Key></Contents>" for k in found[at : at + 2]) + more + "</ListBucketResult>").encode()
            else:
                from urllib.parse import unquote

                body = objects[unquote(url.path[1:])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        over = bucket.HttpBucket(f"http://127.0.0.1:{server.server_port}")
        keys = bucket.list_keys(over, "KTST", datetime(2024, 5, 1, tzinfo=UTC))
        assert len(keys) == 5 and over.get(keys[3]) == b"\x03" and over.get("odd & name") == b"x" and over.list("nothing") == []
        assert bucket.key_at(over, "KTST", datetime(2024, 5, 1, 2, 30, tzinfo=UTC)).endswith("020000_V06")
    finally:
        server.shutdown()


def test_cities(spark):
    point = lambda name, lon, lat, n: {"properties": {"name": name, "pop_max": n}, "geometry": {"type": "Point", "coordinates": [lon, lat]}}
    text = json.dumps({"features": [point("small", -97.0, 35.0, 10), point("large", -98.0, 36.0, 900), {"properties": {"name": "line"}, "geometry": {"type": "LineString", "coordinates": []}}]})
    got = store.cities(spark.createDataFrame([(text,), ("torn",)], "text string"), 5).collect()
    assert [tuple(r) for r in got] == [("large", 36.0, -98.0, 900), ("small", 35.0, -97.0, 10)]


def test_live_chain(spark, tmp_path):
    t0 = 1_714_600_800
    made = lambda dt: level2.write_volume(level2.storm_scene(time_ms=(t0 + dt) * 1000, sweeps=(1.5, 3.0, 5.0)))
    rows = [("KTST", t0 + dt, dt != 300, made(dt)) for dt in (0, 300, 600, 600, 2000)] + [("KTST", t0 + 2100, True, b"torn")]
    shape = "site string, time_s long, complete boolean, content binary"
    for k in range(2):
        spark.createDataFrame([r for r in rows if (r[1] > t0 + 300) == bool(k)], shape).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(shape + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.chain_volumes(stream).writeStream.format("memory").queryName("chain").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["time_s"] - t0, r["complete"], r["chained"]): r["n"] for r in spark.table("chain").groupBy("time_s", "complete", "chained").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {(0, True, False), (300, False, True), (600, True, True), (2000, True, False)} and len(set(got.values())) <= 3

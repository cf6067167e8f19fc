"""The rolling window evicts by the clock, without new input."""

from __future__ import annotations

import time

from stormlake.streaming import live


def test_scans_leave_without_input(spark, tmp_path):
    shape = "site string, name string, time_s long"
    now = int(time.time())
    put = lambda rows: spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("A", "old", now - 500), ("A", "a1", now - 45), ("A", "a2", now + 600), ("B", "b1", now - 43)])
    query = live.rolling_window(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), 1).writeStream.format("memory").queryName("moves").outputMode("append").trigger(processingTime="1 second").start()
    try:
        seen = lambda: sorted((r["site"], r["name"], r["change"]) for r in spark.table("moves").collect())
        def wait(what):
            last = time.time() + 60
            while time.time() < last and what not in seen():
                time.sleep(0.5)

        # nothing more comes in, but the clock goes on
        wait(("B", "b1", "out"))
        first = [("A", "a1", "in"), ("A", "a1", "out"), ("A", "a2", "in"), ("B", "b1", "in"), ("B", "b1", "out")]
        assert seen() == first
        put([("A", "a2", now + 600), ("A", "late", now - 300), ("B", "b2", now + 600)])
        wait(("B", "b2", "in"))
        assert seen() == sorted([*first, ("B", "b2", "in")])
    finally:
        query.stop()

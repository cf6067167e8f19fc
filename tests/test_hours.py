"""Hourly documents: only hours asked for are read, and only those due are fetched again."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stormlake.sources import hours

DAY = datetime(2024, 5, 1, tzinfo=UTC)


def put(root, hour, text):
    path = root / f"{hour:%Y/%m/%d/%H}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def pushdown(spark):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    yield
    spark.conf.set(name, before)


def test_filters_spare_hours(spark, tmp_path, pushdown):
    for h in range(24):
        put(tmp_path, DAY + timedelta(hours=h), f"document {h}")
    spark.dataSource.register(hours.HourlyDocuments)
    rows = spark.read.format("hourly_documents").options(path=str(tmp_path), **{"from": DAY.isoformat(), "to": (DAY + timedelta(days=1)).isoformat()}).load()
    assert rows.rdd.getNumPartitions() == 24
    at = lambda h: F.timestamp_seconds(F.lit(int((DAY + timedelta(hours=h)).timestamp())))
    some = rows.filter((F.col("hour") >= at(5)) & (F.col("hour") < at(8)))
    assert some.rdd.getNumPartitions() == 3 and sorted(r["text"] for r in some.collect()) == ["document 5", "document 6", "document 7"]
    assert [r["text"] for r in rows.filter(F.col("hour") == at(9)).collect()] == ["document 9"]
    assert rows.filter(F.col("hour").isin(DAY, DAY + timedelta(hours=3))).rdd.getNumPartitions() == 2
    assert rows.filter((F.col("hour") > at(20)) & (F.col("hour") <= at(22)) & F.col("text").contains("22")).count() == 1


def test_filters_by_reader(tmp_path):
    made = lambda: hours._HourReader({"path": str(tmp_path), "from": "2024-05-01T00:30:00", "to": "2024-05-01T06:00:00"})
    reader = made()
    assert [h.hour for h in reader.hours()] == [1, 2, 3, 4, 5]
    kept = list(reader.pushFilters([hours.GreaterThan(("hour",), DAY + timedelta(hours=2)), hours.In(("hour",), (DAY + timedelta(hours=4), DAY + timedelta(hours=9))), hours.EqualTo(("text",), "x")]))
    assert len(kept) == 3 and [h.hour for h in reader.hours()] == [4]
    reader = made()
    list(reader.pushFilters([hours.LessThanOrEqual(("hour",), DAY + timedelta(hours=2))]))
    assert [h.hour for h in reader.hours()] == [1, 2] and list(reader.read(None)) == []


def test_only_what_is_due_is_fetched(spark, tmp_path, pushdown):
    source, root = tmp_path / "source", str(tmp_path / "table")
    source.mkdir()
    put(source, DAY, "first")
    put(source, DAY + timedelta(hours=1), "second")
    end, options = DAY + timedelta(hours=3), {"path": str(source)}
    now = DAY + timedelta(hours=2, minutes=30)
    read = lambda at: {r["hour"].strftime("%H"): (r["text"], r["failed"]) for r in hours.update(spark, options, root, DAY, end, at).collect()}
    assert read(now) == {"00": ("first", False), "01": ("second", False), "02": (None, True)}
    # documents change, but only the hour that failed is due after a minute
    put(source, DAY, "changed")
    put(source, DAY + timedelta(hours=2), "third")
    assert hours.due(spark, root, DAY, end, now + timedelta(seconds=30)) == [] and hours.due(spark, root, DAY, end, now + timedelta(seconds=61)) == [DAY + timedelta(hours=2)]
    assert read(now + timedelta(seconds=61)) == {"00": ("first", False), "01": ("second", False), "02": ("third", False)}
    # the hour that still grows is due after two minutes; one that then can't be fetched keeps its text
    (source / f"{DAY + timedelta(hours=2):%Y/%m/%d/%H}.json").unlink()
    assert read(now + timedelta(seconds=190))["02"] == ("third", True)
    assert hours.due(spark, root, DAY, DAY, now) == []

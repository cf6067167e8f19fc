"""Documents that come by the hour (warnings, outlooks): a source that reads only the hours asked for, and a table of them that fetches what is due.

A bucket holds one GeoJSON document an hour at ``YYYY/MM/DD/HH.json``. ``spark.read.format("hourly_documents")`` has rows (hour, text, failed): an hour
without a document, or whose document can't be fetched, is one row with a null text and ``failed`` true.

Filters on ``hour`` are pushed down (with ``spark.sql.python.filterPushdown.enabled``): hours that they exclude aren't asked for. Each hour is a partition, read on an executor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stormlake.operators.texts import needs_fetch
from stormlake.sources.bucket import Bucket, bucket_of
from stormlake.sources.store import table

HOURS = "hour timestamp, text string, failed boolean"
STORED = "text string, failed boolean, fetched timestamp, hour timestamp"
_HOUR = timedelta(hours=1)


def _utc(at: datetime) -> datetime:
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def document_key(hour: datetime) -> str:
    return f"{_utc(hour):%Y/%m/%d/%H}.json"


class Hour(InputPartition):
    def __init__(self, hour: datetime):
        self.hour = hour


class _HourReader(DataSourceReader):
    """Options: path or url of the bucket, from and to: the first hour and the one after the last."""

    def __init__(self, options: dict[str, str]):
        self.bucket: Bucket = bucket_of(options)
        self.first, self.end = (_utc(datetime.fromisoformat(options[k])) for k in ("from", "to"))
        self.chosen: set[datetime] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if getattr(one, "attribute", None) != ("hour",):
                yield one
                continue
            # the filter is still applied to the rows: here it only spares hours
            yield one
            match one:
                case EqualTo():
                    self._only({_utc(one.value)})
                case In():
                    self._only({_utc(v) for v in one.value if v is not None})
                case GreaterThan() | GreaterThanOrEqual():
                    self.first = max(self.first, _utc(one.value))
                case LessThanOrEqual():
                    self.end = min(self.end, _utc(one.value) + timedelta(microseconds=1))
                case LessThan():
                    self.end = min(self.end, _utc(one.value))

    def _only(self, hours: set[datetime]) -> None:
        self.chosen = hours if self.chosen is None else self.chosen & hours

    def hours(self) -> list[datetime]:
        first = self.first.replace(minute=0, second=0, microsecond=0)
        first += _HOUR if first < self.first else timedelta()
        out = []
        while first < self.end:
            if self.chosen is None or first in self.chosen:
                out.append(first)
            first += _HOUR
        return out

    def partitions(self) -> list[InputPartition]:
        return [Hour(h) for h in self.hours()]

    def read(self, partition: Hour | None) -> Iterator[tuple]:
        if partition is None:
            return
        try:
            text = self.bucket.get(document_key(partition.hour)).decode()
        except (OSError, KeyError, UnicodeDecodeError):
            yield partition.hour, None, True
        else:
            yield partition.hour, text, False


class HourlyDocuments(DataSource):
    """``spark.read.format("hourly_documents").options(path=..., **{"from": ..., "to": ...})``."""

    @classmethod
    def name(cls) -> str:
        return "hourly_documents"

    def schema(self) -> str:
        return HOURS

    def reader(self, schema) -> DataSourceReader:
        return _HourReader(self.options)


def due(spark: SparkSession, root: str, first: datetime, end: datetime, now: datetime) -> list[datetime]:
    """Hours of [first, end) that the table at ``root`` is to fetch: never fetched, still growing and older than two minutes, or failed and
    older than one. As many as a range that someone looks at has."""
    seconds = lambda at: int(_utc(at).timestamp())
    asked = spark.range(seconds(first), seconds(end), 3600).select(F.timestamp_seconds("id").alias("hour"), F.col("id").alias("start"))
    held = table(spark, root)
    if held is None:
        held = spark.createDataFrame([], STORED)
    held = held.filter((F.col("hour") >= F.timestamp_seconds(F.lit(seconds(first)))) & (F.col("hour") < F.timestamp_seconds(F.lit(seconds(end)))))
    known = held.select(F.col("hour").cast("timestamp").alias("hour"), F.unix_timestamp("fetched").alias("fetched"), "failed").dropDuplicates(["hour"])
    met = asked.join(known, "hour", "left")
    rows = met.filter(needs_fetch(F.col("start"), F.col("fetched"), F.coalesce("failed", F.lit(False)), F.lit(seconds(now)))).orderBy("hour").select("start").collect()
    return [datetime.fromtimestamp(r["start"], UTC) for r in rows]


def update(spark: SparkSession, options: dict[str, str], root: str, first: datetime, end: datetime, now: datetime) -> DataFrame:
    """Bring the table at ``root`` (hour, text, failed, fetched; partitioned by hour) up to date for [first, end), and return that part of it. An hour
    that fails keeps the text that it had."""
    spark.dataSource.register(HourlyDocuments)
    hours = due(spark, root, first, end, now)
    if hours:
        said = {**options, "from": _utc(first).isoformat(), "to": _utc(end).isoformat()}
        new = spark.read.format("hourly_documents").options(**said).load().filter(F.col("hour").isin(hours))
        if (held := table(spark, root)) is not None:
            old = held.filter(F.col("hour").isin(hours)).select(F.col("hour").cast("timestamp").alias("hour"), F.col("text").alias("old"))
            new = new.join(old, "hour", "left").withColumn("text", F.coalesce("text", "old")).drop("old")
        new = new.withColumn("fetched", F.timestamp_seconds(F.lit(int(_utc(now).timestamp()))))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(root)
    lo, hi = (F.timestamp_seconds(F.lit(int(_utc(x).timestamp()))) for x in (first, end))
    return spark.read.schema(STORED).parquet(root).filter((F.col("hour") >= lo) & (F.col("hour") < hi))

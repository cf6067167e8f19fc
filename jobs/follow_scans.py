"""Follow a growing table of scan notices and keep an hourly inventory of every site.

    python -m jobs.follow_scans --input /data/events.parquet --output /data/inventory --checkpoint /data/inventory-mark

Who runs a viewer or an archive asks of each site: which hours have scans, how many bytes, how long did the radar pause, how many
loops begin. Notices (event_id, event_type as site, ts, value as size) arrive as files. Each run takes only the files that
the checkpoint hasn't seen, in batches of ``max_files``, and ends when there are none left.

Output, both partitioned by day:

* ``catalogue/day=/batch=``: the scans that a batch brought: site, ts_us, event_id, bytes. A batch writes its own partitions only, so a
  batch that is run again after a failure replaces itself and never what others wrote.
* ``hours/day=``: site, hour, n_scans, bytes, first_us, last_us, longest_gap_us (of the hour's scans to the scan before them, null if there is
  none), loops (scans that come over ``loop_gap_s`` after the one before, or after none). Only the days that a batch touches and those after them are
  made anew, from the catalogue.

A scan is named by site and time; of two notices of one scan that with the greater event_id counts, whichever came first. The scan before is looked for on
the same day and the day before. Notices without a time are left out and counted in the log; a null site is a site of its own. Gaps
are taken within hours and carried over a table of hours, so no task holds a site's whole day.
"""

from __future__ import annotations

import datetime
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command
from stormlake.functions.constants import SEQUENCE_GAP_S
from stormlake.operators import scans
from stormlake.operators.sql import run
from stormlake.sources.store import table

LOG = logging.getLogger("jobs.follow_scans")

CATALOGUE = "site string, ts_us bigint, event_id bigint, bytes bigint, day date, batch bigint"
HOURS = "site string, hour int, n_scans bigint, bytes bigint, first_us bigint, last_us bigint, longest_gap_us bigint, loops bigint, day date"
_HOUR = 3_600_000_000


@dataclass(frozen=True)
class Config:
    input: str
    output: str
    checkpoint: str
    max_files: int = 64
    loop_gap_s: int = SEQUENCE_GAP_S


def scans_of(notices: DataFrame) -> DataFrame:
    """Notices as rows of the catalogue, each scan once."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = notices.filter("ts IS NOT NULL").select(F.col("event_type").alias("site"), at.alias("ts_us"), F.col("event_id").cast("long").alias("event_id"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    return _once(rows).withColumn("day", F.date_from_unix_date(F.floor(F.col("ts_us") / (24 * _HOUR)).cast("int")))


def _once(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct(F.col("event_id"), F.col("bytes"))).alias("last")
    keys = [c for c in ("site", "ts_us", "day") if c in rows.columns]
    return rows.groupBy(*keys).agg(last).select(*keys, "last.event_id", "last.bytes")


def hours_of(catalogue: DataFrame, loop_gap_s: int = SEQUENCE_GAP_S) -> DataFrame:
    """The inventory from (site, ts_us, event_id, bytes, day) of some days."""
    rows = _once(catalogue.select("site", "ts_us", "event_id", "bytes", "day")).withColumnRenamed("bytes", "size")
    hours = run(scans.hourly_inventory(loop_gap_s), scans=rows)
    day = F.date_from_unix_date(F.floor(F.col("hour") / 24).cast("int"))
    return hours.withColumns({"day": day, "hour": F.pmod("hour", F.lit(24)).cast("int")})


def _days(spark: SparkSession, path: str, schema: str, days: set[datetime.date]) -> DataFrame:
    """A table's rows of some days, of which one is there at least; folders of other days aren't listed."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/day={{{','.join(map(str, sorted(days)))}}}")


def follow(spark: SparkSession, config: Config) -> dict:
    """Bring catalogue and inventory up to date with the notices that are new; returns what was read and written."""
    catalogue, hours = f"{config.output}/catalogue", f"{config.output}/hours"
    done = {"batches": 0, "notices": 0, "without_time": 0, "scans": 0, "days": 0}
    one = datetime.timedelta(days=1)

    def take(batch: DataFrame, number: int) -> None:
        read, untimed, touched = batch.agg(F.count("*"), F.count_if(F.col("ts").isNull()), F.collect_set(F.to_date("ts"))).first()
        touched, written = set(touched), Observation()
        if touched:
            # a site's day of any size is written by 24 tasks
            new = scans_of(batch).withColumn("batch", F.lit(number).cast("long")).repartition("day", "site", F.floor(F.col("ts_us") / _HOUR))
            new.observe(written, F.count("*").alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(catalogue)
            stale = touched | {d + one for d in touched}
            made = hours_of(_days(batch.sparkSession, catalogue, CATALOGUE, stale | {d - one for d in stale}), config.loop_gap_s).filter(F.col("day").isin(*sorted(stale)))
            made.repartition("day").sortWithinPartitions("day", "site", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(hours)
        n = written.get["n"] if touched else 0
        done["batches"] += 1
        for name, more in (("notices", read), ("without_time", untimed), ("scans", n), ("days", len(touched))):
            done[name] += more
        LOG.info("batch %d: read %d notices (%d without a time), wrote %d scans of %d days", number, read, untimed, n, len(touched))

    shape = spark.read.parquet(config.input).schema
    # a pattern of this one path: a stream takes a table that is a single file only by pattern
    path = config.input.rstrip("/")
    notices = spark.readStream.schema(shape).option("maxFilesPerTrigger", config.max_files).parquet(f"{path[:-1]}[{path[-1]}]")
    query = notices.writeStream.foreachBatch(take).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%s: read %s, wrote %s", config.input, {k: done[k] for k in ("batches", "notices", "without_time")}, {k: done[k] for k in ("scans", "days")})
    return done


def inventory(spark: SparkSession, output: str) -> DataFrame:
    """The hourly inventory as it stands; empty while nothing was written."""
    path = f"{output}/hours"
    rows = spark.createDataFrame([], HOURS) if table(spark, path) is None else spark.read.schema(HOURS).parquet(path)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "site", "hour", "n_scans", "bytes", "first_us", "last_us", "longest_gap_us", "loops")


ORACLE = f"""
WITH named AS (SELECT event_type AS site, epoch_us(ts) AS ts_us, event_id, cast(round(value * 100) AS bigint) AS bytes FROM events WHERE ts IS NOT NULL),
once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY site, ts_us ORDER BY event_id DESC, bytes DESC) = 1),
timed AS (SELECT *, ts_us // 86400000000 AS d, lag(ts_us) OVER (PARTITION BY site ORDER BY ts_us) AS p FROM once),
gaps AS (SELECT *, CASE WHEN p // 86400000000 >= d - 1 THEN ts_us - p END AS gap FROM timed)
SELECT strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS day, site, cast(ts_us // {_HOUR} % 24 AS int) AS hour, count(*) AS n_scans, cast(sum(bytes) AS bigint) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us,
    max(gap) AS longest_gap_us, cast(count(*) FILTER (gap IS NULL OR gap > {SEQUENCE_GAP_S * 1_000_000}) AS bigint) AS loops FROM gaps GROUP BY d, site, ts_us // {_HOUR}"""


if __name__ == "__main__":
    command(Config, follow, "follow_scans")

"""Jobs over archives: the whole volume pipeline, backfill in two passes, and recomputation of what has changed."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake.functions import constants as C
from stormlake.operators import volumes
from stormlake.sources import bucket, store


def process(radials: DataFrame, root: str, provisional: bool = False, own: DataFrame | None = None, block_s: int = volumes.BLOCK_S, lead_s: int = C.PRIOR_MAX_AGE_S, raw: bool = True, held: bool = False) -> None:
    """Everything of a volume: radials, derived fields, products, cells, tracks, winds, motions, melting layers, hydrometeors,
    and last the catalogue.

    Volumes are analysed once, into a table apart that all others are taken from. Each volume's rows replace those of the same
    volume; a rerun leaves the same. own: (icao, scan_time) of the volumes to write, where ``radials`` also holds some that
    only lead into them. raw: whether to write the radials and the catalogue, which aren't new where radials come from the
    store itself. held: radials are rows of a table; else they are written apart first, so that each file is decoded once. lead_s: how far a scan before
    may lie that leads into a block; none at 0.
    """
    spark = radials.sparkSession
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    try:
        if not held:
            radials.write.parquet(f"{staged}/radials")
            radials = spark.read.parquet(f"{staged}/radials")
        rows = radials if own is None else radials.join(own, ["icao", "scan_time"], "left_semi")
        store.scan_rows(rows, provisional).write.parquet(f"{staged}/scans")
        scans = spark.read.parquet(f"{staged}/scans")
        volumes.analysed(radials, block_s=block_s, lead_s=lead_s).write.partitionBy("kind").parquet(f"{staged}/analysed")
        found = spark.read.schema(volumes.ANALYSED).parquet(f"{staged}/analysed")
        if own is not None:
            found = found.join(own, ["icao", "scan_time"], "left_semi")
        for kind in volumes.KINDS:
            store.replace(volumes.of_kind(found, kind), scans, root, kind)
        # ids count up through all frames of a site, so its tracks are made anew
        cells = store.table(spark, f"{root}/cell")
        cells = volumes.of_kind(found, "cell") if cells is None else cells
        tracks = volumes.cell_tracks(cells.join(F.broadcast(scans.select("icao").distinct()), "icao", "left_semi"))
        store.overwrite(tracks.withColumn("day", F.to_date("scan_time")), root, "cell_track")
        if raw:
            store.write_volumes(rows, scans, root)
    finally:
        store.delete(spark, staged)


def backfill(spark: SparkSession, source: bucket.Bucket, site: str, start: datetime, end: datetime, folder: str, root: str) -> list[str]:
    """The range's keys that could be fetched, in time order. First all scans in one job, each alone, as provisional previews; then all of the range in a second
    as final, each against the one before. The archive's scan just before the range, if it is complete and at most 15 minutes older, is the first
    one's prior and isn't written. Scans that can't be fetched are skipped, those that can't be read give no rows; a provisional one never serves as
    the one before.

    Executors fetch the files, each once, and keep them in ``folder``, which may be each machine's own. What is fetched and decoded lies in ``root`` until both
    jobs are done; the driver holds keys.
    """
    keys = bucket.keys_between(source, site, start, end)
    if not keys:
        return []
    lead = _predecessor(source, site, keys[0])
    held = f"{root}/_fetched-{uuid.uuid4().hex}"
    try:
        bucket.fetched(spark, source, [*keys, *lead], folder).write.parquet(f"{held}/files")
        files = spark.read.parquet(f"{held}/files")
        got = {r["key"] for r in files.select("key").collect()}
        if not got.intersection(keys):
            return []
        named = files.select(F.col("key").alias("path"), "content")
        volumes.decode(named.filter(~F.col("path").isin(lead))).write.parquet(f"{held}/range")
        volumes.decode(named.filter(F.col("path").isin(lead))).filter("complete").write.parquet(f"{held}/lead")
        final = spark.read.parquet(f"{held}/range")
        process(final, root, provisional=True, block_s=1, lead_s=0, held=True)
        process(final.unionByName(spark.read.parquet(f"{held}/lead")), root, own=final.select("icao", "scan_time").distinct(), held=True)
    finally:
        store.delete(spark, held)
    return [k for k in keys if k in got]


def _predecessor(source: bucket.Bucket, site: str, first: str) -> list[str]:
    """The key of the scan that leads into a range, if there is one."""
    at = bucket.key_time(first)
    try:
        key = bucket.key_at(source, site, at - timedelta(milliseconds=1))
    except OSError:
        return []
    return [key] if key is not None and 0 < (at - bucket.key_time(key)).total_seconds() <= C.PRIOR_MAX_AGE_S else []


def changed_volumes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Volumes (icao, scan_time) whose unfolded velocity differs between two tables of derived fields: only these need products,
    cells and winds again."""
    mark = lambda d: d.filter("field = 'DVEL'").groupBy("icao", "scan_time").agg(F.sum(F.xxhash64("elevation_number", "az_bin", F.col("v").cast("array<float>")).cast("decimal(38,0)")).alias("mark"))
    old, new = mark(before), mark(after).withColumnRenamed("mark", "new_mark")
    return new.join(old, ["icao", "scan_time"], "left").filter(~F.col("mark").eqNullSafe(F.col("new_mark"))).select("icao", "scan_time")


def unfold_again(radials: DataFrame, root: str) -> DataFrame:
    """Unfold stored volumes (radials) against their priors anew and process those whose velocity has changed: (icao, scan_time)
    of them."""
    spark = radials.sparkSession
    stored = spark.read.parquet(f"{root}/field").select("icao", "scan_time", "field", "elevation_number", "az_bin", "v")
    changed = changed_volumes(stored, volumes.derived_fields(radials))
    rows = [tuple(r) for r in changed.collect()]
    own = spark.createDataFrame(rows, "icao string, scan_time timestamp")
    if rows:
        process(radials, root, own=own, raw=False, held=True)
    return own

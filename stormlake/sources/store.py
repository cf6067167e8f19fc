"""The store of decoded volumes: partitioned Parquet written with overwrite by partition, catalogue row last."""

from __future__ import annotations

import struct
import zipfile
from io import BytesIO

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None while nothing is in it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as none:
        if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def overwrite(rows: DataFrame, root: str, name: str) -> None:
    """Write rows with icao and day over the partitions that they are in."""
    rows.repartition("icao", "day", F.hour("scan_time")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("icao", "day").parquet(f"{root}/{name}")


def scan_rows(radials: DataFrame, provisional: bool = False) -> DataFrame:
    """The catalogue's row of each volume."""
    rows = radials.withColumns({"name": F.concat_ws("_", "icao", F.date_format("scan_time", "yyyyMMdd_HHmmss")), "day": F.to_date("scan_time")})
    return rows.groupBy("icao", "day", "name", "scan_time").agg(
        F.first("complete").alias("complete"), F.lit(provisional).alias("provisional"), F.first("vcp").alias("vcp"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("height_m").alias("height_m"),
        F.countDistinct("elevation_number").alias("n_sweeps"), F.sort_array(F.collect_set("field")).alias("fields"),
    )


def replace(rows: DataFrame, scans: DataFrame, root: str, name: str) -> None:
    """Write the rows of some scans (icao, scan_time) in place of what a table has of them; other scans of the same sites and
    days stay. A table's partition is a site's day, so the number of folders doesn't grow with the scans."""
    spark, path = rows.sparkSession, f"{root}/{name}"
    new = rows.withColumn("day", F.to_date("scan_time"))
    touched = scans.select("icao", F.to_date("scan_time").alias("day")).distinct()
    if (old := table(spark, path)) is not None:
        kept = old.join(F.broadcast(touched), ["icao", "day"], "left_semi").join(scans.select("icao", "scan_time"), ["icao", "scan_time"], "left_anti")
        new = new.unionByName(kept, allowMissingColumns=True)
        left = touched.join(new.select("icao", "day").distinct(), ["icao", "day"], "left_anti").collect()
        for row in left:
            delete(spark, f"{path}/icao={row['icao']}/day={row['day']}")
    overwrite(new, root, name)


def write_volumes(radials: DataFrame, scans: DataFrame, root: str) -> None:
    """Write radials and, from ``scan_rows``, one catalogue row for each volume, the row last. A volume that is being written
    again is marked provisional first, so that readers don't take old metadata for new rays. A final volume replaces a
    provisional one of the same name."""
    if (held := table(radials.sparkSession, f"{root}/scan_index")) is not None:
        again = held.join(scans.select("icao", "scan_time"), ["icao", "scan_time"], "left_semi").withColumn("provisional", F.lit(True)).drop("day")
        replace(again, scans, root, "scan_index")
    replace(radials.withColumn("name", F.concat_ws("_", "icao", F.date_format("scan_time", "yyyyMMdd_HHmmss"))), scans, root, "radial")
    replace(scans.drop("day"), scans, root, "scan_index")


def read_field(spark: SparkSession, root: str, field: str, icao: str | None = None) -> DataFrame:
    """One field's rays; partitions and row groups of others aren't read."""
    rows = spark.read.parquet(f"{root}/radial").filter(F.col("field") == field)
    return rows.filter(F.col("icao") == icao) if icao else rows


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue, with the version of each volume: when its row was written."""
    return spark.read.parquet(f"{root}/scan_index").select("*", F.col("_metadata.file_modification_time").alias("version"))


def not_stored(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Keys (name) that have no final volume yet."""
    return keys.join(index.filter("NOT provisional").select("name"), "name", "left_anti")


def quality_label(index: DataFrame) -> DataFrame:
    return index.withColumn("quality", F.when(~F.col("complete"), "partial").when(F.col("provisional"), "provisional").otherwise(""))


def to_half(values: np.ndarray) -> bytes:
    """Little-endian float16."""
    return values.astype("<f2").tobytes()


def from_half(n_az: int, n_gates: int, raw: bytes) -> np.ndarray | None:
    """A grid, or None if the size is wrong."""
    return np.frombuffer(raw, "<f2").astype(np.float32).reshape(n_az, n_gates) if len(raw) == 2 * n_az * n_gates else None


def shapefile_from_zip(blob: bytes) -> bytes:
    with zipfile.ZipFile(BytesIO(blob)) as held:
        return held.read(next(n for n in held.namelist() if n.lower().endswith(".shp")))


def read_rings(shp: bytes) -> list[np.ndarray]:
    """Parts of the polylines and polygons of a shapefile as (n, 2) arrays of lon, lat."""
    at, out = 100, []
    while at + 12 <= len(shp):
        words = struct.unpack_from(">i", shp, at + 4)[0]
        kind = struct.unpack_from("<i", shp, at + 8)[0]
        if kind in (3, 5, 13, 15, 23, 25) and at + 52 <= len(shp):
            n_parts, n_points = struct.unpack_from("<ii", shp, at + 44)
            parts = [*struct.unpack_from(f"<{n_parts}i", shp, at + 52), n_points]
            points = np.frombuffer(shp, "<f8", 2 * n_points, at + 52 + 4 * n_parts).reshape(-1, 2)
            out += [points[a:b] for a, b in zip(parts[:-1], parts[1:], strict=True)]
        at += 8 + 2 * words
    return out


def border_segments(rings: DataFrame) -> DataFrame:
    """Undirected segments once each from (ring_id, seq, x, y): borders that two areas share are kept once."""
    from pyspark.sql import Window

    order = Window.partitionBy("ring_id").orderBy("seq")
    steps = rings.select(F.struct("x", "y").alias("a"), F.lead(F.struct("x", "y")).over(order).alias("b")).filter("b IS NOT NULL AND a <> b")
    return steps.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def polygons(documents: DataFrame) -> DataFrame:
    """(doc_id, text) GeoJSON to (doc_id, feature, properties, outer, holes): outer rings and holes of polygons and
    multipolygons as arrays of (lon, lat). Documents that don't parse give nothing."""
    shape = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = documents.select("doc_id", F.from_json("text", shape)["features"].alias("f")).select("doc_id", F.posexplode("f").alias("feature", "f"))
    ring = "array<array<array<double>>>"
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{ring}>")).when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", ring)))
    return rows.select("doc_id", "feature", F.col("f.properties").alias("properties"), F.explode(many).alias("p")).select("doc_id", "feature", "properties", F.get("p", F.lit(0)).alias("outer"), F.slice("p", 2, 1_000_000).alias("holes"))


def line_tables(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertex, x, y) and (a, b): points numbered in order, and undirected segments (a, b as structs x, y) by their numbers, each
    once. Numbers run through one partition: borders of a map are a table of a bounded size."""
    from pyspark.sql import Window

    once = segments.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    points = once.select(F.explode(F.array("a", "b")).alias("p")).distinct()
    vertices = points.select((F.row_number().over(Window.orderBy("p")) - 1).cast("long").alias("vertex"), "p.x", "p.y")
    at = vertices.select("vertex", F.struct("x", "y").alias("p"))
    first, second = at.select(F.col("vertex").alias("i"), F.col("p").alias("a")), at.select(F.col("vertex").alias("j"), F.col("p").alias("b"))
    return vertices, once.join(first, "a").join(second, "b").select(F.col("i").alias("a"), F.col("j").alias("b"))


def cities(documents: DataFrame, least: int = 0) -> DataFrame:
    """(name, lat, lon, population) from GeoJSON documents (text) of points, largest first."""
    shape = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: array<double>>>>"
    rows = documents.select(F.explode(F.from_json("text", shape)["features"]).alias("f")).filter("f.geometry.type = 'Point'")
    said = lambda *names: F.coalesce(*[F.col("f.properties")[n] for n in names])
    size = F.coalesce(F.floor(said("population", "pop_max", "POP_MAX").cast("double")).cast("long"), F.lit(0).cast("long"))
    found = rows.select(said("name", "NAME").alias("name"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), size.alias("population"))
    return found.filter(F.col("population") >= least).orderBy(F.desc("population"), "name")

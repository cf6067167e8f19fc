"""Generated volumes through the archive's encoder and decoder, against SQL of closed form: decoded gates, winds that are the same
everywhere, a block of strong echo, layers of the climate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake.functions import constants as C
from stormlake.operators import hydrometeors, volumes
from stormlake.operators.sql import oracle
from stormlake.sources import level2
from tests.test_queries import SF, canonical, duck  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _frame(name: str, twin: str) -> Callable:
    def add(function: Callable) -> Callable:
        QUERIES[name], ORACLES[name] = function, oracle(twin)
        return function

    return add


_T0 = 1_714_600_800_000


def _volumes(spark: SparkSession, sf_dir: str, made: Callable[[int], level2.Volume]) -> DataFrame:
    """Radials of one generated volume for each region, through the archive's encoder and decoder."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f"K{k}", level2.write_volume(made(int(k)))) for k in batch["r_regionkey"]], columns=["path", "content"])

    keys = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").repartition("r_regionkey")
    return volumes.decode(keys.mapInPandas(each, "path string, content binary"))


_REGIONS = "r AS (SELECT cast(r_regionkey AS int) AS k, 'KR' || chr(65 + cast(r_regionkey AS int)) || 'T' AS icao FROM region)"
_icao = lambda k: f"KR{chr(65 + k)}T"


@_frame("decoded_gates", f"""WITH {_REGIONS} SELECT icao, a // 36 AS part, field, count(*) AS n, round(sum(CASE WHEN field = 'REF' THEN ((a * 3 + g * 7 + k) % 150) / 2e0 - 10 ELSE (a + g * 5 + k) % 40 / 2e0 - 10 END), 3) AS total, max(CASE WHEN field = 'REF' THEN ((a * 3 + g * 7 + k) % 150) / 2e0 - 10 ELSE (a + g * 5 + k) % 40 / 2e0 - 10 END) AS top
    FROM r, (SELECT unnest(range(360)) AS a) rays, (SELECT unnest(range(40)) AS g) gates, (VALUES ('REF'), ('VEL')) f(field) GROUP BY ALL""")
def decoded_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of decoded archives, summed over tenths of a sweep."""

    def made(k: int) -> level2.Volume:
        ray = lambda az: np.floor(az)
        gate = lambda r: np.rint(r - 1)
        return level2.plain_scene(_icao(k), _T0, (1.5,), 40, 1000.0, {"REF": lambda az, r, e: (ray(az) * 3 + gate(r) * 7 + k) % 150 / 2 - 10, "VEL": lambda az, r, e: (ray(az) + gate(r) * 5 + k) % 40 / 2 - 10})

    rows = _volumes(spark, sf_dir, made).select("icao", F.floor(F.floor("azimuth") / 36).alias("part"), "field", F.explode("v").alias("v"))
    return rows.groupBy("icao", "part", "field").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 3).alias("total"), F.max(F.col("v").cast("double")).alias("top"))


@_frame("uniform_winds", f"""WITH {_REGIONS}, e AS (SELECT unnest([1.5, 3.0, 5.0, 8.0])::double AS elev), g AS (SELECT unnest(range(27)) AS ring), h AS (SELECT sqrt(power(s * cos(radians(elev)), 2) + power({C.EARTH_43_M!r}e0 + s * sin(radians(elev)), 2)) - {C.EARTH_43_M!r}e0 AS up FROM (SELECT elev, 1000 + (8 + ring * 4 + 1.5e0) * 500 AS s FROM e, g) q)
    SELECT icao, floor(up / 250) * 250 + 125 AS height_m, 10 + 4 * k AS u, 3 * k - 6 AS v, count(*) AS n FROM r, (SELECT up FROM h WHERE up < 12000) p GROUP BY ALL HAVING count(*) > 1""")
def uniform_winds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of a wind that is the same everywhere, from folded velocities."""

    def made(k: int) -> level2.Volume:
        u, v = 10 + 4 * k, 3 * k - 6
        return level2.plain_scene(_icao(k), _T0, (1.5, 3.0, 5.0, 8.0), 118, 500.0, {"VEL": lambda az, r, e: (u * np.sin(np.radians(az)) + v * np.cos(np.radians(az))) * np.cos(np.radians(e))})

    found = volumes.wind_profiles(_volumes(spark, sf_dir, made))
    return found.select("icao", "height_m", F.round("u_ms").alias("u"), F.round("v_ms").alias("v"), "n")


@_frame("block_cells", f"""WITH {_REGIONS}, b AS (SELECT k, icao, a, g + 1 AS r FROM r, (SELECT unnest(range(720)) AS a) rays, (SELECT unnest(range(60)) AS g) gates WHERE a >= 40 * (k + 1) AND a < 40 * (k + 1) + 30 AND g >= 15 + k AND g < 25 + 2 * k)
    SELECT icao, 0 AS rank, round(avg(r * sin(radians(a / 2e0 + 0.25e0))), 1) AS x_km, round(avg(r * cos(radians(a / 2e0 + 0.25e0))), 1) AS y_km, round(sum(r * 2 * pi() / 720), 1) AS area_km2, 55 AS max_dbz, 0 AS max_vil,
        round(max({C.KE_A_KM}e0 * cos(radians(0.5e0)) / cos(radians(0.5e0) + r / {C.KE_A_KM}e0) - {C.KE_A_KM}e0), 1) AS max_et FROM b GROUP BY icao""")
def block_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of a volume with one block of strong echo."""

    def made(k: int) -> level2.Volume:
        inside = lambda az, r: (az >= 20 * (k + 1)) & (az < 20 * (k + 1) + 15) & (r >= 16 + k) & (r < 26 + 2 * k)
        return level2.plain_scene(_icao(k), _T0, (0.5,), 60, 1000.0, {"REF": lambda az, r, e: np.where(inside(az, r), 55.0, 8.0)}, rays=720)

    found = volumes.cells(_volumes(spark, sf_dir, made))
    return found.select("icao", "rank", *[F.round(c, 1).alias(c) for c in ("x_km", "y_km", "area_km2", "max_et")], "max_dbz", "max_vil")


_CLIMATE_TOP = "floor(5900 - 75 * 35.3331e0 + (50 * 35.3331e0 - 350) * cos(2 * pi() * (19844 % 365.2425::double - 205) / 365.2425::double) - 370 + 0.5)"
_LAYER_GATES = "SELECT gate_id, 35e0 AS z, 1e0 AS zdr, 0.99e0 AS rho, -30e0 AS lkdp, 0e0 AS sdz, 0e0 AS sdphi, layer, 2.5e0 AS elev FROM (VALUES (0, 'below'), (1, 'within'), (2, 'above')) v(gate_id, layer)"


@_frame("layer_classes", f"""WITH {_REGIONS}, top AS (SELECT {_CLIMATE_TOP} AS t), codes AS ({oracle(hydrometeors.classify(), gates=_LAYER_GATES)}),
    h AS (SELECT g, sqrt(power(s * cos(radians(2.975e0)), 2) + power({C.EARTH_43_M!r}e0 + s * sin(radians(2.975e0)), 2)) - {C.EARTH_43_M!r}e0 AS hi, sqrt(power(s * cos(radians(2.025e0)), 2) + power({C.EARTH_43_M!r}e0 + s * sin(radians(2.025e0)), 2)) - {C.EARTH_43_M!r}e0 AS lo FROM (SELECT unnest(range(100)) AS g, 1000 + unnest(range(100)) * 1000e0 AS s) q)
    SELECT icao, c.code, 360 * count(*) AS n_gates FROM r, (SELECT CASE WHEN hi <= t - 600 THEN 0 WHEN lo >= t THEN 2 ELSE 1 END AS gate_id FROM h, top) l JOIN codes c USING (gate_id) GROUP BY ALL""")
def layer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrometeors of a volume that is the same everywhere, below, within and above the climate's melting layer."""

    def made(k: int) -> level2.Volume:
        return level2.plain_scene(_icao(k), _T0, (2.5,), 100, 1000.0, {"REF": lambda az, r, e: 35.0 + 0 * r, "ZDR": lambda az, r, e: 1.0 + 0 * r, "PHI": lambda az, r, e: 60.0 + 0 * r, "RHO": lambda az, r, e: 0.99 + 0 * r})

    return volumes.hydrometeor_counts(_volumes(spark, sf_dir, made)).groupBy("icao", "code").agg(F.sum("n_gates").alias("n_gates"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_closed_form(spark, duck, name):  # noqa: F811
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    place = {c[0]: i for i, c in enumerate(found.description)}
    assert canonical(frame.select(*columns).collect()) == canonical(tuple(r[place[c]] for c in columns) for r in found.fetchall())

"""The jobs as queries: each runs its job twice into one new folder of the shared one and returns the output as it then stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import archive_bulletins, follow_scans
from jobs.common import new_folder


def job1_follow_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    config = follow_scans.Config(f"{sf_dir}/events.parquet", f"{folder}/inventory", f"{folder}/checkpoint")
    for _ in range(2):
        follow_scans.follow(spark, config)
    return follow_scans.inventory(spark, config.output)


def job2_archive_bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = archive_bulletins.Config(f"{sf_dir}/documents.parquet", new_folder(spark, "job2"))
    for _ in range(2):
        archive_bulletins.archive(spark, config)
    return archive_bulletins.manifest(spark, config.output)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_follow_scans": job1_follow_scans, "job2_archive_bulletins": job2_archive_bulletins}
ORACLES: dict[str, str] = {"job1_follow_scans": follow_scans.ORACLE, "job2_archive_bulletins": archive_bulletins.ORACLE}

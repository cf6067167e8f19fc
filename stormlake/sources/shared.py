"""The folder that driver and executors share, and reliable checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; in local mode (tests) a temporary one where it names none."""
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_DIR) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the executors share")
        named = tempfile.mkdtemp(prefix="stormlake-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to a table of the shared folder and read it again. It goes when the driver ends.

    For long loops: a checkpoint hands the constraints of its plan on to the next round, and where rows are rebuilt by conditions they grow with every one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(found)
    return spark.read.schema(df.schema).parquet(path)

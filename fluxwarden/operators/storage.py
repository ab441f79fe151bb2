"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that was set; a folder of this machine only where Spark runs in this process alone."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not (made := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fluxwarden-"))
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read again as often as needed, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/fluxwarden/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

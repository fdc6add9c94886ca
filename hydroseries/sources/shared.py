"""Tables that end a lineage, in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions that set no spark.checkpoint.dir.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else, in local mode only, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="hydroseries-"))


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: what is read several times is computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hydroseries/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Tables that cut a plan: written to a folder that all machines share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor sees, under ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary one of its own; on a cluster it must be set, for
    executors don't see each other's temporary folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tidescope-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidescope-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

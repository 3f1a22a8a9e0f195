"""Intermediate tables, written to the shared folder and read back, so that lineage ends at them.

The folder is the one named in ``spark.checkpoint.dir``. Only a local session may leave it
unset (tests, notebooks) and gets a temporary folder; on a cluster that is refused, as each
executor would write to its own disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh sub-folder of the shared folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="guardlake-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/guardlake-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables written by :func:`saved` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Tables, and the shared folder for what jobs write between their steps."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; only where none is named and all runs in one process (tests), one of our own."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that later steps don't depend on how it was made."""
    path = f"{shared_dir(df.sparkSession)}/packetloom/{name}-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Rows of a narrow table (two longs at most) up to which it is broadcast: 64 MB.
BROADCAST_ROWS = 4_000_000


def sized(keys: DataFrame) -> DataFrame:
    """A narrow written table, to be broadcast if a count proves it small; beyond that the join deals out both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def freed(*tables: DataFrame) -> None:
    """Removes the files of tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        if path := vars(df).get("written_to"):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

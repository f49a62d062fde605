"""Tables between the steps of a job, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later steps don't depend on how it was made.

    Only where no folder is named and all runs in one process (tests), a temporary one is made.
    """
    spark = df.sparkSession
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/packetloom/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Steps that several later ones read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in spark.checkpoint.dir, read back: computed once, with a plan that starts anew.

    A local session without that setting, as in tests, gets a temporary folder; a cluster must
    name one that outlives its executors.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

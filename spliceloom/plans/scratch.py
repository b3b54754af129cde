"""Tables between stages, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once and read it again: later stages neither repeat it nor plan it again.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset
    (local runs, tests) it is a temporary folder of this machine.
    """
    context = df.sparkSession.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

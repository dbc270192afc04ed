"""Cutting the lineage of a frame that is used more than once, or that a loop builds on."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The frame as a table in the cluster's checkpoint folder, read back: computed once, and lost executors cost nothing.

    A folder is set only where there is none, as in tests.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="juriloom-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

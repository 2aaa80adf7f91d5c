"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from barlens.streaming.runtime import checkpoint_root


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back: its work is done once, and a lost executor costs its tasks alone."""
    path = f"{checkpoint_root(df.sparkSession)}/barlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written to spark.checkpoint.dir (a temporary folder where none is set, as in tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="crawlloom-"))
    return df.checkpoint(eager=True)

"""Ends of lineage for results that are read more than once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df``, computed once: a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names, so
    that a lost executor replays nothing; kept on executors where no folder is named."""
    sc = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True) if sc.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)

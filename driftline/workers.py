"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Adds the folder above the package to the path that workers get with the functions they run."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def with_workers(query):
    """The query, called with workers that can import the package."""

    @wraps(query)
    def run(spark, *args):
        importable(spark)
        return query(spark, *args)

    return run

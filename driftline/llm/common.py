"""Shared helpers: lineage cuts, scalable ranks inside groups, bounded constant tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyarrow.compute import binary_length
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names. Where it names none, a folder of
    our own on a single machine, and an error on a cluster, whose executors could not see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="driftline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What this worker process keeps between batches and tasks: of one operator at a time.
_held: dict = {}


def held(key, make):
    """``make()``, kept in the worker under ``key``; what another operator kept there goes first, so the
    memory of a worker is that of one operator however many stages it serves."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Lets go of what another operator kept in the worker, for one that keeps nothing itself."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 4 MB from here on, where the session has Spark's own
    settings (10,000 rows): a worker holds a batch and what is made of it."""
    for key, usual, own in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", None, "4m")):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is not None and (usual is None or now == usual):
            spark.conf.set(name, own)


def by_bytes(batches, column: int, most: int = 4 << 20):
    """The Arrow batches in slices whose values of ``column`` have about ``most`` bytes at most (one row
    at least), so that what is made of a slice is bounded whatever the texts' lengths."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        size, start = 0, 0
        for i, n in enumerate(binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                size, start = 0, i
            size += n or 0
        yield batch.slice(start)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_bare(df: DataFrame) -> DataFrame:
    """``cut`` for loops. A checkpoint inherits its plan's estimate of its bytes, and that of a join is the
    product of both sides: from turn to turn the number's digits double, until they fill the driver. Here the
    estimate is the session's default for unknown sizes; adaptive plans still go by the sizes that they meet."""
    spark, done = df.sparkSession, cut(df)._jdf
    rows = done.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done.schema(), False), spark)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (Catalyst may otherwise inline it)."""
    return F.transform(F.array(value), body)[0]


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table as literals, without an RDD."""
    names = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    one = spark.range(1)
    if not rows:
        return one.where(F.lit(False)).select(*[F.lit(None).cast(t).alias(n) for n, t in names])
    made = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, names)]) for r in rows]
    return one.select(F.explode(F.array(*made)).alias("r")).select("r.*")


def spread_rank(df: DataFrame, group: list[str], tie: list[str], name: str, buckets: int) -> DataFrame:
    """Gapless rank from 0 inside each group, without one task per group.

    Rows of a group are dealt to ``buckets`` hash buckets of ``tie``; a bucket's rank is the count of
    the buckets before it plus a row number inside it. ``df`` must be cheap to read twice (see ``cut``).
    """
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*tie), F.lit(buckets)))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = W.partitionBy(*group, "__b").orderBy(*tie)
    ranked = dealt.withColumn("__r", F.row_number().over(inner))
    return (
        ranked.join(offsets, [*group, "__b"])
        .withColumn(name, (F.col("__off") + F.col("__r") - 1).cast("long"))
        .drop("__b", "__off", "__r")
    )


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (cheap to count, see ``cut``) marked for a broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

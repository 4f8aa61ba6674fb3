"""Daily partitions: reading windows, idempotent writes, first writer wins, merges, lifecycle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.compat import finite

DAY = "partition_date"


class Store:
    """Tables below one root; a read-only root never gets a write."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        if not self.exists(name) and schema is not None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(name))

    def day(self, name: str, day: str) -> DataFrame:
        return self.read(name).where(F.col(DAY) == F.to_date(F.lit(day)))

    def window(self, name: str, day: str, days: int = 7) -> DataFrame:
        """The trailing window, the day included; constant bounds prune partitions."""
        end = dt.date.fromisoformat(day)
        return self.read(name).where(F.col(DAY).between(F.lit(end - dt.timedelta(days)), F.lit(end)))

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"{self.root} is read-only")

    def write(self, name: str, df: DataFrame, columns: list[str] | None = None) -> None:
        """Replace exactly the partitions that ``df`` has; running twice changes nothing."""
        self._writable()
        df = df.select(*columns) if columns else df
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.path(name))

    def replace_day(self, name: str, day: str, df: DataFrame, columns: list[str]) -> None:
        """The same for one day that may have no row now: an earlier result goes then too."""
        self.delete_days([name], [day])
        self.write(name, df, columns)

    def append(self, name: str, df: DataFrame) -> None:
        self._writable()
        df.write.mode("append").partitionBy(DAY).parquet(self.path(name))

    def first_writer_wins(self, name: str, df: DataFrame, key: list[str], day: str, days: int = 7, any_null: list[str] = ()) -> DataFrame:
        """Only rows whose key no trailing partition has; null keys match null keys, and a stored null in a
        column of ``any_null`` matches every value."""
        new = df.dropDuplicates(key)
        if self.exists(name):
            old = self.window(name, day, days).where(F.col(DAY) < F.to_date(F.lit(day))).select(*key).distinct()
            for k in any_null:  # without this column, for those that are null in it
                new = self._without(new, old.where(F.col(k).isNull()), [c for c in key if c != k])
            new = self._without(new, old, key)
        self.write(name, new)
        return new

    @staticmethod
    def _without(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
        old = old.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
        on = F.lit(True)
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return new.join(old, on, "left_anti")

    def merge(self, name: str, day: str, updates: DataFrame, key: list[str], column: str) -> None:
        """MERGE ... WHEN MATCHED UPDATE of one column in one partition, as a rewrite of that partition."""
        self._writable()
        new = updates.select(*key, F.col(column).alias("__new"), F.lit(True).alias("__hit")).dropDuplicates(key)
        part = self.day(name, day).join(new, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__hit")
        self._swap(name, part)

    def _swap(self, name: str, df: DataFrame) -> None:
        """Write beside the table first: a partition cannot be read and overwritten at once."""
        side = f"{name}__side"
        df.write.mode("overwrite").partitionBy(DAY).parquet(self.path(side))
        self.write(name, self.spark.read.parquet(self.path(side)))
        fs, p = self._fs(self.path(side))
        fs.delete(p, True)

    def update_where(self, name: str, day: str, column: str, value: Column, when: Column) -> None:
        self._writable()
        self._swap(name, self.day(name, day).withColumn(column, F.when(when, value).otherwise(F.col(column))))

    def days(self, name: str) -> list[str]:
        """Partitions that exist, from the directory listing alone."""
        if not self.exists(name):
            return []
        fs, p = self._fs(self.path(name))
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(x.split("=", 1)[1] for x in found if x.startswith(f"{DAY}="))

    def partition_rows(self, name: str) -> DataFrame:
        """(name, day, n): the rows of every partition; only the partition column is read, so the counts come
        from the files' footers."""
        return self.read(name).groupBy(F.lit(name).alias("name"), F.col(DAY).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))

    def delete_days(self, names: list[str], days: list[str]) -> list[str]:
        """Drop partitions; failures are returned, not raised."""
        self._writable()
        failed = []
        for name in names:
            for day in days:
                try:
                    fs, p = self._fs(f"{self.path(name)}/{DAY}={day}")
                    if fs.exists(p) and not fs.delete(p, True):
                        failed.append(f"{name}/{day}")
                except Exception as e:  # noqa: BLE001
                    failed.append(f"{name}/{day}: {e}")
        return failed

    def copy_days(self, name: str, source: Store, first: str, last: str) -> None:
        part = source.read(name).where(F.col(DAY).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
        self.write(name, part)

    def create_like(self, name: str, schema: T.StructType) -> None:
        """An empty table, if there is none."""
        self._writable()
        if not self.exists(name):
            self.spark.createDataFrame([], schema).write.parquet(self.path(name))


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in every floating column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[finite(F.col(c)).alias(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(c) for c, t in kinds.items()])


def assert_rows(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fails the job on a row that breaks the condition."""
    return df.where(F.assert_true(condition, F.lit(message)).isNull())


def missing_baseline(present: list[str], day: str, days: int = 7) -> list[str]:
    """The days before ``day`` that a detection needs and that are not there."""
    end = dt.date.fromisoformat(day)
    want = [(end - dt.timedelta(i)).isoformat() for i in range(days, 0, -1)]
    return [d for d in want if d not in set(present)]


def fill_list(present: list[str], targets: list[str], days: int = 7) -> list[str]:
    """Targets and their missing baseline days, in order."""
    need = {d for t in targets for d in missing_baseline(present, t, days)} | {t for t in targets if t not in set(present)}
    return sorted(need)


def closest_snapshot(files: list[tuple[str, int]], day: str, pattern: str = r"_(\d{4}-\d{2}-\d{2})\.", least_bytes: int = 100 << 20) -> str | None:
    """The dump nearest to the day; ties go to the earlier; unparseable names and small files are left out."""
    import re

    target, best = dt.date.fromisoformat(day), None
    for name, size in files:
        m = re.search(pattern, name)
        if not m or size < least_bytes:
            continue
        try:
            at = dt.date.fromisoformat(m[1])
        except ValueError:
            continue
        rank = (abs((at - target).days), at)
        if best is None or rank < best[0]:
            best = (rank, name)
    return best[1] if best else None


def day_or_near(available: set[str], day: str, back: int = 7, ahead: int = 7) -> str | None:
    """The day itself, else up to ``back`` days before, then up to ``ahead`` after."""
    at = dt.date.fromisoformat(day)
    for i in [0, *range(-1, -back - 1, -1), *range(1, ahead + 1)]:
        if (d := (at + dt.timedelta(i)).isoformat()) in available:
            return d
    return None


def best_version(names: list[str], day: str, pattern: str = r"(\d{4})(\d{2})\d{2}\.v(\d+)\.") -> str | None:
    """Of the files of the day's month the highest version, else the file of the nearest month."""
    import re

    year, month = map(int, day.split("-")[:2])
    found = [((int(m[1]), int(m[2])), int(m[3]), n) for n in names if (m := re.search(pattern, n))]
    if not found:
        return None
    gap = lambda ym: abs((ym[0] - year) * 12 + ym[1] - month)
    return min(found, key=lambda x: (gap(x[0]), x[0], -x[1]))[2]

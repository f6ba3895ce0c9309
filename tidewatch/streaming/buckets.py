"""Tables that grow by batches and are read by key: a batch looks into its keys' buckets only.

Rows are dealt to buckets by a hash of some columns. Every batch of every writer is a folder of its own, with a folder for
each bucket, so that a retried batch overwrites what it wrote and nothing else. Compaction writes what the folders hold,
or the latest row of each key, into one base folder and then a manifest that retires them; until the manifest is whole,
the old folders count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Buckets:
    """A table at a path: columns as DDL, the columns that rows are dealt by, and the number of buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str], n: int = 64):
        self.spark, self.path, self.schema, self.by, self.n = spark, path.rstrip("/"), schema, by, n

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folders(self, path: str, depth: int) -> list[str]:
        """Whole folders so many levels below a path, as paths relative to it."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory() and "=" in f.getPath().getName()]
        if depth > 1:
            return [f"{name}/{x}" for name in names for x in self._folders(f"{path}/{name}", depth - 1)]
        return [name for name in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))]

    def _manifest(self) -> tuple[int, set[str]]:
        """The newest manifest's number and the folders that it retires; -1 before the first."""
        made = sorted(int(x[2:]) for x in self._folders(f"{self.path}/_manifests", 1))
        if not made:
            return -1, set()
        return made[-1], {r[0] for r in self.spark.read.schema("folder string").parquet(f"{self.path}/_manifests/v={made[-1]}").collect()}

    def live(self) -> list[str]:
        """Folders that hold the table now."""
        number, retired = self._manifest()
        base = f"writer=_base/batch={number}"
        return sorted(x for x in self._folders(self.path, 2) if x not in retired and (not x.startswith("writer=_base/") or x == base))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.n)).cast("int")

    def of(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows, n at most."""
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def read(self, buckets: list[int] | None = None, *, without: str | None = None) -> DataFrame:
        """The table's rows, of some buckets only, without what a batch's folder holds."""
        found = [f"{self.path}/{x}" for x in self.live() if x != without]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.path).parquet(*found)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*self.spark.createDataFrame([], self.schema).columns)

    def folder(self, writer: str, number: int) -> str:
        return f"writer={writer}/batch={number}"

    def write(self, rows: DataFrame, folder: str) -> None:
        """Make rows the whole of a batch's folder."""
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{folder}")

    def compact(self, reduce: Callable[[DataFrame], DataFrame] = lambda rows: rows, *, sweep: bool = False) -> None:
        """One folder instead of many, of what `reduce` makes of a bucket's rows; with sweep the retired ones are deleted, which running readers may still need."""
        number, retired = self._manifest()
        old = self.live()
        self.write(reduce(self.read()), f"writer=_base/batch={number + 1}")
        gone = sorted({*old, *retired})
        self.spark.createDataFrame([(x,) for x in gone], "folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifests/v={number + 1}")
        if sweep:
            for x in gone:
                fs, p = self._fs(f"{self.path}/{x}")
                fs.delete(p, True)

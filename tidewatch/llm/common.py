"""What the operators of this package share: the shared scratch folder, written tables, bounded memos."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than a blank and the five ASCII separators.
WORD = "[^\\x20\\x09-\\x0D]+"
TOKENIZERS = "/opt/tokenizers"


def scratch(spark: SparkSession) -> str:
    """The folder that all machines share, as the session's spark.checkpoint.dir names it; unset, a temporary one, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = getattr(spark, "_tidewatch_scratch", None)
        if not found:
            found = spark._tidewatch_scratch = tempfile.mkdtemp(prefix="tidewatch-")
            spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tidewatch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: lineage ends there, and lost executors do not matter."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's tables in the scratch folder; results that still read them must be written first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Memo(dict):
    """Results of a pure function by argument; emptied when it holds `most`, so its memory is bounded."""

    def __init__(self, function: Callable, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.function(key)
        return found


def slices(batches, rows: int = 512, size: int | None = None):
    """Cut Arrow record batches into smaller ones of so many rows, or of about so many bytes, so that what is made from one stays small."""
    for batch in batches:
        step = rows if size is None else min(rows, max(1, size * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
#: What str.split takes for white space and the definition of a word doesn't.
_OTHER = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def words_of(text: str) -> list[str]:
    """The words of a text, in Python."""
    return _WORD.findall(text) if _OTHER.search(text) else text.split()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for all ends of edges: the smallest id that can be reached.

    Rounds of joins: every node takes the smallest label among its neighbours' and its own, then its label's label, so
    rounds grow with the logarithm of the longest path. Each round is written in the shared folder.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialise(ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "v"}), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        step = materialise(step, "labels")
        over = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = materialise(step.join(over, "component").select("id", F.least("component", "next").alias("component"), "before"), "labels")
        if labels.where("component <> before").isEmpty():
            return labels.select("id", "component")
        labels = labels.drop("before")

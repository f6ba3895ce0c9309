"""Shards of nearly equal bytes by best-fit-decreasing bin packing.

Equal texts are one indivisible group. Groups sorted by size enter the shard with the tightest remaining capacity that
still holds them; shards are kept ordered by remaining capacity and searched by bisection. The capacity is the smallest
at which the packing needs no more than the wanted number of shards.

What is packed is bounded, however many documents there are: groups of at least 1/FINE of all bytes are single items,
so there are at most FINE of them, and smaller groups are bundled by a hash of their digest into FINE items. Items and
their shards therefore have a proven size bound, and are what goes through the driver and into broadcasts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import materialise

FINE = 20_000
#: Rows that get their slots in one task, about.
RUN = 20_000


def best_fit_decreasing(sizes: list[int], bins: int) -> list[int]:
    """Bin of each item: at most `bins` of them, all within the smallest capacity that the search finds to do."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])

    def packed(capacity: int) -> list[int] | None:
        left: list[tuple[int, int]] = [(capacity, k) for k in range(bins)]
        out = [0] * len(sizes)
        for k in order:
            at = bisect_left(left, (sizes[k], -1))
            if at == len(left):
                return None
            room, out[k] = left.pop(at)
            insort(left, (room - sizes[k], out[k]))
        return out

    if not sizes:
        return []
    total, largest = sum(sizes), max(sizes)
    low = max(-(-total // bins), largest)
    high = low + largest  # enough for a greedy packing: when nothing fits, all bins hold more than the mean
    best = packed(high)
    while low < high:
        middle = (low + high) // 2
        if found := packed(middle):
            best, high = found, middle
        else:
            low = middle + 1
    assert best is not None
    return best


def _facts(text: Column) -> dict[str, Column]:
    data = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    return {"size": F.octet_length(data).cast("long") + 16, "text_crc32": F.crc32(data), "digest": F.unhex(F.md5(data))}


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows (with size and digest) with their shard."""
    spark = rows.sparkSession
    groups = materialise(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("digest"), F.lit(FINE)).cast("int")
    least = max(1, total // FINE)
    large = [(bytes(r[0]), r[1]) for r in groups.where(F.col("bytes") > least).select("digest", "bytes").orderBy("digest").collect()]
    small = [(r[0], r[1]) for r in groups.where(F.col("bytes") <= least).groupBy(bundle.alias("bundle")).agg(F.sum("bytes")).orderBy("bundle").collect()]
    placed = best_fit_decreasing([n for _, n in (*large, *small)], shards)
    by_digest = spark.createDataFrame([(d, s) for (d, _), s in zip(large, placed[: len(large)], strict=True)], "digest binary, own int")
    by_bundle = spark.createDataFrame([(b, s) for (b, _), s in zip(small, placed[len(large) :], strict=True)], "bundle int, shared int")
    out = rows.withColumn("bundle", bundle).join(F.broadcast(by_digest), "digest", "left").join(F.broadcast(by_bundle), "bundle", "left")
    return out.withColumn("shard", F.coalesce("own", "shared")).drop("own", "shared", "bundle")


def assign_shards(docs: DataFrame, shards: int, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs; slots count from 0 within a shard, without gaps.

    Size: UTF-8 bytes of the text plus 16; null and empty texts have no bytes, are equal, and have the checksum 0.
    Rows with equal texts get one shard, also where that makes it larger than others. Repeated rows and rows with null
    ids get a slot each. Only `id` and `text` are read; an empty table gives no rows.
    """
    rows = materialise(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", *[c.alias(k) for k, c in _facts(F.col("text")).items()]), "sizes")
    runs = rows.count() // (shards * RUN) + 1
    rows = _placed(rows, shards).withColumn("run", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "digest")
    rows = rows.withColumn("at", F.row_number().over(inside)).join(starts, ["shard", "run"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, *, text: str = "text") -> None:
    """Write docs as Parquet, one folder for each shard; rows move once, in pieces of about RUN rows."""
    facts = _facts(F.col(text))
    rows = _placed(docs.withColumns({"size": facts["size"], "digest": facts["digest"]}), shards).drop("size")
    runs = docs.count() // (shards * RUN) + 1
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("digest", F.rand(1)), F.lit(runs))).repartition("shard", "_run")
    rows.drop("digest", "_run").write.partitionBy("shard").parquet(path)

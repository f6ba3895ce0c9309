"""Which filters remove what the others would have removed: an audit of five filters in all their orders.

Documents are scanned as Arrow buffers: tables of byte classes and prefix sums over the bytes count capitals, symbols and
code points at the documents' ends; words are hashed from prefix sums, and the hashes, sorted by document, give the
distinct words, every pair of equal hashes being compared byte by byte. A document then is a mask of the filters it
fails, and all 120 orders are sums over the 32 masks of a part.

The fifth filter, identical text, compares SHA-256 digests over the whole table, whatever the other filters remove.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import buffers
from tidewatch.llm.common import materialise, slices

FILTERS = "ABCDE"
CAPITAL = np.isin(np.arange(256), range(ord("A"), ord("Z") + 1))
SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))
#: First bytes of code points.
POINT = np.arange(256) & 0xC0 != 0x80
#: Bytes of prefix sums at a time, and bytes and rows of a slice (rows fit in 16 bits).
SUMS, SLICE, ROWS = 1 << 20, 4 << 20, 4096


def counts(table: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of a class each document has; ends are the documents' ends in data."""
    at_ends = np.empty(len(ends), np.int64)
    total, k = 0, 0
    for start in range(0, len(data), SUMS):
        sums = np.cumsum(table[data[start : start + SUMS]], dtype=np.int64)
        m = int(np.searchsorted(ends, start + len(sums), "right"))
        at_ends[k:m] = total + sums[ends[k:m] - start - 1]
        total, k = total + int(sums[-1]), m
    return np.diff(at_ends, prepend=0)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct words of each of n documents; doc has each word's document."""
    key = (doc.astype(np.uint64) << np.uint64(48)) | (buffers.hashes(data, starts, ends) >> np.uint64(16))
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    out = np.bincount(doc, minlength=n) - np.bincount(doc[order[same]], minlength=n)
    a, b = order[same], order[same + 1]
    sizes = ends[a] - starts[a]
    alike = np.flatnonzero(sizes == ends[b] - starts[b])
    odd = np.concatenate([np.flatnonzero(sizes != ends[b] - starts[b]), alike[buffers.differ(data, starts[a[alike]], starts[b[alike]], sizes[alike])]])
    for d in np.unique(doc[a[odd]]):  # hashes that clash
        first, last = np.searchsorted(doc, [d, d + 1])
        out[d] = len({data[s:e].tobytes() for s, e in zip(starts[first:last], ends[first:last], strict=True)})
    return out


def failures(texts) -> tuple[np.ndarray, list[bytes]]:
    """(masks, digests) of an Arrow array of at most 65,536 texts: bits 1, 2, 4, 8 for the filters A to D, and SHA-256."""
    data, ends = buffers.joined(texts)
    first, last = buffers.words(data)
    doc = np.searchsorted(ends, first, "right")
    n_words = np.bincount(doc, minlength=len(ends))
    distinct = distinct_words(data, first, last, doc, len(ends))
    points = counts(POINT, data, ends) - 1
    mask = (n_words < 200) * 1 | (100 * distinct < 50 * n_words) * 2 | (100 * counts(CAPITAL, data, ends) > 2 * points) * 4 | (counts(SYMBOL, data, ends) > 0) * 8
    view = memoryview(data)
    return mask, [hashlib.sha256(view[a : b - 1]).digest() for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


def failed_filters(docs: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask): which of the filters A to D each row fails.

    A: fewer than 200 words; B: less than half of the words distinct; C: over 2 % of the code points are A-Z; D: holds one
    of #$%&*|. A null text is empty, a null part the empty string. Other columns aren't read.
    """

    def scan(batches):
        import pyarrow as pa

        for batch in slices(batches, ROWS, SLICE):
            mask, digests = failures(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(mask.astype(np.int32))], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, part string, digest binary, mask int")


def masks(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, E as bit 16, and those labelled quality 1 and toxic 1.

    E fails where a smaller id has the same text; rows of the smallest id and rows without an id pass it. A row counts as
    good or toxic if any label of its id says so. Rows alike are added up before each shuffle, and a text's groups (by part
    and labels, not by row) before they meet its smallest id, so neither a hot text nor a repeated row is one task's work.
    """
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL")
    said = said.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    rows = failed.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(said, "doc_id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    groups = rows.groupBy("digest", "part", "mask", *flags).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    groups = materialise(groups, "audit")
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    both = groups.join(first, "digest").withColumn("new", F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("new").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("new")).alias("n"))))
    rows = both.select("part", "good", "toxic", split.alias("x"))
    n = F.col("x.n")
    return rows.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """All orders of the five filters, step by step, from documents by mask; see `audit`.

    What a step does depends on the set of filters before it, not on their order, so a part's masks are added up for 80
    pairs of (set before, filter) and then spread over the 600 steps of all orders, a table of fixed size.
    """
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [("".join(p), k + 1, sum(bits[f] for f in p[:k]), bits[p[k]]) for p in permutations(FILTERS) for k in range(5)]
    pairs = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("bit")) for a, b in sorted({s[2:] for s in steps})])
    rows = counted.select("*", F.explode(pairs).alias("p")).select("*", "p.before", "p.bit")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0))
    # of the 120 orders of five, a filter is the first of k failing ones in 120 / k
    share = F.expr("n * (120 div greatest(1, bit_count(mask)))")
    sums = rows.groupBy("part", "before", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )
    orders = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    return sums.join(F.broadcast(orders), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, with numbers of documents of the part.

    kept: after this step; removed: here; redundant: failing this step's filter, removed earlier; unique_fails: failing it
    only; good_lost, toxic_lost: removed here and labelled so; shapley: removed by the filter, added up over all orders.
    Nulls, repeated rows and ties are as `failed_filters` and `masks` say. An empty table has no parts and so no rows.
    """
    return interactions(masks(failed_filters(docs, id=id, text=text, part=part), labels))

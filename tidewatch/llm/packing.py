"""Best-fit packing of documents into token sequences, with conflicts.

A bin is a sequence of fixed capacity. It must not hold two documents of one source, nor two of one cluster of
duplicates. Bins are ordered by what is left in them and carry bitmaps of the sources and clusters they hold; an item
goes into the tightest bin that has room and no conflict: the search starts at the first bin with room and continues to
its successors until one is compatible. Items come by falling size.

Packing runs in parts of a bounded number of items, dealt by a hash, so a source or a group of copies that a third of
all rows belong to is spread evenly over all parts, and so is one row that is repeated as often.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runs import runs
from tidewatch.llm.common import materialise, n_words
from tidewatch.llm.near_duplicates import near_duplicates
from tidewatch.llm.token_counts import with_counts

#: Items of a part, about: what one task packs at a time.
PART = 2048
#: Copies of a row that are numbered at a time.
RUN = 1 << 16


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, in the order given; a None source or cluster is in conflict with nothing."""
    bit: dict = {}
    bins: list[tuple[int, int]] = []  # (left, bin), ordered: of equally tight bins the oldest comes first
    held: list[tuple[int, int]] = []  # bitmaps of sources and clusters
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << bit.setdefault(("s", source), len(bit))
        c = 0 if cluster is None else 1 << bit.setdefault(("c", cluster), len(bit))
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (held[bins[at][1]][0] & s or held[bins[at][1]][1] & c):
            at += 1
        if at < len(bins):
            left, k = bins.pop(at)
        else:
            left, k = capacity, len(held)
            held.append((0, 0))
        held[k] = held[k][0] | s, held[k][1] | c
        out.append((k, capacity - left))
        if left > size:
            insort(bins, (left - size, k))
    return out


def sized_and_grouped(docs: DataFrame, tokenizer: str, *, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_tokens and cluster instead of the text: its tokens, and the number of its group of near-duplicates.

    Every document goes by a hash of its id and text, so a third of all rows with one text are many keys, a repeated row
    is one, and null ids do no harm; two documents of one hash would count as copies. A null text has no cluster. The
    rows are written once in the shared folder.
    """
    key = F.when(F.col(text).isNotNull(), F.xxhash64(F.col(id).cast("string"), text))
    linked = near_duplicates(docs.where(F.col(text).isNotNull()).select(key.alias("key"), text), size=size, percent=percent, id="key", text=text)
    copies = linked.where("NOT kept").groupBy(F.col("doc_id").alias("cluster")).agg(F.min("component_id").alias("_first"))
    sized = materialise(with_counts(docs.withColumn("cluster", key), tokenizer, text=text), "sized")
    sized = sized.join(materialise(copies, "copies"), "cluster", "left")
    return sized.withColumn("cluster", F.coalesce("_first", "cluster")).drop("_first")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, id: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, size: Column | None = None) -> DataFrame:
    """Pieces of documents in bins: (doc_id, piece, n_tokens, bin_id, bin_offset), one row for each piece.

    A document over `capacity` is cut into pieces of `capacity` and a rest; its pieces are of one source, so no two
    share a bin. `size` counts tokens (words, unless given) and `cluster` names groups of duplicates (equal texts,
    unless given). Null and empty texts have no tokens: one row, with piece 0 and null bin and offset. A null source or
    text is in conflict with nothing. Repeated rows are documents of their own and, as copies, never share a bin. Other
    columns of docs are not read. An empty table gives no rows.
    """
    size = n_words(F.col(text)) if size is None else size
    cluster = F.unhex(F.md5(F.col(text))) if cluster is None else cluster
    rows = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), cluster.alias("cluster"), F.coalesce(size.cast("long"), F.lit(0)).alias("n"))
    # rows alike are numbered, from their count, so that they don't all fall into one part
    many = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("k", F.explode(F.expr(f"sequence(0, (copies - 1) div {RUN})")))
    numbered = many.withColumn("copy", F.explode(F.expr(f"sequence(k * {RUN}, least(copies, (k + 1) * {RUN}) - 1)"))).drop("copies", "k")
    pieces = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("doc_id", "source", "cluster", "copy", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))
    parts = int((rows.agg(F.sum(F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)))).first()[0] or 0) // PART + 1)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "copy"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("n_tokens"), "doc_id", "piece").select("part", "doc_id", "piece", "n_tokens", "source", "cluster")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for group in runs(batches, 1):
            part = group.column(0)[0].as_py()
            sizes, sources, clusters = (group.column(k).to_pylist() for k in (3, 4, 5))
            full = [k for k, n in enumerate(sizes) if n]
            placed = dict(zip(full, best_fit([sizes[k] for k in full], [sources[k] for k in full], [clusters[k] for k in full], capacity), strict=True))
            bins = pa.array([(part << 32) + placed[k][0] if k in placed else None for k in range(len(sizes))], pa.int64())
            starts = pa.array([placed[k][1] if k in placed else None for k in range(len(sizes))], pa.int32())
            group = group.select([1, 2, 3]).append_column("bin_id", bins).append_column("bin_offset", starts)
            yield from group.to_batches()

    return dealt.mapInArrow(run, f"doc_id {id_type}, piece int, n_tokens long, bin_id long, bin_offset int")

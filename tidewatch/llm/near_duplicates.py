"""Near-duplicate documents by circulant MinHash, with every link confirmed on the full sets of shingles.

A document is its set of word n-grams. One permutation scatters the shingles over the universe; a second one, shifted
circularly by another step for each coordinate, gives all coordinates of the signature, so that two permutations do the
work of many. Bands of coordinates propose candidates.

Volume is kept in proportion to the input, whatever the groups look like:

* equal sets are one candidate;
* a bucket never turns into pairs of rows: a walk over it compares short sketches and gives a spanning forest of the
  pairs that may be similar, so buckets of documents that only share a passage fall apart;
* these forests' connected components get the documents' texts once; within one, a walk with exact set sizes gives a
  spanning forest of the confirmed links, comparing only documents that aren't connected already;
* buckets and components beyond a task's size are cut into blocks that meet one of them first; only what that leaves
  unconnected meets the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runs import runs
from tidewatch.llm.common import components, materialise, slices

BANDS, ROWS = 32, 4
#: Equal bytes of two sketches below which a pair of similarity 0.8 is out of reach (under 1e-10 of them).
SKETCH = 72
#: Documents and shingles of a group that one task compares; larger groups are cut into blocks.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser, on unsigned integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Numbers that stand for bytes, the same for A-Z and a-z, and the bytes that aren't in words.
LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * ODD)
LETTERS[ord("A") : ord("Z") + 1] = LETTERS[ord("a") : ord("z") + 1]
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: Powers of an odd base and of its inverse: enough for the bytes that are hashed at a time.
BYTES = 1 << 16
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    both = (np.full(n, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(x[1:])]) for x in both)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word in UTF-8 bytes, A-Z lower-cased.

    A word's hash is a polynomial in BASE, taken from running sums over the bytes; the bytes are cut where words end.
    """
    starts, hashes = [], []
    at = 0
    while at < len(data):
        end = at + BYTES
        if end < len(data):
            gaps = np.flatnonzero(BLANK[data[at:end]])
            while not len(gaps) and end < len(data):  # a word that is longer than that
                end += BYTES
                gaps = np.flatnonzero(BLANK[data[end - BYTES : end]]) + (end - BYTES - at)
            end = at + int(gaps[-1]) + 1 if len(gaps) else len(data)
        block = data[at:end]
        edges = np.flatnonzero(np.diff(BLANK[block], prepend=True, append=True))
        first, last = edges[::2], edges[1::2]
        up, down = (x[: len(block)] for x in _powers(max(BYTES, 1 << (len(block) - 1).bit_length())))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[block] * up)])
        hashes.append(_mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = out * ODD + h[k : k + n]
    return _mix(out)


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text of an Arrow array, A-Z lower-cased.

    A text with fewer words than `size` has them all as one; null texts and those without words have an empty set.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "\n")[0].as_buffer(), np.uint8)
    starts, h = word_hashes(data)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)]).tolist()
    joined = _joined(h, size) if len(h) >= size else h
    short = lambda a, b: _joined(h[a:b], b - a) if a < b else h[a:b]
    return [np.unique(joined[a : b - size + 1]) if b - a >= size else short(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures (documents by coordinates) of non-empty sets, in blocks that stay in the CPU's cache."""
    out = np.empty((len(sets), coordinates), np.uint32)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= 1 << 15):
            total += len(sets[end])
            end += 1
        block = np.concatenate(sets[start:end])
        firsts = np.cumsum([0, *map(len, sets[start : end - 1])])
        scattered = (_mix(block * ODD) >> np.uint64(32)).astype(np.uint32)  # the first permutation
        y, t, u = scattered * np.uint32(0x7FEB352D), np.empty_like(scattered), np.empty_like(scattered)
        for k in range(coordinates):  # the second, at x - k for all x at once; its first multiplication is linear
            np.subtract(y, np.uint32(k * 0x7FEB352D & 0xFFFFFFFF), out=t)
            np.right_shift(t, np.uint32(15), out=u)
            np.bitwise_xor(t, u, out=t)
            np.multiply(t, np.uint32(0x846CA68B), out=t)
            np.right_shift(t, np.uint32(16), out=u)
            np.bitwise_xor(t, u, out=t)
            np.multiply(t, np.uint32(0x9E3779B1), out=t)
            out[start:end, k] = np.minimum.reduceat(t, firsts)
        start = end
    return out


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch); the last three are null without words."""
    import pyarrow as pa

    schema = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {schema}, n_shingles long, digest binary, bands array<long>, sketch binary"

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            digest, bands, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                sig = signatures([sets[k] for k in full], BANDS * ROWS)
                parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]) * ODD
                for k in range(ROWS):
                    keys = _mix((keys ^ parts[:, :, k]) * ODD)
                for k, key, row in zip(full, keys.view(np.int64), (sig & np.uint32(255)).astype(np.uint8), strict=True):
                    digest[k], bands[k], sketch[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), key, row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.mapInArrow(run, schema)


def _bucket_forest(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what pairs of similar sketches connect."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(sketches))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = np.count_nonzero(sketches[rest] == sketches[p], axis=1) >= SKETCH
            queue += rest[near].tolist()
            edges += [(p, q) for q in rest[near].tolist()]
            rest = rest[~near]
    return edges


def set_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs with 100 * intersection >= percent * union connect; sets are sorted and distinct."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum(sizes) - sizes
    ids = [local[a : a + n] for a, n in zip(cuts, sizes, strict=True)]
    mark = np.zeros(int(local.max()) + 1, bool)
    edges: list[tuple[int, int]] = []
    rest = order
    flat = None
    while len(rest):
        queue, rest, flat = [int(rest[0])], rest[1:], None
        while queue and len(rest):
            p = queue.pop()
            low, high = np.searchsorted(sizes[rest], [-(-percent * sizes[p] // 100), 100 * sizes[p] // percent + 1])
            if low == high:
                continue
            if flat is None:
                flat = np.concatenate([ids[q] for q in rest])
                starts = np.concatenate([[0], np.cumsum(sizes[rest])])
            mark[ids[p]] = True
            hits = np.add.reduceat(mark[flat[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
            mark[ids[p]] = False
            near = np.zeros(len(rest), bool)
            near[low:high] = 100 * hits >= percent * (sizes[rest[low:high]] + sizes[p] - hits)
            if near.any():
                queue += rest[near].tolist()
                edges += [(p, q) for q in rest[near].tolist()]
                rest, flat = rest[~near], None
    return edges


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "id")


def _alike(rows: DataFrame, id_type: str) -> DataFrame:
    """(a, b): forests of the pairs with similar sketches within each (key, part) of rows (key, part, id, sketch)."""
    import pyarrow as pa

    def run(batches):
        made: list[tuple] = []

        def out():
            a, b = zip(*made, strict=True)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for group in runs(batches, 2):
            ids = group.column(2).to_pylist()
            sketches = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
            made += [(ids[p], ids[q]) for p, q in _bucket_forest(sketches)]
            if len(made) > 10_000:
                yield out()
        if made:
            yield out()

    return _dealt(rows.select("key", "part", "id", "sketch")).mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def _confirmed(rows: DataFrame, id_type: str, size: int, percent: int) -> DataFrame:
    """(a, b): forests of the confirmed links within each (key, part) of rows (key, part, id, text)."""
    import pyarrow as pa

    def run(batches):
        for group in runs(slices(batches), 2):
            found = [(i, s) for i, s in zip(group.column(2).to_pylist(), shingle_sets(group.column(3).combine_chunks(), size), strict=True) if len(s)]
            ids, sets = [i for i, _ in found], [s for _, s in found]
            edges = set_forest(sets, percent) if len(sets) > 1 else []
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in a]), pa.array([ids[k] for k in b])], names=["a", "b"])

    return _dealt(rows.select("key", "part", "id", "text")).mapInArrow(run, f"a {id_type}, b {id_type}")


def _connected(members: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of what `compare` links within groups, for members (key, id, block, parts, ...): a block is what one task compares.

    Each block meets block 0 first. In a large group that links nearly all; only what isn't in the group's principal
    component by then meets all blocks, so no group turns into all pairs of its blocks. Rows that agree in all columns
    but the block are equal and count once.
    """
    near = members.withColumn("part", F.explode(F.expr("if(block = 0, sequence(0, parts - 1), array(block))")))
    links = materialise(compare(near.withColumn("part", F.col("part").cast("string"))), "links")
    found = components(links)
    large = members.where("parts > 1").select("key", "id", "block", "parts").distinct()
    held = large.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    most = held.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("principal"))
    rest = materialise(held.join(most, "key").where("component <> principal").select("key", "id"), "rest")
    if rest.isEmpty():
        return found
    count = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("heaps"))
    heap = F.pmod(F.xxhash64("id", F.lit(1)), "heaps").cast("int")
    mine = members.join(rest.join(count, "key").withColumn("heap", heap).select("key", "id", "heap"), ["key", "id"]).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    all_ = members.join(count, "key").withColumn("heap", F.explode(F.expr("sequence(0, heaps - 1)"))).withColumn("other", F.col("block"))
    columns = [*members.columns, "heap", "other"]
    once = [c for c in columns if c not in ("block", "text")]
    both = mine.select(columns).unionByName(all_.select(columns)).dropDuplicates(once).withColumn("part", F.concat_ws("/", "heap", "other"))
    return components(links.union(compare(both)))


def _links(docs: DataFrame, reps: DataFrame, size: int, percent: int, id_type: str) -> DataFrame:
    """(id, component) of the representatives that are linked with others."""
    rows = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    full = materialise(full, "buckets")  # read back, its size is known, and that of its few large ones
    buckets = rows.join(full, "key").withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    sketches = reps.select(F.col("rep").alias("id"), "sketch")
    groups = _connected(buckets.select("key", "id", "block", "parts"), lambda df: _alike(df.join(sketches, "id"), id_type)).withColumnRenamed("component", "key")
    groups = groups.join(reps.select(F.col("rep").alias("id"), "n_shingles"), "id")
    parts = groups.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    groups = groups.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("mark"))
    texts = materialise(texts.join(groups.select("key", "id", "block", "parts"), "id"), "candidates")
    # repeated rows meet in the map tasks first, so a row that came very often doesn't fill a part; other texts of its id stay
    texts = materialise(texts.dropDuplicates(["id", "mark"]), "candidates-once")
    return _connected(texts.select("key", "id", "block", "parts", "mark", "text"), lambda df: _confirmed(df, id_type, size, percent))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, n_shingles, component_id, kept).

    Two documents are linked if their sets of `size`-word shingles have 100 * intersection >= percent * union;
    component_id is the smallest id that links reach, kept whether it is the document's own. Texts with fewer words
    than `size` are one shingle; null and empty texts have none and are linked with nothing. Rows with a null id are
    linked with nothing, get a null component and are kept. Rows with equal ids are one document: if their texts differ,
    it has several sets, and a link of any of them is its link. Other columns of docs are not read. An empty table gives no rows.

    `percent` must be 80 or more: bands and sketches are laid out for that.
    """
    if percent < 80:
        raise ValueError("the bands find similarities of 0.8 and more")
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketched = materialise(_sketch(rows, size), "sketches")
    full = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = full.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r"))
    reps = materialise(first.select("digest", F.col("r.doc_id").alias("rep"), "r.n_shingles", "r.bands", "r.sketch"), "sets")
    linked = _links(rows, reps, size, percent, id_type)
    label = reps.select("digest", "rep").join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    label = materialise(label, "components")
    out = sketched.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Removal of passages that occur elsewhere: windows of words, counted exactly in super-k-mer buckets.

A window's minimiser is the smallest hash of the short word n-grams in it. Consecutive windows mostly share it, so a run
of them (a super-k-mer) travels as one packed string of its words; equal windows have equal minimisers and meet in one
bucket. There all windows are sorted by a hash of their words, neighbours are compared byte by byte, and windows that
have an equal one elsewhere give spans of their documents.

* Minimisers are of several words, so that frequent words don't rule; those that are hot all the same (a passage that
  very many documents share) are found beforehand. Their super-k-mers are dealt out evenly over buckets of their own. A
  bucket that holds only a share of a minimiser's windows, as these do and those that are cut for their size, marks
  what it sees twice and hands one digest of each distinct window to a second count over the digests.
* A slice's strings for one bucket travel as one compressed block. What a task holds is a slice or a bucket's piece.
* Spans go back to their documents by id and a hash of the text. Texts without spans aren't shuffled: a bitmap of fixed
  size, broadcast, tells most of them apart, and those it can't tell are joined.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import buffers
from tidewatch.llm.common import materialise, slices

WIDTH, GRAM = 35, 5
#: Windows of a super-k-mer, and words that are hashed at a time.
RUN, STEP = 256, 1 << 20
#: Bytes: of a slice of texts, of a bucket on average, of a hot bucket, and of what is counted at once.
SLICE, BUCKET, HOT_BUCKET, PIECE = 8 << 20, 16 << 20, 4 << 20, 48 << 20
#: A minimiser is hot with a larger share of all super-k-mers, and this many of them.
SHARE, HOT = 1 / 1000, 2000
#: Bits of the bitmap of documents with spans.
BITS = 1 << 25
SPANS = "a long, b long, first int, last int, digest binary, weight int"


@dataclass
class Kmers:
    """Super-k-mers of a slice: minimiser, document, first word in it, number of windows, bytes in the slice's text."""

    minimiser: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    n: np.ndarray
    start: np.ndarray
    end: np.ndarray


def spaced(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, cuts): an Arrow array's words with one blank after each, and the documents' first words."""
    data, ends = buffers.joined(texts)
    blank = buffers.BLANK[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    cuts = np.concatenate([[0], words_before(blank, ends)])
    out = data[keep]
    out[blank[keep]] = 32
    stops = np.flatnonzero(out == 32)
    return out, np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops, stops, cuts


def words_before(blank: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of words that end at or before each of `ends`."""
    stops = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.searchsorted(stops, ends, "left")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every so many neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def chained(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many hashes: polynomials from running sums, modulo 2^64."""
    up, down = buffers.powers(1 << max(10, int(len(h)).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
    return buffers.mix((sums[width:] - sums[:-width]) * down[: len(h) - width + 1])


def super_kmers(starts, ends, cuts, data, width: int, gram: int) -> Kmers:
    """All super-k-mers of a slice's words; documents with fewer words than a window have none."""
    found: list[tuple] = []
    for at in range(0, len(starts), STEP):
        stop = min(len(starts), at + STEP + width - 1)
        if stop - at < width:
            break
        h = buffers.hashes(data, starts[at:stop], ends[at:stop])
        least = sliding_min(chained(h, gram), width - gram + 1)
        i = np.arange(at, at + len(least))
        doc = np.searchsorted(cuts, i, "right") - 1
        inside = np.flatnonzero(i + width <= cuts[doc + 1])
        if not len(inside):
            continue
        i, doc, least = i[inside], doc[inside], least[inside]
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (i[1:] != i[:-1] + 1)]))
        n = np.diff(new, append=len(i))
        pieces = -(-n // RUN)
        k = np.repeat(new, pieces)
        off = (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
        n = np.minimum(np.repeat(n, pieces) - off, RUN)
        first = i[k] + off
        found.append((least[k], doc[k], first - cuts[doc[k]], n, starts[first], ends[first + n + width - 2]))
    columns = zip(*found, strict=True) if found else [[np.empty(0, t)] for t in ("u8", "i8", "i8", "i8", "i8", "i8")]
    return Kmers(*[np.concatenate(c) for c in columns])


def sizes(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(minimiser, n, size): super-k-mers and their bytes, by those minimisers that have a share of SHARE in a slice, and for null in all."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1 << 16, SLICE):
            data, starts, ends, cuts = spaced(batch.column(0))
            k = super_kmers(starts, ends, cuts, data, width, gram)
            value, place, n = np.unique(k.minimiser, return_inverse=True, return_counts=True)
            size = np.bincount(place, k.end - k.start, minlength=len(value)).astype(np.int64)
            often = n > SHARE * n.sum()
            rows = [np.append(x[often], y) for x, y in ((value.view(np.int64), 0), (n, n.sum()), (size, size.sum()))]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], mask=np.append(np.zeros(often.sum(), bool), True)), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], names=["minimiser", "n", "size"])

    return docs.select("text").mapInArrow(run, "minimiser long, n long, size long").groupBy("minimiser").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def pack(a, b, word, n, texts: list[bytes]) -> bytes:
    """One compressed block of super-k-mers: their documents (two numbers each), first words, numbers of windows, and words."""
    import pyarrow as pa

    raw = b"".join([len(texts).to_bytes(4, "little"), *(x.tobytes() for x in (a, b, word.astype(np.int32), n.astype(np.int32))), b" ".join(texts), b" "])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def raw_size(block: bytes) -> int:
    """Bytes of a block when unpacked, which are its first number."""
    return int.from_bytes(block[:4], "little")


def unpack(block: bytes) -> tuple:
    """What `pack` took, the words as one string with a blank after each."""
    import pyarrow as pa

    raw = pa.decompress(block[4:], raw_size(block), "zstd", asbytes=True)
    m = int.from_bytes(raw[:4], "little")
    out, at = [], 4
    for kind in ("<i8", "<i8", "<i4", "<i4"):
        out.append(np.frombuffer(raw, kind, m, at))
        at += m * out[-1].itemsize
    return (*out, raw[at:])


def blocks(docs: DataFrame, width: int, gram: int, buckets: int, hot: list[int], hot_buckets: int) -> DataFrame:
    """(bucket, split, block): super-k-mers of (a, b, text) by bucket; split where a bucket has only a share of its minimisers' windows."""

    def run(batches):
        import pyarrow as pa

        known = np.sort(np.array(hot, np.int64)).view(np.uint64) if hot else np.empty(0, np.uint64)
        for batch in slices(batches, 1 << 16, SLICE):
            a, b = (np.asarray(batch.column(x)) for x in (0, 1))
            data, starts, ends, cuts = spaced(batch.column(2))
            k = super_kmers(starts, ends, cuts, data, width, gram)
            bucket = (buffers.mix(k.minimiser) % np.uint64(buckets)).astype(np.int64)
            if len(known):
                split = np.isin(k.minimiser, known)
                dealt = buffers.mix(b[k.doc].view(np.uint64) * np.uint64(buffers.BASE) + k.word.astype(np.uint64)) % np.uint64(hot_buckets)
                bucket[split] = buckets + dealt[split].astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, first = np.unique(bucket[order], return_index=True)
            view, out = memoryview(data), []
            for x, y in zip(first, [*first[1:], len(order)], strict=False):
                o = order[x:y]
                out.append(pack(a[k.doc[o]], b[k.doc[o]], k.word[o], k.n[o], [view[s:e] for s, e in zip(k.start[o].tolist(), k.end[o].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(own >= buckets), pa.array(out, pa.binary())], names=["bucket", "split", "block"])

    return docs.select("a", "b", "text").mapInArrow(run, "bucket long, split boolean, block binary")


def equal_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """A number for each window (given by its first word), the same for those with the same words.

    Hashes are sorted, and each window is compared with the one before it of the same hash: its last word only if the
    window one word earlier was compared with the one before that. If any two differ, all windows are told apart by their bytes.
    """
    h = chained(buffers.hashes(data, starts, ends), width)[windows]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    before = np.full(len(windows), -2)
    before[order[1:][same]] = order[:-1][same]
    i = np.flatnonzero(before >= 0)
    j = before[i]
    # windows[i] follows windows[i - 1] by a word, both compared, and with neighbours
    tied = (i > 0) & (before[i - 1] >= 0) & (before[i - 1] == j - 1) & (windows[i - 1] == windows[i] - 1) & (windows[j - 1] == windows[j] - 1)
    first = np.where(tied, width - 1, 0)
    x, y, end_x, end_y = starts[windows[i] + first], starts[windows[j] + first], ends[windows[i] + width - 1], ends[windows[j] + width - 1]
    if ((end_x - x) == (end_y - y)).all() and not len(buffers.differ(data, x, y, end_x - x)):
        rank = np.empty(len(windows), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ~same]))
        return rank
    seen: dict = {}
    return np.array([seen.setdefault(data[starts[w] : ends[w + width - 1]].tobytes(), len(seen)) for w in windows.tolist()], np.int64)


def count_piece(pieces: list[bytes], split: bool, width: int):
    """SPANS of a piece of a bucket: words that are in a window found twice, and, if split, a digest of each distinct window."""
    import pyarrow as pa

    a, b, word, n, text = zip(*map(unpack, pieces), strict=True)
    a, b, word, n = (np.concatenate(x).astype(np.int64) for x in (a, b, word, n))
    data = np.frombuffer(b"".join(text), np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    begins = np.cumsum(n + width - 1) - (n + width - 1)
    kmer = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(kmer)) - np.repeat(np.cumsum(n) - n, n)
    windows = begins[kmer] + off
    rank = equal_windows(data, starts, ends, windows, width)
    n_equal = np.bincount(rank)
    twice = np.flatnonzero(n_equal[rank] > 1)
    # windows that overlap or touch within a super-k-mer are one span
    new = np.flatnonzero(np.concatenate([[True], (kmer[twice[1:]] != kmer[twice[:-1]]) | (twice[1:] != twice[:-1] + 1)])) if len(twice) else twice
    low, high = twice[new], twice[np.append(new[1:], len(twice)) - 1] if len(twice) else twice
    columns = [a[kmer[low]], b[kmer[low]], word[kmer[low]] + off[low], word[kmer[low]] + off[high] + width]
    digests, weights = [None] * len(low), np.zeros(len(low), np.int64)
    if split:
        one = np.unique(rank, return_index=True)[1]
        view = memoryview(data)
        digests += [hashlib.sha256(view[s:e]).digest() for s, e in zip(starts[windows[one]].tolist(), ends[windows[one] + width - 1].tolist(), strict=True)]
        k = kmer[one]
        columns = [np.concatenate(x) for x in zip(columns, (a[k], b[k], word[k] + off[one], word[k] + off[one] + width), strict=True)]
        weights = np.concatenate([weights, np.minimum(n_equal, 2)[rank[one]]])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*columns, digests, weights], kinds, strict=True)], names=["a", "b", "first", "last", "digest", "weight"])


def count_buckets(packed: DataFrame, width: int) -> DataFrame:
    """SPANS of all buckets, a bucket at a time; one over PIECE bytes is counted in pieces."""

    def run(batches):
        held, size, last, shared = [], 0, None, False
        for batch in batches:
            for bucket, split, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = raw_size(block)
                if bucket != last:
                    if held:
                        yield count_piece(held, shared, width)
                    held, size, last, shared = [], 0, bucket, split
                elif size + n > PIECE:
                    shared = True
                    yield count_piece(held, shared, width)
                    held, size = [], 0
                held.append(block)
                size += n
        if held:
            yield count_piece(held, shared, width)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPANS)


def named(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, a, b, text): rows with one id and one text have one name (a, b) and get the same spans."""
    words = F.col(text).cast("string")
    return docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(id).cast("long"), F.xxhash64(F.lit(1), words)).alias("a"), F.xxhash64(words).alias("b"), words.alias("text"))


def repeated_spans(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(a, b, spans): for every name in `named` that has any, the words (first, last) of its windows that occur elsewhere, too.

    Elsewhere is any other place, in another row or in the same text; repeated rows are rows of their own. A second look at
    the texts counts first which minimisers are hot, and how much there is.
    """
    sized = materialise(sizes(docs, width, gram), "sizes")
    total = sized.where("minimiser IS NULL").first()
    n, size = (total["n"], total["size"]) if total else (0, 0)
    hot = sized.where(F.col("minimiser").isNotNull() & (F.col("n") > max(HOT, SHARE * n))).select("minimiser", "size").collect()
    packed = blocks(docs, width, gram, -(-size // BUCKET) or 1, [r[0] for r in hot], -(-sum(r[1] for r in hot) // HOT_BUCKET) or 1)
    found = materialise(count_buckets(packed, width), "windows")
    once = found.where("digest IS NOT NULL")
    again = once.groupBy("digest").agg(F.sum("weight").alias("n")).where("n > 1")
    rows = found.where("digest IS NULL").unionByName(once.where("weight = 1").join(again.select("digest"), "digest", "left_semi"))
    return materialise(rows.groupBy("a", "b").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")


def without(texts, spans=None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, removed words, kept words joined by blanks) of an Arrow array of texts, and of one of lists of spans."""
    data, starts, ends, cuts = spaced(texts)
    keep = np.ones(len(starts), bool)
    if spans is not None:
        n = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        base, flat = np.repeat(cuts[:-1], n), spans.flatten()
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, base + np.asarray(flat.field("first")), 1)
        np.add.at(edges, base + np.asarray(flat.field("last")), -1)
        keep = np.cumsum(edges[:-1]) == 0
    sizes = np.where(keep, ends - starts + 1, 0)
    out = data[np.repeat(keep, ends - starts + 1)].tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    kept = np.concatenate([[0], np.cumsum(keep)])[cuts]
    return np.diff(cuts), np.diff(cuts) - np.diff(kept), [out[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _bitmap(spans: DataFrame) -> bytes:
    """BITS bits, set for b modulo BITS of every name: at most BITS / 8 bytes, however many names there are."""
    bit = F.pmod("b", F.lit(BITS))
    rows = spans.select(F.floor(bit / 32768).cast("int").alias("k"), (bit % 32768).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[r.k * 4096 : (r.k + 1) * 4096] = r.bits
    return bytes(out)


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every row's words, joined by blanks, without those in windows of `width` words that occur elsewhere.

    Words are runs of characters other than the blank and the five ASCII separators. All occurrences go, the first
    included, and all are judged on the input. Null and empty texts have no words and give an empty text; rows with equal
    ids or null ids are rows of their own; repeated rows of at least `width` words lose them all. Other columns aren't read.
    """
    rows = named(docs, id, text)
    spans = repeated_spans(rows, width=width, gram=gram)
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(spans))

    def known(column) -> np.ndarray:
        at = np.asarray(column) % BITS
        return (np.frombuffer(bits.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def result(batch, spans):
        import pyarrow as pa

        n, removed, kept = without(batch.column("text"), spans)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    def untouched(batches):
        for batch in batches:
            for piece in slices([batch.filter(~known(batch.column("b")))], 1 << 16, SLICE):
                yield result(piece, None)

    def candidates(batches):
        for batch in batches:
            yield batch.filter(known(batch.column("b")))

    def cut(batches):
        for batch in slices(batches, 1 << 16, SLICE):
            yield result(batch, batch.column("spans"))

    out = rows.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("text", "string")
    joined = rows.mapInArrow(candidates, rows.schema).join(spans, ["a", "b"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(untouched, out).unionByName(joined.mapInArrow(cut, out))

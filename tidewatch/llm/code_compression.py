"""Vector compression by product quantisation, in whole numbers from the first distance to the last sum.

Vectors become integers, floor(256 x), and are cut into equal parts. Every part position has a codebook of integer
vectors. In each round the codebooks are broadcast, Arrow batches take the distances of all their parts to all entries as
|x|^2 - 2 x.c + |c|^2 with one int64 matrix product for each position, and the first smallest wins; sums and numbers of
the parts by entry are added up in each task, merged by a grouped shuffle, and divided into the next codebooks.

All of it is exact: where components are so large that int64 could overflow, the same is done with Python's integers, and
sums travel as limbs of 30 bits, so that adding them up in the shuffle can't overflow either.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Numbers in a slice's table of distances, at most.
CELLS = 1 << 21
LIMB = 30
#: A label with a larger share of the rows is hot; there are at most this many.
HOT = 1000


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles: int64, or Python's integers where one is over 2^62."""
    if not len(flat) or np.abs(flat).max() < 2.0**54:
        return np.floor(flat * SCALE).astype(np.int64)
    # doubles this large are whole numbers, and SCALE times the largest ones wouldn't be finite
    return np.array([int(x) * SCALE if abs(x) > 2.0**53 else int(np.floor(x * SCALE)) for x in flat.tolist()], object)


def matrices(column, width: int):
    """Slices of an Arrow column of lists as (first row, parts): arrays of PARTS x rows x width / PARTS, zeros where a vector ends early."""
    rows = max(1, CELLS // (PARTS * ENTRIES + width))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    for start in range(0, len(column), rows):
        piece, n = column.slice(start, rows), lengths[start : start + rows]
        whole = integers(np.asarray(piece.flatten(), np.float64))
        parts = np.zeros((len(n), width), whole.dtype)
        if (n == width).all():
            parts[:] = whole.reshape(len(n), width)
        else:
            parts[np.repeat(np.arange(len(n)), n), np.arange(len(whole)) - np.repeat(np.cumsum(n) - n, n)] = whole
        yield start, np.ascontiguousarray(parts.reshape(len(n), PARTS, width // PARTS).transpose(1, 0, 2))


def assign(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances) of parts, PARTS x rows each: the first of the nearest entries of each position's codebook."""
    most = max((int(np.abs(x).max()) for x in (parts, books) if x.size), default=0)
    kind = np.int64 if 4 * most * most * parts.shape[2] < 1 << 62 else object
    parts, books = parts.astype(kind), books.astype(kind)
    norms = lambda x: (x * x).sum(axis=2)
    distances = norms(books)[:, None, :] - 2 * (parts @ books.transpose(0, 2, 1))
    codes = distances.argmin(axis=2)
    return codes, norms(parts) + np.take_along_axis(distances, codes[:, :, None], axis=2)[:, :, 0]


def _limbs(value: int) -> list[int]:
    """A whole number by limbs, the lowest first; all but the last are from 0 to 2^LIMB - 1."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def sums_of(batches, books: np.ndarray, width: int):
    """A task's rows of (slot, limb, n, sums): for each entry in use, its number of parts and limbs of their sums."""
    import pyarrow as pa

    entries, size = books.shape[1], width // PARTS
    total, n = np.zeros((PARTS * entries, size), object), np.zeros(PARTS * entries, np.int64)
    for batch in batches:
        for _, parts in matrices(batch.column(0), width):
            codes = (assign(parts, books)[0] + np.arange(PARTS)[:, None] * entries).ravel()
            order = np.argsort(codes, kind="stable")
            slots, first = np.unique(codes[order], return_index=True)
            flat = parts.reshape(-1, size)[order]
            exact = flat.dtype == object or int(np.abs(flat).max(initial=0)) * len(flat) >= 1 << 62
            total[slots] += np.add.reduceat(flat.astype(object) if exact else flat, first, axis=0).astype(object)
            n[slots] += np.diff(first, append=len(codes))
    rows = []
    for slot in np.flatnonzero(n).tolist():
        limbs = [_limbs(int(v)) for v in total[slot]]
        for k in range(max(map(len, limbs))):
            rows.append((slot, k, int(n[slot]) if k == 0 else 0, [x[k] if k < len(x) else 0 for x in limbs]))
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["slot", "limb", "n", "sums"])


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor(sum / number) of the parts nearest to each entry; unused entries stay.

    What comes back to the driver is a few rows for each entry, however many vectors there are.
    """
    size, entries = books.shape[2], books.shape[1]
    found = rows.select("vector").mapInArrow(lambda batches: sums_of(batches, books, size * PARTS), "slot int, limb int, n long, sums array<long>")
    merged = found.groupBy("slot", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(size)]).cast("array<long>").alias("sums"))
    total, n = {}, {}
    for r in merged.collect():
        here = total.setdefault(r.slot, [0] * size)
        for k, x in enumerate(r.sums):
            here[k] += x << (LIMB * r.limb)
        n[r.slot] = n.get(r.slot, 0) + r.n
    out = books.astype(object)
    for slot, sums in total.items():
        out[slot // entries, slot % entries] = [x // n[slot] for x in sums]
    return small(out)


def small(whole: np.ndarray) -> np.ndarray:
    """As int64, where all numbers fit."""
    return whole.astype(np.int64) if not whole.size or max(abs(int(whole.max())), abs(int(whole.min()))) < 1 << 62 else whole


def usable(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, vector, label) of rows whose vector isn't null and holds neither null nor non-finite components."""
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    return rows.where(F.col("vector").isNotNull()).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def learn(rows: DataFrame) -> np.ndarray | None:
    """Codebooks, PARTS x entries x components, of the rows of `usable`; None without rows."""
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return None
    width = max(1, -(-width // PARTS)) * PARTS
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    first = rows.where(F.col("vec_id").isin([x for x in ids if x is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False)))
    seeds = {r[0]: r[1] for r in first.groupBy("vec_id").agg(F.min("vector")).collect()}
    books = np.zeros((len(ids), width), object)
    for k, i in enumerate(ids):
        books[k, : len(seeds[i])] = integers(np.array(seeds[i], np.float64))
    books = small(books.reshape(len(ids), PARTS, width // PARTS).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        books = refine(rows, books)
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, joined by commas: by part, entry and place within the part."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the squared distances to the entries, added up."""
    width = books.shape[2] * PARTS
    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes, errors = [], []
            for _, parts in matrices(batch.column(2), width):
                found, distances = assign(parts, books)
                text = found.T.astype(np.uint8).tobytes().hex()
                codes += [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                errors += [x if x < 1 << 63 else None for x in distances.astype(object).sum(axis=0)] if distances.dtype == object else distances.sum(axis=0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Beside each row the errors of its label added up, nulls together; null where an error or the sum is beyond a long.

    Labels of over 1/HOT of the rows, at most HOT of them, are broadcast and never shuffle rows; all others are joined.
    """
    coded = materialise(coded, "codes")
    sums = materialise(coded.groupBy("label").agg(F.count("*").alias("n"), F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot, cold = (sums.where(c).select("label", "label_error") for c in (F.col("n") * HOT > total, F.col("n") * HOT <= total))
    named = lambda df: df.withColumnRenamed("label", "_label")
    same = coded["label"].eqNullSafe(F.col("_label"))
    few = coded.join(F.broadcast(named(hot)), same)
    many = coded.join(F.broadcast(named(hot)), same, "left_anti").join(named(cold), same)
    return few.unionByName(many).drop("_label")


def compress(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """The codes of all usable vectors (vec_id, label, code, error, label_error), and the codebooks.

    Codebooks start as the parts of the ENTRIES smallest ids, of each the smallest vector if rows share it, null ids last
    and counting as one; fewer ids give fewer entries. Vectors that are null or hold null or non-finite components are
    dropped. A vector that is shorter than the longest, or than the next multiple of PARTS (PARTS at least), counts as having
    zeros there.
    Ties go to the lower entry. An error beyond a long is null. Other columns aren't read. Without usable rows there are
    no codes and no codebooks.
    """
    rows = usable(vectors, id, vector, label)
    books = learn(rows)
    if books is None:
        kinds = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long").add("label_error", "long")
        return rows.sparkSession.createDataFrame([], kinds), None
    return with_label_error(encode(rows, books)), books

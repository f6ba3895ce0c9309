"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors become binary codes: their signs after rotations that are learned to lose little by that (iterative
quantisation). A code is cut into substrings, each of which has an index of its own. By the pigeonhole principle, codes
within Hamming radius r of a query agree with it in some substring up to r / (number of substrings) bits, so probing all
substring values that near retrieves every code within the radius. What is retrieved is ranked by inner products of the
original vectors in double precision.

Rotations and the radius are learned on a sample of bounded size; all rows are indexed. Rows are dealt to blocks of one
class of length each, so that within a block the angle decides. Query blocks meet row blocks in tasks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import materialise

#: Bits of a code; substrings have 8 of them.
BITS = 256
#: Rows that are learned from, at most, and how many of them are tried as queries.
SAMPLE, TRIED = 10_000, 300
#: Share of a sampled query's true neighbours that the radius takes in.
SHARE = 0.985
ROWS, QUERIES = 16_384, 2_048
ONES = np.array([bin(v).count("1") for v in range(256)])


@dataclass
class Coder:
    """What turns vectors into codes, and the search radius."""

    mean: np.ndarray
    turns: np.ndarray  # rotations, one beside the other
    radius: int = 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as 64-bit words, 4 to a row."""
        return np.packbits((vectors - self.mean) @ self.turns > 0, axis=1).view(np.uint64)


def learn(sample: np.ndarray, k: int) -> Coder:
    """Rotations by iterative quantisation, and the radius that takes in SHARE of true neighbours within the sample.

    Neighbours within a sample are further away than those in all rows, so the radius errs towards more.
    """
    rng = np.random.default_rng(7)
    n, d = sample.shape
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    turns = []
    for _ in range(-(-BITS // d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        part = unit[rng.permutation(n)[:4000]] - mean
        for _ in range(20):
            u, _, v = np.linalg.svd(np.sign(part @ turn).T @ part)
            turn = (u @ v).T
        turns.append(turn)
    coder = Coder(mean, np.concatenate(turns, axis=1)[:, :BITS])
    codes = coder.codes(unit)
    tried = rng.permutation(n)[:TRIED]
    near = unit[tried] @ unit.T
    near[np.arange(len(tried)), tried] = -np.inf
    best = np.argsort(-near, axis=1)[:, : max(1, min(k, n - 1))]
    far = np.bitwise_count(codes[best] ^ codes[tried][:, None]).sum(axis=2) if n > 1 else np.array([BITS])
    coder.radius = int(np.quantile(far, SHARE))
    return coder


class Index:
    """The substring indexes of a block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.coder = ids, vectors, coder
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.codes = coder.codes(unit)
        self.parts = BITS // 8
        letters = self.codes.view(np.uint8)
        self.order = [np.argsort(letters[:, j], kind="stable") for j in range(self.parts)]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(letters[:, j], minlength=256))]) for j in range(self.parts)]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with codes within the radius: substrings are probed until all rows have turned up or none is left."""
        seen = np.zeros(len(self.ids), bool)
        masks = np.flatnonzero(ONES <= radius // self.parts)
        for j, letter in enumerate(code.view(np.uint8)):
            values = masks ^ letter
            first, n = self.start[j][values], self.start[j][values + 1] - self.start[j][values]
            total = int(n.sum())
            seen[self.order[j][np.arange(total) + np.repeat(first - np.cumsum(n) + n, n)]] = True
            if j % 4 == 3 and seen.all():
                break
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]

    def search(self, query: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows found, without the query's own; the radius grows until k are found."""
        code = self.coder.codes(vector[None] / np.linalg.norm(vector))[0]
        radius = self.coder.radius
        while True:
            found = self.probe(code, radius)
            found = found[self.ids[found] != query]
            if len(found) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + max(8, radius // 4))
        scores = (self.vectors[found] * vector).sum(axis=1)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][best], scores[best]


def _arrays(table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The last two columns of a table: ids, and vectors as a matrix."""
    ids, vectors = (table.column(k).combine_chunks() for k in (-2, -1))
    flat = np.asarray(vectors.flatten(), np.float64) if len(vectors) else np.empty(0)
    return np.asarray(ids), flat.reshape(-1, width)


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner products found for each query.

    Queries are rows whose id is divisible by `every`, candidates all rows but the query's own; with fewer than k
    candidates all come. Ties go to the smaller id. Rows with a null id, and vectors that are null, zero, hold null or
    non-finite components, or aren't of the most frequent width, take no part. Rows of one id are one vector, the
    smallest of them. Other columns are not read. Without usable rows there is no result.
    """
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(good)
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = materialise(rows.withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))), "vectors")
    widths = rows.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return rows.sparkSession.createDataFrame([], result)
    width = widths[0][0]
    rows = rows.where(F.size("vector") == width).withColumn("class", F.floor(4 * F.log2("length")).cast("int"))
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()])
    coder = learn(sample, k)
    classes = rows.groupBy("class").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    heaps = queries.count() // QUERIES + 1
    dealt = rows.join(classes, "class").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    dealt = dealt.select("class", "block", F.explode(F.sequence(F.lit(0), F.lit(heaps - 1))).alias("heap"), "vec_id", "vector")
    places = classes.select(F.col("class").alias("class"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    # the stated query set against the blocks of all rows; blocks are few: one for some ROWS rows
    asked = queries.withColumn("heap", F.pmod(F.xxhash64("query_id"), F.lit(heaps)).cast("int")).crossJoin(places)

    def search(left, right):
        import pyarrow as pa

        ids, block = _arrays(left, width)
        query_ids, query = _arrays(right, width)
        out: tuple[list, list, list] = ([], [], [])
        if len(ids) and len(query_ids):
            index = Index(ids, block, coder)
            for q, v in zip(query_ids.tolist(), query, strict=True):
                found, scores = index.search(q, v, k)
                out[0].append(np.full(len(found), q))
                out[1].append(found)
                out[2].append(scores)
        columns = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["class", "block", "heap"]
    found = dealt.groupBy(*keys).cogroup(asked.select(*keys, "query_id", "query").groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

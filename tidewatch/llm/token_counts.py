"""Token counts through a cache of content digests.

A table holds the token count of every (tokenizer version, content) seen so far, by digests. Counting joins the digests
of the documents' normalised contents to it, encodes only the distinct contents that it lacks, and appends their counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.bpe_codec import byte_alphabet
from tidewatch.llm.common import Memo, slices

CACHE = "content string, tokenizer string, n_tokens long"
WORDS = 200_000
#: Rows and bytes of texts whose words are counted together.
ROWS, BYTES = 8192, 6_000_000


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file and of the way of counting."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"count 1\n" + f.read()).hexdigest()


def blanks_folded(text: Column) -> Column:
    """The text with runs of blanks, tabs and line ends as one blank: for tokenizers that drop white space."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


#: Fixed value: the published pre-tokenizer pattern of vocabularies with word ends, which drops white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.int32(2**31 - 1)
#: Classes of bytes: letters (of ASCII and the bytes of U+00C0 to U+00FF), digits, others, and those that aren't cut by class alone.
LETTER, DIGIT, OTHER, STRANGE = range(4)


class WordBpe:
    """Token counts of words by a BPE vocabulary with word ends, for many words at a time.

    All words take a step together: each one's best merge is done, until none is left. Words with an apostrophe, the
    beginning of an added token, or letters beyond U+00FF aren't counted here, since more than classes of bytes cuts or
    normalises them.
    """

    def __init__(self, spec: dict):
        model, ids = spec["model"], spec["model"]["vocab"]
        letters = byte_alphabet()
        self.inner = np.array([ids[letters[b]] for b in range(256)])
        self.final = np.array([ids[letters[b] + model["end_of_word_suffix"]] for b in range(256)])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges]) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges])
        self.width = max(ids.values()) + 1
        self._enter(left * self.width + right)
        self.kind = np.full(256, OTHER)
        self.kind[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
        self.kind[48:58] = DIGIT
        self.kind[[39, *range(128, 0xC3), *range(0xC4, 256), *(t["content"].encode()[0] for t in spec["added_tokens"])]] = STRANGE
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    @staticmethod
    def suits(spec: dict) -> bool:
        """Whether a tokenizer file normalises, cuts and merges in the way that is done here."""
        model, normal, cut = spec["model"], spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        added = all(t["content"].strip() == t["content"] and not any(t[k] for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec["added_tokens"])
        split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        bytes_ = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        return bool(plain and added and cut == [split, bytes_] and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _enter(self, keys: np.ndarray) -> None:
        """Ranks by pair in an open hash table with four slots or more to a merge; what is taken goes on to the next slot."""
        bits = (4 * len(keys)).bit_length()
        self.shift, self.keys, self.ranks = np.uint64(64 - bits), np.full(1 << bits, -1), np.full(1 << bits, NONE)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, rank

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NONE where there is none."""
        key = left * self.width + right
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], NONE)
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.keys)
            held = self.keys[at[rest]]
            out[rest] = np.where(held == key[rest], self.ranks[at[rest]], NONE)
            rest = rest[(held != key[rest]) & (held >= 0)]
        return out

    def _tokens(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each piece of lower-cased bytes."""
        sizes = np.diff(starts, append=len(data))
        total, piece = sizes.copy(), np.arange(len(starts))
        ids = self.inner[data]
        ids[starts + sizes - 1] = self.final[data[starts + sizes - 1]]
        rank = np.full(len(ids), NONE)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[starts + sizes - 1] = NONE
        while len(piece):
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                stay = np.repeat(live, sizes)
                ids, rank, piece, sizes, least = ids[stay], rank[stay], piece[live], sizes[live], least[live]
                starts = np.cumsum(sizes) - sizes
                if not len(piece):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hit[np.searchsorted(hit, starts)]  # the first of each piece
            ids[at] = self.made[least]
            gone = np.ones(len(ids), bool)
            gone[at + 1] = False
            ids, rank = ids[gone], rank[gone]
            total[piece] -= 1
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            at -= np.arange(len(at))
            rank[at] = NONE
            next_, prev = at[at + 1 < starts + sizes], at[at > starts]
            rank[next_] = self._rank(ids[next_], ids[next_ + 1])
            rank[prev - 1] = self._rank(ids[prev - 1], ids[prev])
        return total

    def counts(self, words) -> np.ndarray:
        """Tokens of each non-empty word of an Arrow array; -1 for those that aren't counted here."""
        n = len(words)
        if not n:
            return np.empty(0, np.int64)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, n], words), "")[0].as_buffer(), np.uint8)
        kind = self.kind[data]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        kind[after] = np.where((data[after] == 0x97) | (data[after] == 0xB7), STRANGE, LETTER)
        data = self.lower[data]
        data[after] += ((data[after] < 0x9F)) * np.uint8(32)
        starts = np.cumsum(sizes) - sizes
        good = np.maximum.reduceat(kind, starts) < STRANGE
        out = np.full(n, -1)
        if good.any():
            stay = np.repeat(good, sizes)
            data, kind, sizes = data[stay], kind[stay], sizes[good]
            starts = np.cumsum(sizes) - sizes
            cut = (kind == DIGIT) | np.diff(kind, prepend=-1).astype(bool)
            cut[starts] = True
            pieces = np.flatnonzero(cut)
            out[good] = np.add.reduceat(self._tokens(data, pieces), np.searchsorted(pieces, starts))
        return out


class Counter:
    """Token counts as the library of a tokenizer's file gives them; added tokens' strings inside texts as its default."""

    def __init__(self, path: str):
        self.words: WordBpe | None = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.one = lambda text: len(model.encode(text))
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.one = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        spec = json.loads(tokenizer.to_str())
        if WordBpe.suits(spec):
            # white space separates words for good: counts of words add up to those of texts
            self.words, self.memo = WordBpe(spec), Memo(self.one, WORDS)

    def count(self, texts) -> np.ndarray:
        """Token counts of an Arrow array of texts; null and empty ones have none. Each distinct word is counted once."""
        texts = pc.fill_null(texts, "")
        if self.words is None:
            return np.array([self.one(x) if x else 0 for x in texts.to_pylist()], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        full = pc.not_equal(distinct, "")
        found = np.zeros(len(distinct), np.int64)
        known = full.to_numpy(zero_copy_only=False)
        words = distinct.filter(full)
        made = self.words.counts(words)
        strange = np.flatnonzero(made < 0)
        made[strange] = [self.memo[x] for x in words.take(pa.array(strange)).to_pylist()]
        found[known] = made
        sums = np.concatenate([[0], np.cumsum(found[coded.indices.to_numpy()])])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else np.empty(0, np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each file and Python worker."""
    return Counter(path)


def _digests(docs: DataFrame, text: str, normal: Callable[[Column], Column]) -> Column:
    return F.sha2(F.coalesce(normal(F.col(text)), F.lit("")), 256)


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's table; empty where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)


def fill_cache(docs: DataFrame, tokenizer: str, cache: str, *, text: str = "text", normal: Callable[[Column], Column] = blanks_folded) -> None:
    """Append to the cache the counts of all contents of docs that it lacks; each distinct content is encoded once.

    Copies meet in the map tasks first, so one text in a third of all rows moves once for each of them. A null text
    counts as the empty one. A cache takes one writer at a time, so that it has each content once.
    """
    version = tokenizer_version(tokenizer)
    known = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == version).select("content")
    distinct = docs.select(F.coalesce(normal(F.col(text)), F.lit("")).alias("normal")).withColumn("content", F.sha2("normal", 256)).groupBy("content").agg(F.first("normal").alias("normal"))

    def run(batches):
        count = counter(tokenizer).count
        for batch in slices(batches, ROWS, BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * batch.num_rows, pa.string()), pa.array(count(batch.column(1)), pa.int64())], names=["content", "tokenizer", "n_tokens"])

    distinct.join(known, "content", "left_anti").mapInArrow(run, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, text: str = "text", normal: Callable[[Column], Column] = blanks_folded, n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the token count of every whole text, out of the cache, which is filled first.

    `normal` must not change counts: blanks_folded suits tokenizers that drop white space, an identity suits all.
    Adds or replaces `n_tokens`; other columns, repeated rows and nulls in them stay. Null and empty texts have no
    tokens. An empty table gives an empty table. Both sides of the last join are plain shuffles of small rows, so
    adaptive execution can split a content that a third of all rows have.
    """
    fill_cache(docs, tokenizer, cache, text=text, normal=normal)
    stored = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == tokenizer_version(tokenizer))
    stored = stored.select(F.col("content").alias("_content"), F.col("n_tokens").alias("_count"))
    kept = docs.drop(n_tokens).withColumn("_content", _digests(docs, text, normal))
    return kept.join(stored, "_content", "left").withColumn(n_tokens, F.col("_count")).drop("_content", "_count")


def with_counts(docs: DataFrame, tokenizer: str, *, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the token count of every whole text instead of the text: one pass without a cache, so nothing is shuffled.

    For tokenizers that drop white space this is count_tokens' result. Null and empty texts have no tokens.
    """
    source = docs.select(*[c for c in docs.columns if c not in (text, n_tokens)], text)
    names = [*source.columns[:-1], n_tokens]

    def run(batches):
        count = counter(tokenizer).count
        for batch in slices(batches, ROWS, BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count(batch.column(len(names) - 1)), pa.int64())], names=names)

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(n_tokens, T.LongType())]))

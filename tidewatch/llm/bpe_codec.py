"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token, the token with which its encoding ends is unique. An automaton over the vocabulary
reports all tokens that end at a position; the one that also may stand after the last token of the remaining prefix is
kept, and the encoding is read off by following the kept tokens backwards. Whether a token may stand after another is
a property of the pair: undoing the merges that made the two, newest first, must never show a pair across the border
that an earlier merge would have joined.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import Memo, slices

#: White space as Unicode defines it, which is what the pre-tokenizers of the public files mean by \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts a text where the pre-tokenizer always cuts: runs of white space, and runs of other characters with one blank before.
COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space other than blanks and line ends.
OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: The published pre-tokenizer pattern of byte-level vocabularies.
FINE = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ANY_RANK = 1 << 60
CHUNKS, PAIRS = 600_000, 1_000_000


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def even(text: str) -> bool:
    """Whether all white space is single blanks and line ends between other characters: splitting then cuts as COARSE does."""
    if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not OTHER_SPACE.search(text)


class Codec:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        import ahocorasick
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.alphabet = [alphabet[b] for b in range(256)]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        self.rank: dict[int, int] = dict.fromkeys(ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[left + right]
            self.joined[ids[left], ids[right]] = rank
            if made not in self.parts:
                self.rank[made], self.parts[made] = rank, (ids[left], ids[right])
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if self._reachable(i):
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.fine = regex.compile(FINE)
        self.bits = max(ids.values()).bit_length()
        self.compatible = Memo(lambda pair: self._stable(pair >> self.bits, pair & (1 << self.bits) - 1, ANY_RANK), PAIRS)
        self.chunks = Memo(self._encode_chunk, CHUNKS)
        self.after_blank = Memo(lambda word: self._encode_chunk(f" {word}"), CHUNKS)
        lengths = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(lengths))), np.uint8)
        self.size = np.array(lengths, np.int64)
        self.start = np.cumsum(self.size) - self.size

    def _reachable(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        if token not in self.parts:
            return self.rank[token] < 0 and len(self.bytes_of[token]) == 1
        left, right = self.parts[token]
        return self._reachable(left) and self._reachable(right) and self._stable(left, right, self.rank[token])

    def _stable(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below `limit` crosses the border at any time while left and right are made."""
        while True:
            if self.joined.get((left, right), ANY_RANK) < limit:
                return False
            made_left, made_right = self.rank[left], self.rank[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:  # of equal merges the one to the left came first, so the right one is undone first
                limit, left = made_left, self.parts[left][1]
            else:
                limit, right = made_right + 1, self.parts[right][0]

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, in the byte alphabet, as little-endian 32-bit integers."""
        n = len(piece)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        compatible, bits = self.compatible, self.bits
        for end, (token, size) in self.automaton.iter(piece):
            end += 1
            if last[end] < 0 and (end == size or (before := last[end - size]) >= 0 and compatible[before << bits | token]):
                last[end], length[end] = token, size
        at, out = n, []
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no token for {piece!r}")
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def _encode_chunk(self, chunk: str) -> bytes:
        letters = self.alphabet
        pieces = [chunk] if chunk.lstrip(" ").isalpha() else self.fine.findall(chunk)
        return b"".join([self.encode_piece("".join([letters[b] for b in p.encode()])) for p in pieces])

    def _cut(self, text: str) -> list[bytes]:
        if not even(text):
            return list(map(self.chunks.__getitem__, COARSE.findall(text)))
        out: list[bytes] = []
        for line in text.split("\n") if text else ():
            first, *rest = line.split(" ")
            if out:
                out.append(self.chunks["\n"])
            out.append(self.chunks[first])
            out.extend(map(self.after_blank.__getitem__, rest))
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers; strings of added tokens become those tokens."""
        if self.special is None or not self.special.search(text):
            return b"".join(self._cut(text))
        out, start = [], 0
        for hit in self.special.finditer(text):
            out += [*self._cut(text[start : hit.start()]), self.added[hit[0]].to_bytes(4, "little")]
            start = hit.end()
        return b"".join([*out, *self._cut(text[start:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        import numpy as np

        tokens = np.frombuffer(ids, "<u4")
        sizes = self.size[tokens]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[tokens] - ends + sizes, sizes)
        return self.blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str, *, text: str = "text", decode: bool = False, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Encode a text column of every row, in place: no shuffle, and memory for one slice of a batch.

    Adds `ids` (binary: little-endian unsigned 32-bit integers) and, with decode=True, `decoded`, the text made from
    those ids again. A null text counts as empty: no ids, empty decoded text. Columns of docs with the added names are
    replaced; all others, repeated rows and nulls in them stay as they are. An empty table gives an empty table.
    """
    import pyarrow as pa

    new = [ids, *[decoded] * decode]
    kept = [c for c in docs.columns if c not in new and c != text]
    source = docs.select(*kept, text)
    schema = T.StructType([*(source.schema[c] for c in kept), source.schema[text], T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.StringType())] * decode)])

    def run(batches):
        c = codec(vocabulary)
        for batch in slices(batches):
            encoded = [c.encode(x or "") for x in batch.column(len(kept)).to_pylist()]
            columns = [*batch.columns, pa.array(encoded, pa.binary())]
            if decode:
                columns.append(pa.array([c.decode(x) for x in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Decode an `ids` column as encode_documents makes it; null ids give an empty text. Adds or replaces `decoded`."""
    import pyarrow as pa

    kept = [c for c in encoded.columns if c not in (decoded, ids)]
    source = encoded.select(*kept, ids)
    schema = T.StructType([*source.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        c = codec(vocabulary)
        for batch in slices(batches):
            texts = pa.array([c.decode(x or b"") for x in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return source.mapInArrow(run, schema)

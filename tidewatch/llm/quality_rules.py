"""Quality rules: plain counts of words and lines, and the fertility of a public tokenizer.

A vocabulary that was learned from ordinary prose spends an ordinary number of tokens on it. For every text four
measures are taken: characters per token, the share of tokens that are single bytes (what the vocabulary has no piece
for), the share of tokens without a letter or digit (punctuation and symbols), and the entropy of the text's tokens in
bits. Each is held against a band around the median of its kind in the whole corpus, as wide as a multiple of the median
absolute deviation: characters per token and the shares by language, entropy by language and length octave, since longer
texts use more pieces. Texts without a language are banded by script.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Memo, materialise, slices, words_of

WORDS = 400_000
SYMBOLS = "#*$%&|<>"
#: Half widths of the bands in deviations (from a sample of clean labels, see the README), and the least deviation as a share of the median (for the two shares: as it is).
WIDTH = {"chars_per_token": 12.0, "byte_share": 10.0, "symbol_share": 5.0, "token_entropy": 4.0}
LEAST = 0.01
MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "symbol_share": "double", "token_entropy": "double"}


@lru_cache(maxsize=1)
def _vocabulary(path: str):
    """A memo from words to ids as bytes, which ids are single bytes, and which have characters but no letter or digit."""
    import numpy as np
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    single = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    pieces = [model.id_to_piece(i).lstrip("\u2581") for i in range(len(single))]
    symbol = np.array([x != "" and not any(map(str.isalnum, x)) for x in pieces]) & ~single
    return Memo(lambda word: np.array(model.encode(word), "<u2").tobytes(), WORDS), single, symbol


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    total, end = 0, 0
    for k, w in enumerate(windows):
        if w in twice:
            total += k + 3 - max(end, k)
            end = k + 3
    return total


def measure_text(text: str | None, vocabulary: str) -> tuple:
    """MEASURES of one text; the last four are None without tokens."""
    import numpy as np

    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x and words_of(x)] if "\n" in text else []
    memo, single, symbol = _vocabulary(vocabulary)
    chars = sum(map(len, words))
    ids = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u2")
    out = (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(ids))
    if not len(ids):
        return *out, None, None, None, None
    share = np.bincount(ids)
    byte_share, symbol_share = (float(share[x[: len(share)]].sum() / len(ids)) for x in (single, symbol))
    share = share[share > 0] / len(ids)
    return *out, chars / len(ids), byte_share, symbol_share, max(0.0, float(-(share * np.log2(share)).sum()))


def measure(docs: DataFrame, vocabulary: str, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with MEASURES of every whole text, in place; columns of docs with those names are replaced."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c not in MEASURES and c != text]
    source = docs.select(*kept, text)
    schema = T.StructType([*source.schema.fields[: None if keep_text else -1], *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in MEASURES.items())).fields])
    types = [pa.int64() if v == "long" else pa.float64() for v in MEASURES.values()]

    def run(batches):
        for batch in slices(batches):
            rows = [measure_text(x, vocabulary) for x in batch.column(len(kept)).to_pylist()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(batch.columns) if keep_text else -1], *made], names=schema.names)

    return source.mapInArrow(run, schema)


def script_of(text: Column) -> Column:
    """The script of the first letter, roughly: enough to keep vocabularies' strangers apart."""
    letter = F.regexp_extract(F.coalesce(text, F.lit("")), "\\p{L}", 0)
    kinds = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai"]
    return F.coalesce(*[F.when(letter.rlike(f"\\p{{Is{k}}}"), F.lit(f"script {k}")) for k in kinds], F.lit("script other"))


def judge(measured: DataFrame, kind: Column) -> DataFrame:
    """measured with base_failed, fertility_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. Bands come from all
    rows of a kind that pass that, by approximate percentiles that merge; a text that is alone in its kind is inside.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    octave = F.floor(F.log2("n_words")).cast("int")
    rows = measured.withColumns({"base_failed": base, "_kind": kind, "_octave": octave})
    good = rows.where("NOT base_failed AND n_tokens > 0")
    failed: list[Column] = []
    for keys, names in ((["_kind"], ["chars_per_token", "byte_share", "symbol_share"]), (["_kind", "_octave"], ["token_entropy"])):
        half = lambda c: F.percentile_approx(c, 0.5, 10_000)
        # written tables have a known size: Spark broadcasts them below its threshold and shuffles beyond
        middle = materialise(good.groupBy(*keys).agg(*[half(n).alias(f"_m_{n}") for n in names]), "medians")
        spread = good.join(middle, keys).groupBy(*keys).agg(*[half(F.abs(F.col(n) - F.col(f"_m_{n}"))).alias(f"_d_{n}") for n in names])
        bands = materialise(spread.join(middle, keys), "bands")
        rows = rows.join(bands, keys, "left")
        for name in names:
            m, d = F.col(f"_m_{name}"), F.col(f"_d_{name}")
            wide = WIDTH[name] * F.greatest(d, F.lit(LEAST) if name.endswith("_share") else LEAST * m)
            below, above = F.col(name) < m - wide, F.col(name) > m + wide
            failed.append(F.coalesce({"chars_per_token": below | above, "byte_share": above, "symbol_share": above, "token_entropy": below}[name], F.lit(False)))
    rows = rows.withColumn("fertility_failed", failed[0] | failed[1] | failed[2] | failed[3])
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~F.col("fertility_failed"))
    return rows.drop(*[c for c in rows.columns if c.startswith("_") and c not in measured.columns])


def quality_rules(docs: DataFrame, vocabulary: str, *, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """docs with MEASURES, base_failed, fertility_failed and kept.

    A null text has no words, fails the base rules and isn't kept. A null language is replaced by the text's script.
    Other columns, repeated rows and nulls in them stay; columns with the names added here are replaced. An empty table
    gives an empty table. Measured rows are written once in the shared folder, since bands need all of them.
    """
    kind = F.coalesce(F.col(lang), script_of(F.col(text)))
    docs = docs.drop("_judged_as", "base_failed", "fertility_failed", "kept").withColumn("_judged_as", kind)
    measured = materialise(measure(docs, vocabulary, text=text, keep_text=keep_text), "measured")
    return judge(measured, F.col("_judged_as")).drop("_judged_as")

"""Operators on texts against brute force: quality rules, line dedup, near-duplicates, codec, counts."""

import hashlib
import itertools
import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe_codec, line_dedup, near_duplicates, quality_rules, queries, token_counts
from tidewatch.llm.common import TOKENIZERS

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n\t", "a", "\n\n", "one two three one two three", "é\xa0ß　\x1cx y", "😀 <|endoftext|> it's 123", "x" * 3000, "Word " * 3000]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k % 3 else None, f"s{k % 4}", k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_tokens long")


def all_texts(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark, sf):
    texts = dict(all_texts(spark, sf))
    got = queries.op2_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[1:7]) == base_counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_bands_reject_what_the_vocabulary_does_not_know(spark):
    rng = random.Random(3)
    prose = "the quick brown fox jumps over lazy dogs while seven children watch from their old stone house near river bridge".split()
    texts = [" ".join(rng.choices(prose, k=120)) for _ in range(60)] + [" ".join("".join(rng.choices("ꙮ𐍈𓀀", k=6)) for _ in range(80)), None, ""]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs, f"{TOKENIZERS}/piece_bpe_32k.model").collect()}
    assert out[60].fertility_failed and not out[60].kept and out[60].byte_share > 0.9
    assert not any(out[k].kept for k in (61, 62)) and sum(out[k].kept for k in range(60)) >= 58


def test_quality_bands_reject_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op2_quality_rules(spark, sf).where("NOT base_failed").join(labels, "doc_id", "left").collect()
    junk, clean = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert len(junk) > 20 and sum(junk) <= 1
    assert len(clean) > 300 and sum(clean) >= 0.99 * len(clean)
    assert not any(r.kept for r in rows if 2 * r.n_symbols > r.n_words)


def test_quality_odd_rows(spark):
    docs = docs_of(spark, ODD + ODD).withColumn("kept", F.lit("clash"))
    out = quality_rules.quality_rules(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    assert out.count() == 2 * len(ODD) and out.schema["kept"].dataType.simpleString() == "boolean"
    assert quality_rules.quality_rules(docs.limit(0), f"{TOKENIZERS}/piece_bpe_32k.model").count() == 0


def brute_runs(docs, least):
    """Lines that go, by (id, line): all positions of a run that occurs earlier and has enough words."""
    corpus = [(i, t.split("\n")) for i, t in sorted(docs) if t is not None]
    at = [(d, k) for d, (_, lines) in enumerate(corpus) for k in range(len(lines))]
    gone = set()
    for n, (d, k) in enumerate(at):
        longest = 0
        for e, j in at[:n]:
            size = 0
            while k + size < len(corpus[d][1]) and j + size < len(corpus[e][1]) and corpus[d][1][k + size] == corpus[e][1][j + size]:
                size += 1
            longest = max(longest, size)
        if longest and sum(len(WORD.findall(x)) for x in corpus[d][1][k : k + longest]) >= least:
            gone |= {(corpus[d][0], k + s) for s in range(longest)}
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    lines = ["", "a", "b c", "d e f", "g h i j", "unique"]
    docs = [(k, "\n".join(rng.choice(lines[: 3 + seed]) if rng.random() < 0.9 else f"own {rng.random()}" for _ in range(rng.randrange(1, 9)))) for k in range(12)]
    docs += [(12, docs[3][1] + "\n" + docs[5][1]), (13, "a\n" * 9), (14, None), (15, "")]
    gone = brute_runs(docs, 4)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_lines string")
    got = {r.doc_id: (r.n_lines_removed, r.text) for r in line_dedup.dedup_lines(frame, min_words=4).collect()}
    for i, t in docs:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert got[i] == (sum(a == i for a, _ in gone), left), i


def test_line_dedup_odd_rows(spark):
    docs = spark.createDataFrame([(None, "w " * 60), (1, "w " * 60), (1, "w " * 60), (2, None), (2, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines_removed) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(None, 0), (1, 1), (1, 1), (2, 0), (2, 0)], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_components(docs, size):
    sets = []
    for i, t in docs:
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def test_near_duplicates_whole_table(spark, sf):
    want = brute_components(all_texts(spark, sf), 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_near_duplicates(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_chains_and_large_groups(spark, size, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)  # groups are cut into blocks from here on
    rng = random.Random(size)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts, now = [], list(base)
    for k in range(120):  # a chain of small changes, and variants of the first
        if k % 2:
            now = list(now)
            now[rng.randrange(100)] = f"c{k}"
            texts.append(" ".join(now))
        else:
            texts.append(" ".join(base[:99] + [f"v{k % 40}"]))
    texts += [None, "", "One two", "one TWO", " ".join(base).upper()]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs_of_pairs(spark, docs), size=size).collect()}
    assert got == brute_components(docs, size)


def test_near_duplicates_of_repeated_ids_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    rng = random.Random(8)
    now = [f"w{rng.randrange(5000)}" for _ in range(100)]
    chain = []
    for k in range(90):
        now = list(now)
        now[(7 * k) % 100] = f"c{k}"
        chain.append(" ".join(now))
    docs = [(k, t) for k, t in enumerate(chain) if not 40 <= k < 50]  # two halves that nothing but document 200 links
    docs += [(200, chain[39] + " x"), (200, chain[50] + " x"), (200, chain[50] + " x"), *[(30, chain[30])] * 40]
    rng.shuffle(docs)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs_of_pairs(spark, docs), size=4).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(sorted(set(docs)), 4).items()} and set(got.values()) == {0}


def test_shingles_equal_brute_force():
    import pyarrow as pa

    texts = [*ODD, None, "x" * 200_000 + " y  z " + "q" * 70_000, " One  TWO\nthree\x0bfour five", "one two three four", "É é", "é É", "a\x1cb \x85 c d e f", "Word " * 30_000]
    words = [[re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] for t in texts]
    for size in (1, 4, 5):
        want = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()} for w in words]
        got = near_duplicates.shingle_sets(pa.array(texts, pa.string()), size)
        for (a, x), (b, y) in itertools.combinations(zip(want, map(set, got), strict=True), 2):
            assert len(a) == len(x) and len(b) == len(y) and len(a & b) == len(x & y)
    assert near_duplicates.shingle_sets(pa.array([], pa.string()), 4) == []


def docs_of_pairs(spark, docs):
    return spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, component string")


def test_near_duplicates_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)], key=str)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_codec_equals_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    for (_, text), r in zip(sorted(all_texts(spark, sf)), queries.op5_bpe_codec(spark, sf).orderBy("doc_id").collect(), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codec_odd_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab AB'stre\n\t \x85 1½é漢😀_-<|endoftext|>", k=rng.randrange(40))) for _ in range(400)] + ["<|endoftext|><|endoftext|> x"]
    docs = docs_of(spark, texts).withColumn("ids", F.lit("clash"))
    made = bpe_codec.encode_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", decode=True)
    for r in made.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert struct.unpack(f"<{len(r.ids) // 4}I", r.ids) == tuple(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    again = bpe_codec.decode_documents(made, f"{TOKENIZERS}/byte_bpe_50k.json")
    assert again.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe_codec.encode_documents(docs.limit(0), f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0


def test_token_counts_equal_library(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    cache = str(tmp_path / "cache")
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in all_texts(spark, sf)}
    got = queries.op7_token_counts(spark, sf, cache).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    before = token_counts.read_cache(spark, cache).count()
    queries.op7_token_counts(spark, sf, cache).count()  # nothing is missing now, so nothing is added
    assert token_counts.read_cache(spark, cache).count() == before


def test_word_counts_equal_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(6)
    letters = "abABéÉçÇñßÞ×÷ \n'st<|>endoftext12½²_.,-\0\x1c\x85\xa0İǅﬁ漢😀e\u0301"
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(5000)] + ["x<|startoftext|>y", "it's", "Caffé's", None, "", " \t"]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 14))) for _ in range(5000)] + ["a" * 3000]
    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    counter = token_counts.Counter(f"{TOKENIZERS}/word_bpe_49k.json")
    assert counter.words is not None and token_counts.Counter(f"{TOKENIZERS}/byte_bpe_50k.json").words is None
    assert counter.count(pa.array(texts)).tolist() == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert counter.count(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_odd_texts(spark, tmp_path, file):
    texts = [*ODD, "<|startoftext|>Hello<|endoftext|> <|startoftext|>", "a\x0bb\x1dc d", "İstanbul ǅ ﬁ", *ODD]
    docs = docs_of(spark, texts)
    same = {} if file == "word_bpe_49k.json" else {"normal": lambda c: c}
    got = token_counts.count_tokens(docs, f"{TOKENIZERS}/{file}", str(tmp_path / "cache"), **same).collect()
    assert len(got) == len(texts)
    if file.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{TOKENIZERS}/{file}")
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{file}")
        count = lambda x: len(m.encode(x))
    for r in got:
        assert r.n_tokens == count(r.text or ""), r.text

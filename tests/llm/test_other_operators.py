"""Packing, WARC, vector search, sharding, URL rules and the pipeline against brute force."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import packing, queries, sharding, url_rules, vector_search, warc


def naive_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(left, k) for k, (left, ss, cc) in enumerate(bins) if left >= n and s not in ss and c not in cc]
        if fits:
            k = min(fits)[1]
        else:
            bins.append([capacity, set(), set()])
            k = len(bins) - 1
        out.append((k, capacity - bins[k][0]))
        bins[k][0] -= n
        bins[k][1] |= {s} - {None}
        bins[k][2] |= {c} - {None}
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    for seed in range(20):
        rng = random.Random(seed)
        n = 150
        sizes = sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True)
        sources, clusters = ([rng.choice([None, *range(k)]) for _ in range(n)] for k in (6, 40))
        assert packing.best_fit(sizes, sources, clusters, 60) == naive_best_fit(sizes, sources, clusters, 60)


def test_packing_whole_table(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    total, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_tokens
        if r.n_tokens:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    assert set(total) == set(docs)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert sum(r.n_tokens for r in held) <= 2048
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(held, held[1:], strict=False))
        for key in ("source", "text"):
            values = [v for r in held if (v := docs[r.doc_id][key]) is not None]
            assert len(values) == len(set(values))


def test_packing_keeps_near_copies_apart_and_counts_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("nd", "rst", "lk", "mp")]
    texts = []
    for _ in range(30):
        text = rng.choices(words, k=80)
        texts += [" ".join(text), " ".join([*text[:-1], "changed"])]
    rows = [(None if k in (4, 5) else k, t, f"s{k}") for k, t in enumerate([*texts, texts[0], None, " "])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op1_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    tokenizer = Tokenizer.from_file(f"{queries.TOKENIZERS}/word_bpe_49k.json")
    bin_of = {}
    for r in out:
        if r.doc_id is not None:
            assert r.n_tokens == len(tokenizer.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids)
            bin_of[r.doc_id] = r.bin_id
    assert bin_of[61] is None and bin_of[62] is None
    assert all(bin_of[k] != bin_of[k + 1] for k in range(0, 60, 2) if k != 4) and len({bin_of[0], bin_of[1], bin_of[60]}) == 3
    nameless = [r.bin_id for r in out if r.doc_id is None]
    assert len(nameless) == len(set(nameless)) == 2


def test_packing_odd_rows(spark):
    rows = [(None, "a b", "s", 1), (1, None, "s", 1), (2, "", None, 1), (3, "x " * 5000, None, 1), (4, "a b", "s", 1), (4, "a b", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, piece int")
    out = packing.pack_documents(docs, capacity=2048).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 2, 2, 2, 904, 2048, 2048]
    two = [r.bin_id for r in out if r.n_tokens == 2]
    assert len(set(two)) == 3
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_warc_derivatives(spark, sf):
    pages = {str(r.page_id): r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    records = {r.source_id: bytes(r.record) for r in warc.response_records(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    rows = queries.op6_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        headers, block = warc.parse_record(records[str(r.page_id)])
        payload = block.partition(b"\r\n\r\n")[2]
        assert payload.decode() == (pages[str(r.page_id)].html or "")
        assert r.refers_to == headers["WARC-Record-ID"] and r.target_uri == headers["WARC-Target-URI"]
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert r.content_length == len(r.block.encode()) and "<script" not in (r.block if r.warc_type == "conversion" else "")


def test_warc_text_and_odd_records(spark):
    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><!-- <a href='no'> --><p>One&nbsp;<b>two</b><script>x<y</script></p><a href=\"/l?a=1&amp;b=2\">l</a></body></html>"
    record = warc.response_record("http://e.org/", page, "2024-01-01T00:00:00Z", "<urn:uuid:1>")
    made = warc.derive(record)
    assert made[1][-1] == "One two\nl" and '"title": "T & t"' in made[0][-1] and "/l?a=1&b=2" in made[0][-1] and '"no"' not in made[0][-1]
    headers, block = warc.parse_record(warc.record_bytes(made[1][-2], made[1][-1]))
    assert block.decode() == "One two\nl" and headers["WARC-Refers-To"] == "<urn:uuid:1>"
    other = record.replace(b"WARC-Type: response", b"WARC-Type: request")
    rows = [("a", record), ("a", record), ("b", None), ("c", other), ("d", b""), (None, record[:60])]
    out = warc.derivatives(spark.createDataFrame([(i, r, "x") for i, r in rows], "source_id string, record binary, block string")).collect()
    assert [r.source_id for r in out if r.source_id] == ["a"] * 4
    assert warc.derivatives(spark.createDataFrame([], "source_id string, record binary")).count() == 0


def brute_nearest(rows, k, every):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = (m * m[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:k]
        out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


def test_vector_search_recall_and_order(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want, got = brute_nearest(rows, 20, 20), defaultdict(list)
    by_id = dict(rows)
    for r in queries.op8_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and abs(r.score - np.dot(np.float64(by_id[r.query_id]), np.float64(by_id[r.vec_id]))) < 1e-12
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9


def test_vector_search_recall_beyond_the_sample_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SAMPLE", 400)  # rows that are learned from, of 6000
    monkeypatch.setattr(vector_search, "ROWS", 700)  # so each class of length has several blocks
    monkeypatch.setattr(vector_search, "QUERIES", 64)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(80, 64))
    m = centres[rng.integers(0, 80, 6000)] + 0.6 * rng.normal(size=(6000, 64))
    m *= np.exp(0.4 * rng.normal(size=(6000, 1)))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    got = defaultdict(list)
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20, every=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_vector_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0]), (22, [0.0, 0.0]), (23, None), (24, [None, 1.0]), (25, [float("nan"), 1.0]), (None, [1.0, 1.0]), (26, [float("inf"), 0.0]), (27, [1.0, 1.0])]
    out = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20, every=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 21, 1.0), (0, 2, 27, 1.0), (0, 3, 20, 0.0), (20, 1, 21, 1.0), (20, 2, 27, 1.0), (20, 3, 0, 0.0)]
    assert vector_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def shards_hold(rows, docs, n):
    assert len(rows) == len(docs)
    of, slots = {}, defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert of.setdefault(data, r.shard) == r.shard and 0 <= r.shard < n
        slots[r.shard].append((r.slot, r.size))
    for held in slots.values():
        assert sorted(s for s, _ in held) == list(range(len(held)))
    return {k: sum(n for _, n in v) for k, v in slots.items()}


def test_sharding_whole_table(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sums = shards_hold(queries.op9_sharding(spark, sf).collect(), docs, 40)
    groups = defaultdict(int)
    for x in docs.values():
        groups[x or ""] += len((x or "").encode()) + 16
    mean, largest = sum(groups.values()) / 40, max(groups.values())
    assert max(sums.values()) <= max(1.02 * mean, largest) and len(sums) == 40


def test_best_fit_decreasing_is_near_the_lower_bound():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 1000) for _ in range(600)]
    bins = sharding.best_fit_decreasing(sizes, 12)
    sums = np.bincount(bins, weights=sizes)
    assert sums.max() <= 1.01 * sum(sizes) / 12 and sharding.best_fit_decreasing([], 3) == []
    assert sorted(sharding.best_fit_decreasing([5, 5, 5], 3)) == [0, 1, 2]


def test_sharding_odd_rows(spark, tmp_path):
    rows = [(None, "a"), (1, None), (1, None), (2, ""), (3, "a"), (4, "é" * 1000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, shard int")
    out = sharding.assign_shards(docs.select("doc_id", "text", F.col("shard").alias("size")), 3).collect()
    assert len(out) == 6 and len({r.shard for r in out if r.size == 16}) == 1 and {r.text_crc32 for r in out if r.size == 16} == {0}
    assert sharding.assign_shards(docs.limit(0), 3).count() == 0
    sharding.write_shards(docs.drop("shard"), 3, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


def test_url_rules(spark, sf):
    urls = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    got = {r.page_id: tuple(r[1:]) for r in queries.op10_url_rules(spark, sf).collect()}
    assert got == {i: brute_url(u, queries.URL_RULES) for i, u in urls}


def test_url_rules_nested_and_odd(spark):
    rng = random.Random(2)
    hosts = ["a.b", "b", "x.a.b", "c", "", "b.", ".b", "aa.b"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/p/q/r", "/pp"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(30)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{rng.choice(['', 'W.', 'x.'])}{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', '?q', '#f', '/z'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c", "http://b?x/p", "http://[::1]/p"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, urls[0], "x"), (None, "http://b/p", "y")], "page_id long, url string, host string")
    out = url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULES)).collect()
    assert len(out) == len(urls) + 2
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url, rules), r.url
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, url_rules.RULES)).count() == 0
    none = url_rules.judge_urls(pages, spark.createDataFrame([], url_rules.RULES))
    assert none.count() == len(urls) + 2 and none.where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-duplicates", "best-fit packing"]
    before, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and after.count() <= before.count()
        kept.append({r.doc_id for r in after.select("doc_id").collect()})
        before = after
    good = {r.doc_id for r in queries.quality_rules.quality_rules(docs, f"{queries.TOKENIZERS}/piece_bpe_32k.model").where("kept").collect()}
    assert kept[0] == good and kept[2] <= kept[1] <= kept[0]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept[2]

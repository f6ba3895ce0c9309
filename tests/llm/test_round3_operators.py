"""Code compression, filter audit and substring dedup against brute force, on odd rows as well."""

import hashlib
import json
import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa

from tidewatch.llm import buffers, code_compression, filter_audit, packing, queries, substring_dedup, url_rules, warc

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


# --- code compression


def brute_codes(rows):
    """(by row: code, error; sha) in Python's integers; rows are (id, vector, label) with usable vectors."""
    width = max(1, -(-max(len(v) for _, v, _ in rows) // 16)) * 16
    whole = [[math.floor(Fraction(x) * 256) for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    by_id = {}
    for k, (i, v, _) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[1][1])):
        by_id.setdefault(i, k)
    first = [by_id[i] for i in sorted(by_id, key=lambda i: (i is None, i or 0))[:64]]
    size = width // 16
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(whole[k], p) for k in first] for p in range(16)]

    def nearest(v):
        out = []
        for p in range(16):
            d = [sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)) for c in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(2):
        held = defaultdict(list)
        for v in whole:
            for p, (e, _) in enumerate(nearest(v)):
                held[p, e].append(part(v, p))
        for (p, e), vs in held.items():
            books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [nearest(v) for v in whole]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [("".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for f in found], sha


def check_codes(spark, rows, kind="array<double>"):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], f"vec_id long, embedding {kind}, label string, code string, vector int")
    codes, books = code_compression.compress(df)
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    want, sha = brute_codes(good)
    assert code_compression.codebooks_sha256(books) == sha
    fits = lambda x: x if x < 1 << 63 else None
    by_label = defaultdict(list)
    for (_, _, label), (_, error) in zip(good, want, strict=True):
        by_label[label].append(fits(error))
    total = {k: fits(sum(v)) if None not in v else None for k, v in by_label.items()}
    expected = Counter((r[0], r[2], code, fits(error), total[r[2]]) for r, (code, error) in zip(good, want, strict=True))
    assert Counter((r.vec_id, r.label, r.code, r.error, r.label_error) for r in codes.collect()) == expected


def test_codes_of_odd_vectors(spark):
    rng = random.Random(1)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(k, vector(32), rng.choice(["a", "b", None])) for k in range(90)]
    rows += [rows[3], rows[3], (3, vector(32), "a"), (None, vector(32), None), (None, vector(32), "c"), (100, None, "a"), (101, [None] + vector(31), "a")]
    rows += [(102, [math.nan] + vector(31), "a"), (103, [math.inf] + vector(31), "a"), (104, [-0.0] * 32, "a"), (-5, vector(32), "b")]
    check_codes(spark, rows)
    check_codes(spark, [*rows, (-6, vector(20), "b"), (-7, [], "b"), (200, vector(5), None)])  # widths that differ
    check_codes(spark, [(k, vector(3), "a") for k in range(5)])  # fewer rows than entries, fewer components than parts
    check_codes(spark, [(None, vector(16), "a"), (None, vector(16), "a")])
    check_codes(spark, [(1, [], "a"), (2, [], None)])


def test_codes_of_huge_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([1, -1, 0.5]) * 10.0 ** rng.randrange(0, 9) for _ in range(16)], str(k % 2)) for k in range(70)]
    check_codes(spark, rows)
    rows += [(300, [1.7e308] * 16, "1"), (301, [-1.6e308] * 16, "1"), (302, [2.0**53 + 2] * 16, "0"), (303, [5e-324] * 16, "0"), (304, [-5e-324] * 16, "0")]
    check_codes(spark, rows)


def test_codes_of_no_vectors(spark):
    codes, books = code_compression.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert books is None and codes.count() == 0 and codes.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_sums_of_a_slice_equal_those_of_its_rows():
    rng = np.random.default_rng(3)
    books = rng.integers(-300, 300, (16, 7, 2))
    column = pa.array(rng.normal(size=(1000, 32)).tolist(), pa.list_(pa.float64()))
    for limit in (1 << 21, 16 * 64 * 3):  # one slice, and slices of a few rows
        old, code_compression.CELLS = code_compression.CELLS, limit
        batch = next(code_compression.sums_of([pa.RecordBatch.from_arrays([column], names=["vector"])], books, 32))
        code_compression.CELLS = old
        total = defaultdict(lambda: [0, np.zeros(2, object)])
        for r in batch.to_pylist():
            total[r["slot"]][0] += r["n"]
            total[r["slot"]][1] += np.array([x << (30 * r["limb"]) for x in r["sums"]], object)
        parts = np.floor(np.array(column.to_pylist()) * 256).astype(int).reshape(1000, 16, 2)
        for p in range(16):
            code = ((parts[:, p, None, :] - books[p]) ** 2).sum(axis=2).argmin(axis=1)
            for e in range(7):
                n, sums = total[p * 7 + e]
                assert n == (code == e).sum() and (sums == parts[code == e, p].sum(axis=0)).all()


# --- filter audit


def brute_audit(docs, labels):
    docs = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails = []
    for i, t, _ in docs:
        w = WORD.findall(t)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]})
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for _, _, p in docs}:
        here = [k for k, d in enumerate(docs) if d[2] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = set(here)
            for step, f in enumerate(order):
                gone = {k for k in left if fails[k][f]}
                shapley[f] += len(gone)
                failing = {k for k in here if fails[k][f]}
                out[part, "".join(order), step + 1] = [len(left - gone), len(gone), len(failing - left), sum(sum(fails[k].values()) == 1 for k in failing), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone), f]
                left -= gone
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_documents():
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(400))
    few = "same word " * 300
    texts = [long, few, long.replace("w1", "W"), long + " $", "A" * 70000 + " b" * 250, "é" * 10 + "Ü", "", " \t\n", None, "x\x1cy z", long.replace(" ", "\r\n")]
    docs = [(k, t, rng.choice(["a", "b", None, ""])) for k, t in enumerate(texts * 3)]
    return docs + [docs[0], docs[1], (None, long, "a"), (None, long, "c"), (-1, few, "b"), (-1, long, "c"), (5, "another of this id", "a")]


def test_audit_of_odd_documents(spark):
    docs = odd_documents()
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 30, 2)] + [(4, 1, None), (4, None, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1), (0, 1, 1), (0, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, digest string, part int")
    ls = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, source string")
    assert audited(filter_audit.audit(df, ls)) == brute_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), ls).count() == 0
    assert audited(filter_audit.audit(df, ls.limit(0))) == brute_audit(docs, [])


def test_audit_of_the_table(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert audited(queries.op12_filter_audit(spark, sf)) == brute_audit(docs, labels)


def test_scans_hold_where_hashes_clash_and_blocks_are_small(monkeypatch):
    texts = pa.array([t for _, t, _ in odd_documents()], pa.string())
    want = filter_audit.failures(texts)
    monkeypatch.setattr(filter_audit, "SUMS", 7)
    clash = lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64)
    monkeypatch.setattr(buffers, "hashes", clash)
    found = filter_audit.failures(texts)
    assert found[1] == want[1] and found[0].tolist() == want[0].tolist()


def test_word_hashes_tell_words_apart_and_equal_ones_not():
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "b", "ab", "ba", "é", "z" * 40000, "z" * 32768, "z" * 32769, f"w{rng.randrange(3000)}"]) for _ in range(9000))
    data, _ = buffers.joined(pa.array([text, None, "", text]))
    starts, ends = buffers.words(data)
    words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert words == text.encode().split() * 2
    h = buffers.hashes(data, starts, ends).tolist()
    assert len(set(zip(words, h, strict=True))) == len(set(words)) == len(set(h))
    n = len(words) // 2
    assert len(buffers.differ(data, starts[:n], starts[n:], (ends - starts)[:n])) == 0
    k = [x for x in range(n - 1) if len(words[x]) == len(words[x + 1])]
    odd = buffers.differ(data, starts[k], starts[np.array(k) + 1], (ends - starts)[k])
    assert odd.tolist() == [i for i, x in enumerate(k) if words[x] != words[x + 1]]


# --- substring dedup


def brute_removed(texts, width):
    """(words, removed, kept text) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for k in range(len(w) - width + 1) if n[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def passages():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", f"w{rng.randrange(500)}", f"é{rng.randrange(50)}"])
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(n) for n in (20, 34, 35, 36, 60, 200)]
    texts = [" ".join(x for _ in range(rng.randrange(1, 5)) for x in (make(rng.randrange(0, 80)), rng.choice(shared))) for _ in range(60)]
    texts += [None, "", " \n", "a " * 34, "a " * 35, "b " * 36, "c\t" * 2000, shared[-1].replace(" ", "\n\r "), make(34), make(35), "x" * 70000 + " " + shared[-1], "a\x1cb c " * 50]
    return texts + texts[:3]


def removed(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect())


def test_repeats_of_odd_documents(spark, monkeypatch):
    texts = passages()
    ids = [None if k % 9 == 0 else k // 2 for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, "b", [1]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, a int, b string, spans array<int>").repartition(3)
    for width in (35, 8):
        want = Counter((i, *x) for i, x in zip(ids, brute_removed(texts, width), strict=True))
        assert removed(substring_dedup.remove_repeats(df, width=width)) == want
    want = Counter((i, *x) for i, x in zip(ids, brute_removed(texts, 35), strict=True))
    for name, value in {"HOT": 3, "SHARE": 1 / 500, "BUCKET": 4000, "HOT_BUCKET": 2000, "PIECE": 3000, "SLICE": 9000}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    assert removed(substring_dedup.remove_repeats(df)) == want  # hot minimisers, buckets in pieces
    monkeypatch.setattr(substring_dedup, "HOT", 0)
    monkeypatch.setattr(substring_dedup, "SHARE", 0)
    monkeypatch.setattr(substring_dedup, "BITS", 1 << 15)
    assert removed(substring_dedup.remove_repeats(df)) == want  # all minimisers hot
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_windows_with_clashing_hashes_are_told_apart(monkeypatch):
    texts = [t for t in passages() if t]
    data, starts, ends, cuts = substring_dedup.spaced(pa.array(texts, pa.string()))
    windows = np.concatenate([np.arange(a, max(a, b - 9)) for a, b in zip(cuts, cuts[1:], strict=False)])
    want = {}
    want = [want.setdefault(data[starts[w] : ends[w + 9]].tobytes(), len(want)) for w in windows.tolist()]
    pairs = lambda rank: len(set(zip(want, list(rank), strict=True)))
    assert pairs(substring_dedup.equal_windows(data, starts, ends, windows, 10)) == len(set(want))
    real = substring_dedup.chained
    monkeypatch.setattr(substring_dedup, "chained", lambda h, width: real(h, width) % np.uint64(50))
    assert pairs(substring_dedup.equal_windows(data, starts, ends, windows, 10)) == len(set(want))


def test_super_kmers_hold_every_window_once(monkeypatch):
    texts = [t for t in passages() if t]
    data, starts, ends, cuts = substring_dedup.spaced(pa.array(texts, pa.string()))
    for step, run in ((1 << 20, 256), (100, 7)):
        monkeypatch.setattr(substring_dedup, "STEP", step)
        monkeypatch.setattr(substring_dedup, "RUN", run)
        k = substring_dedup.super_kmers(starts, ends, cuts, data, 35, 5)
        found = Counter((d, w + j) for d, w, n in zip(k.doc.tolist(), k.word.tolist(), k.n.tolist(), strict=True) for j in range(n))
        assert found == Counter((d, j) for d, t in enumerate(texts) for j in range(len(WORD.findall(t)) - 34))
        for d, w, n, s, e in zip(k.doc.tolist(), k.word.tolist(), k.n.tolist(), k.start.tolist(), k.end.tolist(), strict=True):
            assert data[s:e].tobytes().decode().split(" ") == WORD.findall(texts[d])[w : w + n + 34]


def test_repeats_of_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, gone, kept) in zip(docs, brute_removed([t for _, t in docs], 35), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op13_substring_dedup(spark, sf).collect()) == want


# --- records and urls that are odd or long


def test_odd_records_are_derived():
    def of(*lines, http=("Content-Type: text/html",), body=b"<p>caf\xc3\xa9"):
        block = "\r\n".join(["HTTP/1.1 200 OK", *http]).encode() + b"\r\n\r\n" + body
        return warc.derive("\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block)

    for charset in ("idna", "undefined", "nonsense", "hex", "utf-8", '"UTF-8"'):
        assert of("WARC-Type: response", http=(f"Content-Type: text/html; charset={charset}",))[1][-1] == "café"
    assert of("WARC-Type: response", http=("content-TYPE: text/html; Charset=latin-1",))[1][-1] == "cafÃ©"
    for length in ("²", "-1", "x", "", "9" * 30):
        assert of("WARC-Type: response", f"Content-Length: {length}")[1][-1] == "café"
    made = of("warc-type: Response", "WARC-record-id: <urn:1>", "X: 1", "x: 2", "X: 3")
    assert [m[0] for m in made] == ["metadata", "conversion"] and made[0][2] == "<urn:1>"
    head = json.loads(made[0][-1])["warc-header"]
    assert head["X"] == ["1", "3"] and head["x"] == "2"
    assert of("WARC-Type: request") == []


def test_pages_are_scanned_once():
    began = time.time()
    for piece in ("<a", "<a ", "<a '", '<a "', "<script", "<script>", "<title>", "<title", "<!--", "<!", "</", "<a href", "<a href=", "&", "<p"):
        page = piece * (1_000_000 // len(piece))
        warc.derive(warc.response_record("u", page, "d", "i"))
    assert time.time() - began < 30
    assert warc.plain_text("a<b title='1 > 0 < 2'>b</b> <i<b>c</b> d < e <script>x</script >f") == "ab <ic d < e f"
    assert warc.title_of("<title>a &amp; <b></TITLE>") == "a & <b>" and warc.title_of("<title>a") is None


def test_response_ids_depend_on_the_page(spark):
    rows = spark.createDataFrame([(1, "u", "a"), (1, "u", "b"), (1, "u", "b"), (1, "u", None)], "page_id long, url string, html string")
    assert len({warc.parse_record(bytes(r.record))[0]["WARC-Record-ID"] for r in warc.response_records(rows).collect()}) == 3


def test_urls_with_very_many_labels(spark):
    hosts = [".".join(["a"] * 20_000) + ".example.com", "x." * 15_000 + "net", "." * 5000, "com", ".com", "www.example.com"]
    pages = spark.createDataFrame([(k, f"http://{h}/en/x") for k, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, url_rules.RULES)
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: (None, "allow"), 2: (None, "allow"), 3: ("com/", "allow"), 4: ("com/", "allow"), 5: ("www.example.com/en/", "allow")}
    assert time.time() - began < 60


def test_repeated_rows_are_spread_over_parts(spark):
    rows = [(1, "src", "a b c")] * 9000 + [(k, None, "d e") for k in range(2000)] + [(None, None, None)] * 3
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), capacity=10).collect()
    assert len(out) == len(rows) and sum(r.bin_id is None for r in out) == 3
    copies = Counter(r.bin_id for r in out if r.doc_id == 1 and r.n_tokens == 3)
    assert sum(copies.values()) == 9000 and max(copies.values()) == 1
    parts = Counter(b >> 32 for b in copies)
    assert len(parts) == 11003 // packing.PART + 1 and max(parts.values()) < 2 * 9000 / len(parts)

"""Stations named in texts against a plain search, and rows of guides."""

import random
import re

from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import guides

KNOWN = [(0, "Avoca River at Amphitheatre", 1.0, 2.0, 3.0), (1, "avoca river at amphitheatre", 9.0, 9.0, 9.0), (2, "Creek", 1.0, None, None), (3, "My Ck at Oak", 1.0, 2.0, 3.0), (4, "Avoca River at Charlton Weir", 4.0, 5.0, 6.0), (5, "Rich's Creek at the D", 1.0, 2.0, 3.0), (6, "Ovo at Far", 1.0, 2.0, 3.0), (7, " ", 1.0, 2.0, 3.0), (8, None, 1.0, 2.0, 3.0)]


def known(spark):
    return guides.stations(spark.createDataFrame(KNOWN, "seq long, name string, minor double, moderate double, major double"))


def test_stations(spark):
    rows = {r.seq: (r.river, r.tokens) for r in known(spark).collect()}
    assert rows == {0: ("avoca river", ["amphitheatre"]), 2: ("creek", []), 3: ("my ck", ["oak"]), 4: ("avoca river", ["charlton"]), 5: ("richs creek", []), 6: ("ovo", ["far"])}


def test_candidates_equal_a_search(spark):
    rng = random.Random(3)
    parts = ["avoca", "river", "avoca river", "xavoca riverx", "amphitheatre", "charlton", "creek", "creeks", "my", "ck", "my ck", "army ckx", "oaks", "richs creek at the d", "ovo at far", "a" * 50]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(300)] + [None, "", "x" * 100_000 + " avoca river charlton"]
    stations = [r.asDict() for r in known(spark).collect()]
    want = {(k, s["seq"]) for k, t in enumerate(texts) if t is not None for s in stations if len(s["river"]) >= 4 and s["river"] in t and (any(w in t for w in s["tokens"]) if s["tokens"] else s["norm"] in t)}
    got = guides.candidates(spark.createDataFrame(list(enumerate(texts)), "context long, text string"), known(spark)).collect()
    assert len(want) > 200 and len(got) == len(want) and {tuple(r) for r in got} == want


def test_plain_equals_a_plain_pattern(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(" ab9,-'\u2019\u00e9\n\tZ") for _ in range(rng.randrange(30))) for _ in range(3000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.plain(F.col("t")).alias("p")).collect():
        assert r.p == re.sub("[^a-z0-9]+", " ", re.sub("['\u2019]", "", r.t.lower())).strip(" ")


def test_texts_of_decided_units_are_not_searched(spark, monkeypatch):
    """Of three texts of each unit only as many are searched as it takes to find a station."""
    tables, write = [], guides.written
    monkeypatch.setattr(guides, "written", lambda df, name: (tables.append((name, out := write(df, name))), out)[1])
    units = spark.createDataFrame([(k, "x", None, None, None) for k in range(40)], "unit long, file string, minor double, moderate double, major double")
    rows = [(k, step, True, "Avoca River, Charlton" if step == k % 4 else "none") for k in range(40) for step in range(3)]
    got = guides.best_station(units, spark.createDataFrame(rows, "unit long, step int, page boolean, text string"), known(spark)).collect()
    assert {(r.unit, r.seq, r.step) for r in got} == {(k, 4, k % 4) for k in range(40) if k % 4 < 3}
    assert sum(t.select("context").distinct().count() for name, t in tables if name == "words") == 40 + 30 + 20


def test_best_station(spark):
    units = [("a", "Charlton guide", 1.1, None, None), ("b", "guide", 1.0, 2.1, 9.0), ("c", "guide", None, None, None), ("d", "x", None, None, None), ("e", None, None, None, None)]
    both = "Avoca River, Amphitheatre and Charlton"
    contexts = [("a", 0, True, both), ("b", 0, True, both), ("c", 0, True, "nothing"), ("c", 1, True, None), ("c", 2, False, both), ("c", 3, False, "Creek"), ("d", 0, True, "no river"), ("e", 0, True, "the CREEK's")]
    u = spark.createDataFrame(units, "unit string, file string, minor double, moderate double, major double")
    c = spark.createDataFrame(contexts, "unit string, step int, page boolean, text string")
    got = {r.unit: (r.seq, r.step, r.score) for r in guides.best_station(u, c, known(spark)).collect()}
    assert got == {"a": (4, 0, 6), "b": (0, 0, 9), "c": (0, 2, 0), "e": (2, 0, 1)}


def test_rows_of_pages(spark):
    page = "Intro\n 2.5 m\n\nMinor flood level.  Low\tpaths\nclose 2012 flood observations x\n52.43 m\n10.59\n3 m AHD\nMajor flood level\n4 metres or *\n7m\n12\nBridge closed\n3\nShops\n"
    rows = guides.page_rows(spark.createDataFrame([("p", page), ("q", None), ("r", ""), ("s", "1 m")], "unit string, text string"))
    assert [(r.unit, r.n, r.height_m, r.impact) for r in rows.collect()] == [("p", 0, 2.5, "Minor flood level.  Low\tpaths close 2012 flood observations x"), ("p", 1, 10.59, "Major flood level"), ("p", 2, 12.0, "Bridge closed 3 Shops")]
    clean = guides.cleaned(rows.unionByName(spark.createDataFrame([("p", 9, 1.0, "Floodwater can kill"), ("p", 10, 151.0, "Too high"), ("p", 11, 1.0, "abc")], rows.schema)))
    assert [(r.height_m, r.impact) for r in clean.collect()] == [(2.5, "Minor flood level. Low paths close"), (10.59, "Major flood level"), (12.0, "Bridge closed 3 Shops")]
    assert [tuple(r) for r in guides.levels(clean).collect()] == [("p", 2.5, None, 10.59)]
    best = spark.createDataFrame([("p", 4, 0, 0), ("q", 4, 0, 0)], "unit string, seq int, step int, score int")
    again = clean.unionByName(spark.createDataFrame([("q", 0, 12.0, "bridge CLOSED 3 shops"), ("q", 1, 12.0, "Other")], clean.schema))
    assert sorted((r.seq, r.height_m, r.impact) for r in guides.impacts(again, best).collect()) == [(4, 2.5, "Minor flood level. Low paths close"), (4, 10.59, "Major flood level"), (4, 12.0, "Bridge closed 3 Shops"), (4, 12.0, "Other")]

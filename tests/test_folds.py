"""What depends on what was shown or accepted before, against walks in Python."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewatch.operators import folds

T0 = dt.datetime(2026, 8, 11, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def brute_shown(rows, stored, minutes):
    last = defaultdict(list)
    for k, t in stored:
        last[k].append(t)
    out, width = [], dt.timedelta(minutes=minutes)
    for r in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        if not any(t <= r[1] <= t + width for t in last[r[0]]):
            out.append(r)
            last[r[0]].append(r[1])
    return Counter(out + [r for r in rows if r[0] is None or r[1] is None])


def shown(spark, rows, stored=None, minutes=30):
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long")
    before = spark.createDataFrame(stored, "k string, ts timestamp_ntz") if stored is not None else None
    return Counter(map(tuple, folds.spaced(df, ["k"], "ts", "seq", minutes, before).collect()))


def test_a_chain_is_shown_now_and_then(spark):
    chain = [("a", at(20 * k), k) for k in range(9)]
    assert sorted(r[2] for r in shown(spark, chain)) == [0, 2, 4, 6, 8]
    assert sorted(r[2] for r in shown(spark, chain, [("a", at(-20)), ("a", at(61)), ("b", at(0))])) == [1, 3, 5, 7]
    assert shown(spark, [], [("a", at(0))]) == Counter()


def test_shown_equals_a_walk(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([at(rng.randrange(4000)), at(rng.random() * 900), at(30 * rng.randrange(100)), None]), k) for k in range(1500)]
    stored = [(rng.choice(["a", "b", "z", None]), rng.choice([at(rng.randrange(4000)), at(30 * rng.randrange(100)), None])) for _ in range(40)]
    for minutes in (7, 30):
        assert shown(spark, rows, None, minutes) == brute_shown(rows, [], minutes)
        known = [s for s in stored if None not in s]
        assert shown(spark, rows, stored, minutes) == brute_shown(rows, known, minutes)


def brute_accepted(rows, base, jump, ceiling):
    last, out = dict(base), []
    for k, t, seq, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or T0, r[2])):
        if h is None or h != h:
            out.append(seq)
        elif k is None or t is None:
            out += [seq] * (h <= ceiling)
        else:
            s = last.get(k)
            if h <= ceiling if s is None else abs(h - s) <= jump:
                out.append(seq)
                if h <= ceiling:
                    last[k] = h
    return sorted(out)


def test_accepted_equals_a_walk(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([rng.uniform(0, 300), 25.0 * rng.randrange(50), rng.uniform(840, 1000), None, float("nan"), -5.0])
    rows = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([at(rng.randrange(20_000)), at(60 * rng.randrange(200)), at(rng.randrange(20_000)), None]) if rng.random() < 0.95 else None, k, value()) for k in range(1500)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, h double")
    base = {"b": 280.0, "z": 1.0}
    for known in ({}, base):
        before = spark.createDataFrame(list(known.items()), "k string, height double") if known else None
        for part in (F.to_date("ts"), F.date_trunc("hour", "ts")):
            got = folds.accepted(df, ["k"], ["ts", "seq"], "h", part, baseline=before)
            assert got.columns == df.columns
            assert sorted(r.seq for r in got.collect()) == brute_accepted(rows, known, 50.0, 900.0)


def test_a_spike_does_not_make_its_successor_one(spark):
    rows = [("a", at(k), k, h) for k, h in enumerate([2.0, 990.0, 2.1, 60.0, 2.2, None, 51.0, 990.0])] + [("b", at(0), 10, 950.0), ("b", at(1), 11, 899.0), ("b", at(2), 12, 940.0), ("b", at(3), 13, 950.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, h double")
    assert sorted(r.seq for r in folds.accepted(df, ["k"], ["ts", "seq"], "h", F.to_date("ts")).collect()) == [0, 2, 4, 5, 6, 11, 12]

"""Questions in which each answer depends on the answers before it: what was shown, what was accepted last.

Neither walks a key from end to end in one task. Rows to be shown point to the next row that could be shown after them,
and those that can be reached from a key's first ones are found by doubling the pointers. Readings are judged in slices
of time, each of which first says what it would make of any last reading, so that only these answers, a few for each
slice, are put in order for each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.functions.shared import written


def _full(keys: list[str]) -> Column:
    """No key column is null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def unblocked(events: DataFrame, stored: DataFrame, keys: list[str], ts: str, minutes: int) -> DataFrame:
    """Events that no stored event of their key precedes by so many minutes or less; one at the same instant precedes, too.

    Bins are as wide as that, so an event looks at two of them, of which their first and last stored times are enough.
    """
    width = minutes * 60_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = stored.where(_full(keys) & F.col(ts).isNotNull()).groupBy(*keys, F.floor(us / width).alias("_bin")).agg(F.min(us).alias("_low"), F.max(us).alias("_high"))
    here, before = ends.select(*keys, "_bin", "_low"), ends.select(*keys, (F.col("_bin") + 1).alias("_bin"), "_high")
    rows = events.withColumn("_bin", F.floor(us / width)).join(here, [*keys, "_bin"], "left").join(before, [*keys, "_bin"], "left")
    blocked = F.coalesce(F.col("_low") <= us, F.lit(False)) | F.coalesce(F.col("_high") >= us - width, F.lit(False))
    return rows.where(~blocked).select(events.columns)


def next_apart(times: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """(keys, t, next, first): for each distinct time t in microseconds of a key the first one over so many minutes later, and if none is as near before it.

    Windows hold one key's bin, as wide as the minutes; a second one over a key has one row for each bin in use.
    """
    width = minutes * 60_000_000
    bin_of = lambda c: F.floor(c / width).cast("long")
    own = times.select(*keys, "t", F.col("t").alias("at"), F.lit(True).alias("event"))
    asks = times.select(*keys, "t", (F.col("t") + width).alias("at"), F.lit(False).alias("event"))
    both = own.unionByName(asks).withColumn("bin", bin_of(F.col("at")))
    inside = Window.partitionBy(*keys, "bin")
    later = F.min(F.when(F.col("event"), F.col("t"))).over(inside.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1))
    sooner = F.max(F.when(F.col("event"), F.col("t"))).over(inside.orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    both = both.withColumns({"later": later, "sooner": sooner})
    bins = both.groupBy(*keys, "bin").agg(F.min(F.when(F.col("event"), F.col("t"))).alias("low"), F.max(F.when(F.col("event"), F.col("t"))).alias("high"))
    row = Window.partitionBy(*keys)
    bins = bins.select(*keys, "bin", F.min("low").over(row.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"), F.max("high").over(row.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    both = both.join(bins, [*keys, "bin"])
    gap = F.col("t") - F.coalesce("sooner", "before")
    return both.groupBy(*keys, "t").agg(F.max(F.when(~F.col("event"), F.coalesce("later", "after"))).alias("next"), F.bool_or(F.when(F.col("event"), gap.isNull() | (gap > width))).alias("first"))


def spaced(events: DataFrame, keys: list[str], ts: str, seq: str, minutes: int, stored: DataFrame | None = None) -> DataFrame:
    """Events to show, one after the other: each over so many minutes after the last one of its key that was shown.

    What isn't shown holds nothing back, so a chain of events goes on being shown now and then. Events shown before
    (`stored`, with keys and ts) hold back those that come as soon after them. Of events at one instant the first by seq
    is shown; those without a key or a time always are.

    An event over the minutes after all others is shown in any case; from these, what can be reached by pointers to the
    next possible event is found in a number of joins that grows with the logarithm of the longest chain.
    """
    whole = _full(keys) & F.col(ts).isNotNull()
    rows = events.where(whole)
    if stored is not None:
        rows = unblocked(rows, stored, keys, ts, minutes)
    rows = rows.withColumn("t", F.unix_micros(F.col(ts).cast("timestamp")))
    rest = [c for c in events.columns if c not in keys]
    rows = written(rows.groupBy(*keys, "t").agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row")), "events")
    steps = written(next_apart(rows.select(*keys, "t"), keys, minutes), "steps")
    shown = steps.where("first").select(*keys, "t")
    # pointers to events that are shown in any case lead nowhere new
    jumps = steps.where("next IS NOT NULL").select(*keys, "t", "next")
    jumps = jumps.join(shown.withColumnRenamed("t", "next"), [*keys, "next"], "left_anti")
    while not (jumps := written(jumps, "jumps")).isEmpty():
        reached = shown.join(jumps, [*keys, "t"]).select(*keys, F.col("next").alias("t"))
        shown = written(shown.union(reached).distinct(), "shown")
        jumps = jumps.join(jumps.select(*keys, F.col("t").alias("next"), F.col("next").alias("then")), [*keys, "next"]).select(*keys, "t", F.col("then").alias("next"))
    kept = rows.join(shown, [*keys, "t"], "left_semi").select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in events.columns])
    return kept.unionByName(events.where(~whole))


SLICE = "array<struct<height:double,end:double>>"


class _Cover:
    """The numbers that lie within `reach` of those added so far, as sorted intervals; a little less is counted, so that none is taken for covered that isn't."""

    def __init__(self, reach: float):
        self.reach, self.slack, self.low, self.high = reach, reach * 1e-9, [], []

    def adds(self, x: float) -> bool:
        """Add x; whether anything is within its reach that wasn't within others'."""
        from bisect import bisect_left, bisect_right

        low, high = x - self.reach, x + self.reach
        k = bisect_right(self.low, low) - 1
        if k >= 0 and self.high[k] >= high:
            return False
        low, high = low + self.slack, high - self.slack
        i, j = bisect_left(self.high, low), bisect_right(self.low, high)
        if i < j:
            low, high = min(low, self.low[i]), max(high, self.high[j - 1])
        self.low[i:j], self.high[i:j] = [low], [high]
        return True


def _slices(batches, n_keys: int, jump: float, ceiling: float):
    """For each slice of sorted (keys, slice, height) the heights that some last reading would accept first, in order, with the baseline that follows in the end; the first is for no last reading.

    A slice streams through: what is held are those heights and the few baselines in play.
    """
    import pyarrow as pa

    last, first, cover, groups = None, [], None, {}

    def line():
        ends = {x: s for s, xs in groups.items() for x in xs}
        return (*last, [{"height": first[x] if x else None, "end": ends.get(x)} for x in range(len(first))])

    out: list = []
    schema = None
    for batch in batches:
        if schema is None:
            schema = pa.schema([*[batch.schema.field(k) for k in range(n_keys + 1)], ("entries", pa.list_(pa.struct([("height", pa.float64()), ("end", pa.float64())])))])
        for *key, h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != last:
                if last is not None:
                    out.append(line())
                # entry 0 is the start without a last reading; baselines map to the entries that have come to them
                last, first, cover, groups = key, [None], _Cover(jump), {None: [0]}
            if h > ceiling:
                continue
            near = [s for s in groups if s is None or abs(h - s) <= jump]
            met = [x for s in near for x in groups.pop(s)]
            if cover.adds(h):
                met.append(len(first))
                first.append(h)
            if met:
                groups.setdefault(h, []).extend(met)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out = []
    if last is not None:
        out.append(line())
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def accepted(readings: DataFrame, keys: list[str], order: list[str], value: str, part: Column, *, jump: float = 50.0, ceiling: float = 900.0, baseline: DataFrame | None = None) -> DataFrame:
    """Readings without spikes: those within `jump` of the last reading of their key that was accepted.

    Without an earlier reading those up to `ceiling` are accepted; one above it may be, near the last, but isn't what later
    ones are compared with. Null values pass and change nothing. `part` cuts the order into slices (a day, say): a value
    that never falls along `order`. `baseline` has a key's last height (keys, height) from before. Readings whose key or
    place in the order is null have no history.

    Each slice says for which last heights it accepts which of its readings first, and what the last one is in the end;
    these answers are chained for each key, and then every slice is walked once with the height it starts from.
    """
    names = [f"_k{k}" for k in range(len(keys))]
    whole = _full([*keys, *order]) & part.isNotNull()
    number = F.when(~F.isnan(value), F.col(value).cast("double"))
    rows = readings.where(whole & number.isNotNull()).withColumns({"_part": part, "_value": number})
    slim = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_part", *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], "_value")
    dealt = slim.repartition(*names, "_part").sortWithinPartitions(*names, "_part", *[f"_o{k}" for k in range(len(order))]).select(*names, "_part", "_value")
    answers = T.StructType([*dealt.schema.fields[:-1], T.StructField("entries", T._parse_datatype_string(SLICE))])
    n = len(keys)
    slices = dealt.mapInArrow(lambda batches: _slices(batches, n, jump, ceiling), answers)
    before = F.lit(None).cast("double")
    if baseline is not None:
        slices = slices.join(baseline.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("height").cast("double").alias("_base")), names, "left")
        before = F.first("_base")
    chain = slices.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_part", "entries"))).alias("all"), before.alias("base"))

    def follow(state: Column, x: Column) -> Column:
        """The height after a slice, and the list of slices with the heights that they start from."""
        s = state["height"]
        hit = F.get(F.filter(x["entries"], lambda e: F.abs(e["height"] - s) <= jump), F.lit(0))
        end = F.when(s.isNull(), F.get(x["entries"], F.lit(0))["end"]).otherwise(F.coalesce(hit["end"], s))
        return F.struct(end.alias("height"), F.concat(state["starts"], F.array(F.struct(x["_part"].alias("_part"), s.alias("_start")))).alias("starts"))

    kind = dict(dealt.dtypes)["_part"]
    start = F.struct(F.col("base").alias("height"), F.array().cast(f"array<struct<_part:{kind},_start:double>>").alias("starts"))
    starts = chain.select(*names, F.explode(F.aggregate("all", start, follow)["starts"]).alias("x")).select(*names, "x._part", "x._start")
    back = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    joined = rows.join(starts.withColumnRenamed("_part", "_p"), [*back, F.col("_part") == F.col("_p")]).select(*rows.columns, "_start")
    sorted_rows = joined.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", *order)
    at = [sorted_rows.columns.index(c) for c in (*keys, "_part", "_value", "_start")]

    def judge(batches):
        import pyarrow as pa

        last, s = None, None
        for batch in batches:
            keep = []
            for *key, h, first in zip(*[batch.column(k).to_pylist() for k in at], strict=True):
                if key != last:
                    last, s = key, first
                ok = h <= ceiling if s is None else abs(h - s) <= jump
                if ok and h <= ceiling:
                    s = h
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = sorted_rows.mapInArrow(judge, sorted_rows.schema).select(readings.columns)
    odd = readings.where(~whole & (number.isNull() | (number <= ceiling)))
    return kept.unionByName(readings.where(whole & number.isNull())).unionByName(odd)

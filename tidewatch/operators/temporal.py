"""Latest, as-of, previous, overlapping, first after: questions about time, keyed and without unbounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`; partial aggregation, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_with_ties(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All rows of each key at its greatest time."""
    top = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(top, [*keys, ts], "left_semi")


def state_at(journal: DataFrame, when: Column, *, include_inactive: bool = False, keys: tuple[str, ...] = ("source", "entity_key")) -> DataFrame:
    """The state of every entity at a time, that instant included; ended ones only on request."""
    rows = latest(journal.where(F.col("effective_ts") <= when), list(keys), ["effective_ts", "seq"])
    return rows if include_inactive else rows.where("active = 1")


def states_between(journal: DataFrame, start: Column, end: Column) -> DataFrame:
    return journal.where(F.col("effective_ts").between(start, end))


def change_times(journal: DataFrame, start: Column, end: Column) -> DataFrame:
    return states_between(journal, start, end).select("effective_ts").distinct()


def asof_series(instants: DataFrame, series: DataFrame, *, at: str = "at", ts: str = "ts", order: list[str] | None = None, max_age_s: int = 21_600, bins: int = 64) -> DataFrame:
    """instants with the last row of the series at or before each, not older than max_age_s; nulls where there is none.

    Time is cut into bins, `bins` of them to the greatest age. An instant takes the last row before it in its own bin, by
    a window over both; without one it looks at the last rows of the bins before, one row to each. Nothing meets in
    pairs, so neither dense series nor many instants multiply.
    """
    order = order or [ts]
    rest = [c for c in series.columns if c not in instants.columns]
    width = max_age_s * 1_000_000 // bins
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    row = F.struct(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)]).alias("order"), F.col(ts).alias("ts"), F.struct(*rest).alias("values"))
    held = series.where(F.col(ts).isNotNull()).select(bin_of(ts).alias("_bin"), F.col(ts).alias("_at"), row.alias("_row"))
    asked = instants.where(F.col(at).isNotNull()).select(bin_of(at).alias("_bin"), F.col(at).alias("_at")).distinct()
    none = F.lit(None).cast(held.schema["_row"].dataType)
    inside = Window.partitionBy("_bin").orderBy(F.col("_at"), F.col("_row.order").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = held.withColumn("_asks", F.lit(False)).unionByName(asked.withColumns({"_row": none, "_asks": F.lit(True)}))
    own = both.withColumn("_found", F.last("_row", ignorenulls=True).over(inside)).where("_asks").select("_bin", "_at", "_found")
    tops = held.groupBy("_bin").agg(F.max_by("_row", "_row.order").alias("_top"))
    bins_before = F.when(F.col("_found").isNull(), F.sequence(F.col("_bin") - bins - 1, F.col("_bin") - 1)).otherwise(F.array(F.lit(None).cast("long")))
    probes = own.select("_at", "_found", F.explode(bins_before).alias("_bin")).join(tops, "_bin", "left")
    found = probes.select("_at", F.coalesce("_found", "_top").alias("_found")).groupBy("_at").agg(F.max_by("_found", "_found.order").alias("_found"))
    found = found.where(F.col("_found.ts") >= F.col("_at") - F.make_dt_interval(secs=F.lit(max_age_s))).select(F.col("_at").alias(at), F.col("_found.values").alias("_values"))
    return instants.join(found, at, "left").select(*instants.columns, *[F.col(f"_values.{c}").alias(c) for c in rest])


def with_previous(df: DataFrame, keys: list[str], ts: str, seq: str, values: list[str]) -> DataFrame:
    """df with prev_<value>: each value of the key's previous row by (ts, seq); null in its first row.

    Windows hold one day of one key; what precedes a day's first row comes from a table with one row for each key and
    day, so a key with a third of all rows is spread over its days.
    """
    prev = [f"prev_{v}" for v in values]
    rows = df.withColumn("_day", F.to_date(ts))
    inside = Window.partitionBy(*keys, "_day").orderBy(ts, seq)
    rows = rows.withColumn("_first", F.row_number().over(inside) == 1)
    rows = rows.withColumns({p: F.lag(v).over(inside) for p, v in zip(prev, values, strict=True)})
    last = rows.groupBy(*keys, "_day").agg(F.max_by(F.struct(*values), F.struct(ts, seq)).alias("_end"))
    days = last.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_day"))).drop("_end")
    rows = rows.join(days, [*keys, "_day"], "left")
    carried = {p: F.when(F.col("_first"), F.col(f"_before.{v}")).otherwise(F.col(p)) for p, v in zip(prev, values, strict=True)}
    return rows.withColumns(carried).select(*df.columns, *prev)


def reset_total(df: DataFrame, keys: list[str], ts: str, seq: str, value: str) -> DataFrame:
    """Total growth of a counter that may restart: falls count from zero, the first reading is the baseline, nulls are skipped."""
    rows = with_previous(df.where(F.col(value).isNotNull()), keys, ts, seq, [value])
    step = F.when(F.col(f"prev_{value}").isNull(), 0.0).when(F.col(value) >= F.col(f"prev_{value}"), F.col(value) - F.col(f"prev_{value}")).otherwise(F.col(value))
    return rows.groupBy(*keys).agg(F.sum(step).alias("total"), F.count("*").alias("readings"))


def overlaps(intervals: DataFrame, windows: DataFrame, *, days: int = 7) -> DataFrame:
    """Pairs of an interval (start, end) and a window (w_start, w_end) that share an instant, ends included.

    Both are dealt to bins of `days` days; a pair counts in the bin where the later of the two begins.
    """
    size = days * 86_400_000_000
    b = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / size)
    left = intervals.where("start <= end").withColumn("_bin", F.explode(F.sequence(b("start"), b("end"))))
    right = windows.where("w_start <= w_end").withColumn("_bin", F.explode(F.sequence(b("w_start"), b("w_end"))))
    pairs = left.join(right, "_bin").where((F.col("start") <= F.col("w_end")) & (F.col("end") >= F.col("w_start")))
    return pairs.where(F.col("_bin") == F.greatest(b("start"), b("w_start"))).drop("_bin")


def first_hit(asked: DataFrame, series: DataFrame, key: str, id: str) -> DataFrame:
    """(id, hit_ts): the first time after asked.after at which the key's height reaches asked.target; ids without one are absent.

    Days are tried by their greatest heights first; only the day of the hit is searched row by row.
    """
    asked = asked.select(id, key, "after", "target")
    rows = series.select(key, "ts", "height", F.to_date("ts").alias("day"))
    tops = rows.groupBy(key, "day").agg(F.max("height").alias("top"))
    same = asked.withColumn("day", F.to_date("after")).join(rows, [key, "day"]).where("ts > after AND height >= target").groupBy(id).agg(F.min("ts").alias("hit_ts"))
    later = asked.join(same, id, "left_anti").join(tops, key).where("day > to_date(after) AND top >= target").groupBy(id, key, "target").agg(F.min("day").alias("day"))
    later = later.join(rows, [key, "day"]).where("height >= target").groupBy(id).agg(F.min("ts").alias("hit_ts"))
    return same.unionByName(later)

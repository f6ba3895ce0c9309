"""Idempotent tables and their changes: insert once, merge, sweep, journal, compare snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.temporal import latest, with_previous


def append_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; a column that one lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)


def new_rows(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """What an insert adds: rows whose key isn't stored, the first by seq of each; keys with a null never clash."""
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    rest = [c for c in new.columns if c not in keys]
    once = new.where(full).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row"))
    once = once.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in new.columns])
    return once.join(old.where(full).select(*keys), keys, "left_anti").unionByName(new.where(~full)).select(new.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """The table after new rows replaced or joined old ones; first_seen stays, last_seen is now for what came."""
    values = [c for c in new.columns if c != key]
    left = old.select(F.col(key), F.struct(*values, "first_seen", "last_seen").alias("_old"))
    right = new.select(F.col(key), F.struct(*values).alias("_new"))
    both = left.join(right, key, "full_outer")
    came = F.col("_new").isNotNull()
    out = [F.when(came, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values]
    return both.select(key, *out, F.coalesce(F.col("_old.first_seen"), now).alias("first_seen"), F.when(came, now).otherwise(F.col("_old.last_seen")).alias("last_seen"))


def sweep(table: DataFrame, feed: DataFrame, key: str, now: Column, *, empty_means_none: bool = False) -> DataFrame:
    """table with resolved = 1 and last_seen = now where an open row is absent from the feed.

    An empty feed resolves nothing, as if it had failed, unless empty_means_none.
    """
    there = feed.select(key).distinct().withColumn("_there", F.lit(True))
    some = feed.agg((F.count("*") > 0).alias("_some"))
    gone = F.col("_there").isNull() & (F.col("resolved") == 0)
    rows = table.join(there, key, "left").crossJoin(F.broadcast(some))
    if not empty_means_none:
        gone = gone & F.col("_some")
    return rows.withColumns({"last_seen": F.when(gone, now).otherwise(F.col("last_seen")), "resolved": F.when(gone, 1).otherwise(F.col("resolved"))}).select(table.columns)


def sync_outages(open_rows: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Open outages by location after a poll: seen ones updated, new ones opened, absent ones restored with their minutes."""
    left = open_rows.select("location", F.struct("customers", "first_seen").alias("_old"))
    right = current.select("location", F.struct("customers").alias("_new"))
    both = left.join(right, "location", "full_outer")
    back = F.col("_new").isNull()
    first = F.coalesce(F.col("_old.first_seen"), now)
    minutes = F.when(back, F.round(F.timestamp_diff("SECOND", first, now) / 60))
    return both.select("location", F.coalesce("_new.customers", "_old.customers").alias("customers"), first.alias("first_seen"), back.cast("int").alias("restored"), minutes.alias("duration_mins"))


def journal_rows(states: DataFrame, keys: list[str], ts: str, seq: str, what: str) -> DataFrame:
    """Rows whose `what` differs from the one before it, of the same key; the first of a key always counts."""
    rows = with_previous(states, keys, ts, seq, [what, seq])
    return rows.where(F.col(f"prev_{seq}").isNull() | ~F.col(what).eqNullSafe(F.col(f"prev_{what}")))


def journal_batch(journal: DataFrame, batch: DataFrame, now: Column, *, complete: bool = True, tombstone_time: str = "source") -> DataFrame:
    """Rows that a batch (source, entity_key, effective_ts, state, state_hash, seq) adds to a journal.

    An entity is written if its hash isn't the last one; with complete=True those of the batch's sources that are
    active and absent get an inactive row, at their last own time or, with tombstone_time="recorded", now.
    """
    last = latest(journal, ["source", "entity_key"], ["effective_ts", "seq"])
    known = last.select("source", "entity_key", F.struct("active", "state_hash").alias("_last"))
    came = batch.withColumn("active", F.lit(1)).join(known, ["source", "entity_key"], "left")
    added = came.where(F.col("_last").isNull() | (F.col("_last.active") != 1) | (F.col("_last.state_hash") != F.col("state_hash"))).drop("_last")
    if not complete:
        return added
    ended = last.where("active = 1").join(batch.select("source").distinct(), "source", "left_semi").join(batch.select("source", "entity_key"), ["source", "entity_key"], "left_anti")
    ended = ended.withColumns({"active": F.lit(0), "effective_ts": F.col("effective_ts") if tombstone_time == "source" else now, "seq": F.col("seq") + 1})
    return added.unionByName(ended.select(added.columns))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, priority: str) -> DataFrame:
    """(key, change, before, after): new, cleared, escalated (a smaller number) and eased alerts between two snapshots."""
    left, right = before.select(key, F.col(priority).alias("before")), after.select(key, F.col(priority).alias("after"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "cleared").when(F.col("after") < F.col("before"), "escalated").when(F.col("after") > F.col("before"), "eased")
    return left.join(right, key, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(key, "change", "before", "after")

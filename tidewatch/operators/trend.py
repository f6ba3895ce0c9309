"""Rates of rise: least squares, acceleration, arrival times, and how projections turned out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.classify import accel_label, flood_priority, trend_headline
from tidewatch.operators.temporal import first_hit, latest

#: Flood classes in the order in which a rising gauge comes to them.
CLASSES = ("minor", "moderate", "major")


def fits(readings: DataFrame, key: str) -> DataFrame:
    """By key: n, span_h, rate (m/hr), stderr, recent and earlier half's rates, and the current height.

    readings: key, ts, seq, height, within the window that counts. Of readings at one time the last by seq counts. The
    halves share the middle row. stderr is null below three readings.
    """
    rows = latest(readings.where("height IS NOT NULL"), [key, "ts"], ["seq"])
    first = rows.groupBy(key).agg(F.min("ts").alias("_t0"), F.count("*").alias("_n"))
    rows = rows.join(first, key).withColumn("x", F.timestamp_diff("MICROSECOND", "_t0", "ts") / F.lit(3.6e9))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1).withColumn("_mid", F.expr("_n div 2"))
    early, late = F.col("_k") <= F.col("_mid"), F.col("_k") >= F.col("_mid")
    on = lambda c, cond: F.when(cond, F.col(c))
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.max("x").alias("span_h"), F.regr_slope("height", "x").alias("rate"), F.regr_sxx("height", "x").alias("_sxx"), F.regr_sxy("height", "x").alias("_sxy"), F.regr_syy("height", "x").alias("_syy"),
        F.regr_slope(on("height", early), on("x", early)).alias("earlier"), F.regr_slope(on("height", late), on("x", late)).alias("recent"),
        F.max_by("height", "ts").alias("current"), F.max("ts").alias("observed_at"),
    )
    rest = F.greatest(F.lit(0.0), F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")))
    error = F.when(F.col("n") >= 3, F.sqrt(F.try_divide(rest / F.greatest(F.col("n") - 2, F.lit(1)), F.col("_sxx"))))
    return out.withColumn("stderr", error).drop("_sxx", "_sxy", "_syy")


def analyse(fitted: DataFrame, target: Column, *, least: float = 0.02, rapid: float = 0.25, horizon_h: float = 12.0, range_pct: float = 20.0, min_n: int = 4, min_span_h: float = 0.5) -> DataFrame:
    """fitted with accel, accel_label, headline, target and, in hours, eta_point, eta_early, eta_late; etas null where none is due."""
    enough = (F.col("n") >= min_n) & (F.col("span_h") >= min_span_h)
    epsilon = F.greatest(F.lit(0.01), F.coalesce("stderr", F.lit(0.0)))
    rows = fitted.where(enough).withColumns({"accel": (F.col("recent") - F.col("earlier")) / F.greatest(F.col("span_h") / 2, F.lit(1e-6)), "accel_label": accel_label(F.col("recent"), F.col("earlier"), epsilon), "target": target})
    rows = rows.withColumn("headline", trend_headline(F.col("rate"), F.col("accel_label") == "Increasing", least, rapid))
    d, r, s, a = F.col("target") - F.col("current"), F.col("rate"), F.col("stderr"), F.col("accel")
    point = F.when((r >= least) & (d > 0) & (d / r <= horizon_h), d / r)
    has = s > 0
    fast = F.when(has, d / (r + s))
    slow = F.when(has, F.when(r - s > least, d / (r - s)).otherwise(F.lit(horizon_h)))
    bent = F.when((a > 0), (-r + F.sqrt(r * r + 2 * a * d)) / a)
    margin = F.lit(range_pct / 100)
    low, high = F.least(point, fast, slow, bent), F.greatest(point, fast, slow, bent)
    early = F.greatest(F.least(low, point * (1 - margin)), F.lit(1 / 60))
    late = F.least(F.greatest(high, point * (1 + margin)), F.lit(horizon_h))
    return rows.withColumns({"eta_point": point, "eta_early": F.when(point.isNotNull(), early), "eta_late": F.when(point.isNotNull(), late)})


def next_target(rows: DataFrame, levels: DataFrame, impacts: DataFrame, *, key: str = "station") -> DataFrame:
    """rows (key, current and more) with target_kind, target_name and target: the next flood class above, else the lowest impact above.

    levels: key, minor, moderate, major; of these the first, in that order, that isn't null and above counts. impacts:
    key, height_m, impact. All three are null above everything that is known. A station's impacts are a guide's few rows,
    which go into one sorted ladder, so that any number of rows of a station look up theirs without pairs.
    """
    ladder = impacts.where("height_m IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("height_m").cast("double").alias("height"), F.left("impact", F.lit(120)).alias("name")))).alias("_ladder"))
    both = rows.join(levels.select(key, *[F.col(c).cast("double").alias(f"_{c}") for c in CLASSES]), key, "left").join(ladder, key, "left")
    step = F.get(F.filter("_ladder", lambda x: x["height"] > F.col("current")), F.lit(0))
    above = F.when(step.isNotNull(), F.struct(F.lit("impact").alias("kind"), step["name"].alias("name"), step["height"].alias("height")))
    for c in reversed(CLASSES):
        above = F.when(F.col("current") < F.col(f"_{c}"), F.struct(F.lit("class").alias("kind"), F.lit(c).alias("name"), F.col(f"_{c}").alias("height"))).otherwise(above)
    return both.withColumn("_above", above).select(*rows.columns, F.col("_above.kind").alias("target_kind"), F.col("_above.name").alias("target_name"), F.col("_above.height").alias("target"))


def impact_table(impacts: DataFrame, current: DataFrame, levels: DataFrame, *, key: str = "station") -> DataFrame:
    """impacts (key, height_m, impact) with the flood class of their height and whether the water has reached it; unknown heights haven't been."""
    rows = impacts.join(current.select(key, "current"), key, "left").join(levels.select(key, *CLASSES), key, "left")
    reached = F.coalesce(F.col("current") >= F.col("height_m"), F.lit(False))
    return rows.withColumns({"priority": flood_priority(F.col("height_m"), *[F.col(c) for c in CLASSES]), "reached": reached}).select(*impacts.columns, "priority", "reached")


def analysis(readings: DataFrame, levels: DataFrame, impacts: DataFrame, now: Column, *, key: str = "station", window_minutes: int = 180, least: float = 0.02, rapid: float = 0.25, horizon_h: float = 12.0, range_pct: float = 20.0, min_n: int = 4, min_span_h: float = 0.5) -> DataFrame:
    """The whole analysis of every gauge with a reading in the window: fits, the next target, arrival in hours, and why there is none (eta_reason)."""
    inside = readings.where((F.col("ts") >= now - F.make_dt_interval(mins=F.lit(window_minutes))) & (F.col("ts") <= now))
    return analysed(fits(inside, key), levels, impacts, key=key, window_minutes=window_minutes, least=least, rapid=rapid, horizon_h=horizon_h, range_pct=range_pct, min_n=min_n, min_span_h=min_span_h)


def analysed(fitted: DataFrame, levels: DataFrame, impacts: DataFrame, *, key: str, window_minutes: int, least: float, rapid: float, horizon_h: float, range_pct: float, min_n: int, min_span_h: float) -> DataFrame:
    """`analysis` of fits that have been made already."""
    enough = (F.col("n") >= min_n) & (F.col("span_h") >= min_span_h)
    full = analyse(next_target(fitted.where(enough), levels, impacts, key=key), F.col("target"), least=least, rapid=rapid, horizon_h=horizon_h, range_pct=range_pct, min_n=min_n, min_span_h=min_span_h)
    far = (F.col("target") - F.col("current")) / F.col("rate") > horizon_h
    reason = (
        F.when(F.col("target").isNull(), "Already above every known threshold.")
        .when(F.col("rate").isNull() | (F.col("rate") < least), f"Not rising fast enough to project (rate below {least:g} m/hr).")
        .when(far, f"At the current rate the threshold is more than {horizon_h:g} hours away — too far out to project usefully.")
    )
    few = F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(f" reading(s) in the last {window_minutes} minutes — at least {min_n} spanning 30 minutes are needed."))
    rest = fitted.where(~enough).withColumns({"rate": F.lit(None).cast("double"), "stderr": F.lit(None).cast("double"), "headline": F.lit("Insufficient data"), "accel_label": F.lit("Unknown"), "eta_reason": few})
    return full.withColumn("eta_reason", reason).unionByName(rest, allowMissingColumns=True)


PROJECTION = ["id", "station", "made_at", "observed_at", "current", "target_kind", "target_name", "target", "distance", "rate", "stderr", "accel", "readings", "eta_early", "eta_point", "eta_late", "lead_minutes"]


def projections(analyses: DataFrame, made_at: Column) -> DataFrame:
    """PROJECTION rows of those analyses (station and the columns of `analysis`) that have an arrival, with times instead of hours."""
    after = lambda c: F.col("observed_at") + F.make_dt_interval(secs=F.round(F.col(c) * 3600, 6).cast("decimal(18,6)"))
    rows = analyses.where("eta_point IS NOT NULL")
    lead = F.rint(F.col("eta_point") * 60).cast("long")
    rows = rows.select(F.xxhash64("station", "target", "observed_at").alias("id"), "station", made_at.alias("made_at"), "observed_at", "current", "target_kind", "target_name", "target", (F.col("target") - F.col("current")).alias("distance"), "rate", "stderr", "accel", F.col("n").alias("readings"), *[after(c).alias(c) for c in ("eta_early", "eta_point", "eta_late")], lead.alias("lead_minutes"))
    return rows.select(PROJECTION)


def near_flood(latest_readings: DataFrame, share: float) -> DataFrame:
    """Gauges (station, height, minor) whose height is at least that share of their minor level.

    The product is rounded, as 0.8 of 53 would be a little over 42.4 in binary.
    """
    return latest_readings.where(F.col("height") >= F.round(share * F.col("minor").cast("double"), 9))


def settle(projected: DataFrame, series: DataFrame, now: Column, *, key: str = "station", grace_h: float = 3.0) -> DataFrame:
    """projected with outcome, actual_ts, error_minutes, within_range, each as it fell due: by the first reading at the target until
    eta_late and the grace, else then. Pending ones have a null outcome; `verify` looks at what came after the deadline, too.

    A projection looks into its days only, which the horizon bounds.
    """
    deadline = F.col("eta_late") + F.make_dt_interval(mins=F.lit(int(grace_h * 60)))
    asked = projected.withColumn("_due", deadline)
    end = F.least("_due", now)
    days = F.when(end >= F.col("observed_at"), F.sequence(F.to_date("observed_at"), F.to_date(end)))
    asked_days = asked.select("id", key, "observed_at", "target", end.alias("_end"), F.explode(days).alias("_day"))
    rows = asked_days.join(series.where("height IS NOT NULL").select(key, "ts", "seq", "height", F.to_date("ts").alias("_day")), [key, "_day"]).where("ts > observed_at AND ts <= _end")
    seen = rows.groupBy("id").agg(F.min(F.when(F.col("height") >= F.col("target"), F.col("ts"))).alias("hit_ts"), F.max_by("height", F.struct("ts", "seq")).alias("_last"))
    both = asked.join(seen, "id", "left")
    hit, due = F.col("hit_ts").isNotNull(), now >= F.col("_due")
    outcome = F.when(hit, "reached").when(due & (F.col("_last") < F.col("current")), "receded").when(due, "not_reached")
    within = F.when(hit, F.col("hit_ts").between(F.col("eta_early"), F.col("eta_late")).cast("int")).when(outcome.isNotNull(), 0)
    error = F.when(hit, F.timestamp_diff("MICROSECOND", "eta_point", "hit_ts") / F.lit(60e6))
    return both.withColumns({"outcome": outcome, "actual_ts": F.col("hit_ts"), "error_minutes": error, "within_range": within}).drop("hit_ts", "_last", "_due")


def pending_counts(settled: DataFrame) -> DataFrame:
    """(station, pending): open projections by station."""
    return settled.where("outcome IS NULL").groupBy("station").agg(F.count("*").alias("pending"))


def recent(settled: DataFrame, *, limit: int = 25, verified_only: bool = False) -> DataFrame:
    """The latest projections, newest first, a limit of them."""
    rows = settled.where("outcome IS NOT NULL") if verified_only else settled
    return rows.orderBy(F.desc("made_at"), F.desc("id")).limit(limit)


def verify(projections: DataFrame, series: DataFrame, now: Column, *, key: str = "station", grace_h: float = 3.0) -> DataFrame:
    """projections with outcome, actual_ts, error_minutes, within_range; pending ones have a null outcome.

    projections: id, key, observed_at, current, target, eta_point, eta_early, eta_late (times). reached: the first later
    reading at the target; else, once eta_late and the grace have passed, receded if the last later height is lower than
    the one the projection began with, or not_reached.
    """
    seen = series.where(F.col("ts") <= now)
    hits = first_hit(projections.withColumns({"after": F.col("observed_at")}), seen, key, "id")
    last = latest(seen.select(key, "ts", "seq", "height").where("height IS NOT NULL"), [key], ["ts", "seq"]).select(key, F.col("ts").alias("_last_ts"), F.col("height").alias("_last"))
    rows = projections.join(hits, "id", "left").join(last, key, "left")
    hit = F.col("hit_ts").isNotNull()
    due = now >= F.col("eta_late") + F.make_dt_interval(mins=F.lit(int(grace_h * 60)))
    fell = (F.col("_last_ts") > F.col("observed_at")) & (F.col("_last") < F.col("current"))
    outcome = F.when(hit, "reached").when(due & fell, "receded").when(due, "not_reached")
    within = F.when(hit, F.col("hit_ts").between(F.col("eta_early"), F.col("eta_late")).cast("int")).when(outcome.isNotNull(), 0)
    error = F.when(hit, F.timestamp_diff("MICROSECOND", "eta_point", "hit_ts") / F.lit(60e6))
    return rows.withColumns({"outcome": outcome, "actual_ts": F.col("hit_ts"), "error_minutes": error, "within_range": within}).drop("hit_ts", "_last_ts", "_last")


def accuracy(verified: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rates and median errors of settled projections by keys, or over all of them."""
    done = verified.where("outcome IS NOT NULL")
    reached = (F.col("outcome") == "reached").cast("int")
    out = (F.count("*").alias("total"), F.sum(reached).alias("reached"), F.avg(reached).alias("hit_rate"), F.avg(F.coalesce("within_range", F.lit(0))).alias("within_range_rate"), F.median("error_minutes").alias("median_error"), F.median(F.abs("error_minutes")).alias("median_abs_error"))
    return done.groupBy(*keys).agg(*out) if keys else done.agg(*out)

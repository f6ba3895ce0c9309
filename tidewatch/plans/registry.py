"""The catalogue that plans enter their queries in, and the driver tables read as domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import at

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-01-20 00:00:00"
ORDERS_AS_OF = "1997-01-01 00:00:00"
#: Domain tables in SQL; a query's SQL may use any of them.
CTES = """
obs AS (SELECT event_id AS seq, user_id AS station, ts, value AS height, event_type AS catchment,
  40 + user_id % 20 AS minor, 80 + user_id % 20 AS moderate, 130 + user_id % 20 AS major FROM events),
coords AS (SELECT DISTINCT user_id AS station, -39 + (user_id % 50) * CAST(0.1 AS DOUBLE) AS lat, 141 + (user_id % 80) * CAST(0.1 AS DOUBLE) AS lon FROM events WHERE user_id % 5 <> 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC, seq DESC) AS k FROM obs WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') WHERE k = 1),
classed AS (SELECT *, CASE WHEN height >= major THEN 1 WHEN height >= moderate THEN 2 WHEN height >= minor THEN 3 ELSE 4 END AS priority FROM latest),
journal AS (SELECT o_orderpriority AS source, o_custkey AS entity_key, o_orderdate AS effective_ts, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS active, o_orderstatus AS status, o_totalprice AS price, o_orderkey AS seq FROM orders),
outages AS (SELECT o_orderkey AS location, o_orderdate AS "start", max(CASE WHEN l_shipdate < o_orderdate THEN o_orderdate ELSE l_shipdate END) AS "end", max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS restored, CAST(sum(l_quantity) AS BIGINT) AS customers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
prev AS (SELECT *, lag(height) OVER (PARTITION BY station ORDER BY ts, seq) AS prev_height, lag(ts) OVER (PARTITION BY station ORDER BY ts, seq) AS prev_ts FROM obs)
"""


def query(sql: str | None = None, *, recursive: bool = False) -> Callable:
    """Enter a function as a query, with its SQL; CTES stand before that."""

    def enter(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{CTES.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}"
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, station, ts, height, catchment, minor, moderate, major): events as gauge readings."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), u.alias("station"), "ts", F.col("value").alias("height"), F.col("event_type").alias("catchment"),
        (40 + u % 20).alias("minor"), (80 + u % 20).alias("moderate"), (130 + u % 20).alias("major"),
    )


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, lat, lon) of those gauges whose place is known."""
    s = F.col("station")
    stations = table(spark, sf_dir, "events").select(F.col("user_id").alias("station")).where(s % 5 != 0).distinct()
    return stations.select("station", *place(s))


def place(key: Column) -> tuple[Column, Column]:
    """Made-up coordinates, from a key."""
    return (-39 + (key % 50) * 0.1).alias("lat"), (141 + (key % 80) * 0.1).alias("lon")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, entity_key, effective_ts, active, status, price, seq): orders as a change journal."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("entity_key"), F.col("o_orderdate").alias("effective_ts"), (F.col("o_orderstatus") != "F").cast("int").alias("active"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"),
    )


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, start, end, restored, customers): orders and their lines as outages; lines are summed before they meet."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("location")).agg(F.max("l_shipdate").alias("shipped"), F.sum("l_quantity").cast("long").alias("customers"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("location"), F.col("o_orderdate").alias("start"), (F.col("o_orderstatus") == "F").cast("int").alias("restored"))
    return orders.join(lines, "location").select("location", "start", F.greatest("start", "shipped").alias("end"), "restored", "customers")


def instants(spark: SparkSession, texts: list[str], name: str = "at") -> DataFrame:
    """A short literal list of times."""
    return spark.createDataFrame([(t,) for t in texts], f"{name} string").select(F.col(name).cast("timestamp_ntz").alias(name))


def as_of() -> Column:
    return at(AS_OF)

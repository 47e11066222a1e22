"""Coalescing events that follow each other within a gap into one session per key.

Sessions are found per key and day, so that a hot key is spread over as many tasks as it has days. Only the first and the last
session of a day can go on over midnight: one row per key and day tells which of them belong together.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.times import utc


def _islands(rows: DataFrame, keys: list[str], gap_s: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("first_ts", "last_ts")
    before = F.max("last_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("starts", F.when(before.isNull() | (seconds(F.col("first_ts")) - seconds(before) > gap_s), 1).otherwise(0))
    numbered = starts.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n")).drop("island")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1_000_000


def coalesce_events(events: DataFrame, key: str, ts: str = "ts", gap_s: int = 900) -> DataFrame:
    """(key, first_ts, last_ts, n): runs of events of a key of which none is more than `gap_s` seconds after the one before.

    An event exactly `gap_s` later still belongs. Rows with a null key or time are left out; equal times are one run.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    points = rows.groupBy("key", "ts").agg(F.count("*").alias("n"))
    by_day = points.select("key", F.to_date(utc("ts")).alias("day"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), "n")
    day = Window.partitionBy("key", "day")
    place = F.row_number().over(day.orderBy("first_ts"))
    runs = _islands(by_day, ["key", "day"], gap_s).withColumn("place", place).withColumn("runs", F.count("*").over(day))
    runs = runs.withColumn("edge", (F.col("place") == 1) | (F.col("place") == F.col("runs")))
    days = runs.groupBy("key", "day").agg(F.min("first_ts").alias("begin"), F.max("last_ts").alias("end"), F.first("runs").alias("runs"))
    order = Window.partitionBy("key").orderBy("day")
    apart = F.coalesce(seconds(F.col("begin")) - seconds(F.lag("end").over(order)) > gap_s, F.lit(True))
    new = apart.cast("int") + F.coalesce((F.lag("runs").over(order) > 1).cast("int"), F.lit(0))
    chains = days.withColumn("new", new).select("key", "day", F.sum("new").over(order).alias("chain"))
    edges = runs.where("edge").join(chains, ["key", "day"]).withColumn("chain", F.col("chain") + (F.col("place") > 1).cast("int"))
    over = edges.groupBy("key", "chain").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"))
    columns = ["key", "first_ts", "last_ts", F.col("n").cast("long").alias("n")]
    return runs.where(~F.col("edge")).select(*columns).unionByName(over.select(*columns))


def as_text(runs: DataFrame) -> DataFrame:
    """The times, in UTC, as text with microseconds."""
    text = lambda c: F.date_format(utc(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return runs.select("key", text("first_ts"), text("last_ts"), "n")

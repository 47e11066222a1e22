"""Structured Streaming: incremental ledger ingest, session windows, and a circuit breaker as keyed state."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions.times import utc
from tallyloom.operators.ledger import new_rows, projection
from tallyloom.plans.lineage import new_folder


def ingest_ledger(lines: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the usage rows of a stream of ledger lines (value) to a Parquet table, each event once however often it is delivered.

    The table is partitioned by UTC month (`month`; unknown where a time can't be read). Deliveries of an event have the same time, so a
    micro-batch is compared only with the months that it has itself, not with the whole history.
    """

    def load(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = projection(batch, "value").withColumn("month", F.coalesce(F.date_format(utc("ts"), "yyyy-MM"), F.lit("unknown"))).persist()
        try:
            existing = spark.read.schema(rows.schema).parquet(table_path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = spark.createDataFrame([], rows.schema)
        months = rows.select("month").distinct()
        new_rows(rows, existing.join(F.broadcast(months), "month", "left_semi")).write.mode("append").partitionBy("month").parquet(table_path)
        rows.unpersist()

    return lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(lines: DataFrame) -> DataFrame:
    """The table that `ingest_ledger` makes of lines (value) that were stored and are read as a stream, a few files at a time."""
    folder = new_folder(lines.sparkSession)
    lines.write.parquet(f"{folder}/lines")
    stream = lines.sparkSession.readStream.schema(lines.schema).option("maxFilesPerTrigger", 16).parquet(f"{folder}/lines")
    ingest_ledger(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return lines.sparkSession.read.parquet(f"{folder}/table").withColumn("month", F.col("month").cast("string"))


def coalesced(events: DataFrame, key: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(key, first_ts, end_ts, n): events of a key within a gap of each other, closed once the watermark passes."""
    ready = events.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    grouped = ready.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("key", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")


def breaker(events: DataFrame, failures: int = 5, rest_s: float = 60.0) -> DataFrame:
    """(key, state, fails, at): per key, closed, open after `failures` in a row, half_open `rest_s` later, as of the batch's last event.

    events: (key string, ts timestamp, failed boolean). A success closes the circuit. A key's state is three values and stays.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, fails, opened = state.get if state.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        now = 0.0
        for ts, failed in zip(rows["ts"], rows["failed"]):
            now = ts.timestamp()
            if name == "open" and now - opened >= rest_s:
                name = "half_open"
            if not failed:
                name, fails = "closed", 0
            else:
                fails += 1
                if name == "half_open" or fails >= failures:
                    name, opened = "open", now
        state.update((name, fails, opened))
        yield pd.DataFrame({"key": [key[0]], "state": [name], "fails": [fails], "at": [pd.Timestamp(now, unit="s")]})

    output, kept = "key string, state string, fails int, at timestamp", "name string, fails int, opened double"
    return events.groupBy("key").applyInPandasWithState(step, output, kept, "update", GroupStateTimeout.NoTimeout)

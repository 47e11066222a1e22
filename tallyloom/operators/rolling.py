"""Rolling totals over trailing periods, days without activity included.

The ledger is first reduced to one row per entity and day, so a hot entity never holds more rows than its calendar has
days. Partitions are then sorted by entity and day, and a two-stack queue of partial aggregates walks them: it needs only
an associative `combine`, so maxima and other non-invertible aggregates slide at the same amortised cost as sums.
"""

from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.times import utc

MICROS = 1_000_000
NO_PROJECT = "(none)"


class TwoStackQueue:
    """First-in-first-out window over a monoid; `total()` is the combination of what is in it, oldest first."""

    def __init__(self, combine: Callable, identity) -> None:
        self.combine, self.identity = combine, identity
        self.front: list = []  # (value, combination of it and all newer values of the front stack)
        self.back: list = []
        self.back_total = identity

    def __len__(self) -> int:
        return len(self.front) + len(self.back)

    def push(self, value) -> None:
        self.back.append(value)
        self.back_total = self.combine(self.back_total, value)

    def pop(self) -> None:
        if not self.front:
            total = self.identity
            while self.back:
                value = self.back.pop()
                total = self.combine(value, total)
                self.front.append((value, total))
            self.back_total = self.identity
        self.front.pop()

    def total(self):
        return self.combine(self.front[-1][1] if self.front else self.identity, self.back_total)


def unique_calls(usage: DataFrame) -> DataFrame:
    """Each `event_id` once; a row without one can't be matched with another and stays."""
    return usage.where(F.col("event_id").isNotNull()).dropDuplicates(["event_id"]).unionByName(usage.where(F.col("event_id").isNull()))


def project_name(project: Column) -> Column:
    return F.when(project.isNull() | (project == ""), NO_PROJECT).otherwise(project)


def daily_costs(usage: DataFrame) -> DataFrame:
    """(entity, day, value): cost in millionths per project and UTC day. Null costs count as 0, rows without `ts` as no day."""
    calls = usage.where(F.col("ts").isNotNull()).select(
        F.unhex(F.md5("event_id")).alias("event_id"),
        project_name(F.col("project")).alias("entity"),
        F.to_date(utc("ts")).alias("day"),
        (F.coalesce("cost_usd", F.lit(0)) * MICROS).cast("long").alias("value"),
    )
    return unique_calls(calls).groupBy("entity", "day").agg(F.sum("value").alias("value"))


def trailing(daily: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    """Totals and largest daily values of the last `periods` days for each entity and calendar day.

    daily: (entity string, day date, value long), one row per entity and day; null values count as 0, rows with a null
    entity or day are left out. Returns entity, day, day_no (1 on the entity's first day) and, for each period n, total_n
    and peak_n. Every day from an entity's first to its last is in the result; an empty input gives an empty result.
    """
    rows = (
        daily.where(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .select("entity", "day", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
        .repartition("entity")
        .sortWithinPartitions("entity", "day")
    )
    fields = [f"total_{n} long, peak_{n} long" for n in periods]
    return rows.mapInPandas(_walker(periods), f"entity string, day date, day_no int, {', '.join(fields)}")


def _walker(periods: tuple[int, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [f"{kind}_{n}" for n in periods for kind in ("total", "peak")]
    one_day = timedelta(days=1)

    def combine(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        return a[0] + b[0], max(a[1], b[1])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, day, day_no, queues = None, None, 0, []

        def step(today: date, value: int) -> tuple:
            out: list = [entity, today, day_no]
            for n, queue in zip(periods, queues):
                if len(queue) == n:
                    queue.pop()
                queue.push((value, value))
                out += queue.total()
            return tuple(out)

        for batch in batches:
            rows = []
            for name, today, value in zip(batch["entity"], batch["day"], batch["value"]):
                if name != entity:
                    entity, day, day_no = name, today - one_day, 0
                    queues = [TwoStackQueue(combine, (0, -(2**63))) for _ in periods]
                while day < today:
                    day += one_day
                    day_no += 1
                    rows.append(step(day, int(value) if day == today else 0))
            yield pd.DataFrame(rows, columns=["entity", "day", "day_no", *names])

    return walk


def rolling_costs(usage: DataFrame) -> DataFrame:
    """Per project and UTC day: total, daily average and largest day of the last 7 and 30 days, in dollars."""
    r = trailing(daily_costs(usage), (7, 30))
    dollars = lambda c: F.col(c) / F.lit(float(MICROS))
    return r.select(
        F.col("entity").alias("project"),
        F.date_format("day", "yyyy-MM-dd").alias("usage_day"),
        F.col("day_no").cast("long").alias("day_no"),
        *(x for n in (7, 30) for x in (
            dollars(f"total_{n}").alias(f"total_{n}d"),
            (dollars(f"total_{n}") / F.lit(float(n))).alias(f"avg_{n}d"),
            dollars(f"peak_{n}").alias(f"peak_{n}d"),
        )),
    )


def cost_surges(usage: DataFrame) -> DataFrame:
    """Project days, from the 30th on, whose 7-day average is at least twice the 30-day average; compared in whole millionths."""
    r = trailing(daily_costs(usage), (7, 30))
    surge = (F.col("day_no") >= 30) & (F.col("total_30") > 0) & (F.col("total_7") * 30 >= F.col("total_30") * 14)
    return r.where(surge).select(F.col("entity").alias("project"), F.date_format("day", "yyyy-MM-dd").alias("usage_day"))

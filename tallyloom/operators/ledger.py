"""Ledger analytics: typed projection of JSON lines, rejects, idempotent loads, reports and spend windows."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.times import instant, utc
from tallyloom.operators.rolling import NO_PROJECT, unique_calls

NONE = NO_PROJECT
TOTAL = "TOTAL"
BLANKS = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\p{Z}]"

LINE = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("ts", T.StringType()), ("model_asked", T.StringType()), ("model_echoed", T.StringType()), ("id", T.StringType()), ("session", T.StringType()),
            ("project", T.StringType()), ("commit", T.StringType()), ("mode", T.StringType()), ("via", T.StringType()), ("in", T.LongType()), ("out", T.LongType()),
            ("cache", T.LongType()), ("cost_usd", T.DoubleType()), ("latency_s", T.DoubleType()), ("cached", T.BooleanType()),
        )
    ]
)


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{BLANKS}+|{BLANKS}+$", "")


def _refuse(constant: str) -> None:
    raise ValueError(constant)


@F.pandas_udf(T.StringType())
def json_kind(lines: pd.Series) -> pd.Series:
    """object, other (valid JSON of another kind) or invalid; strict, so trailing text and NaN are invalid."""

    def kind(line: str | None) -> str | None:
        if line is None:
            return None
        try:
            return "object" if isinstance(json.loads(line, parse_constant=_refuse), dict) else "other"
        except (ValueError, RecursionError):
            return "invalid"

    return lines.map(kind)


CORRUPT = "_corrupt"
STRICT = {"columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def reject_reason(line: Column, parsed: Column) -> Column:
    """Why a stripped line is no ledger row: blank, not_json, not_object, no_ts, no_model; null for a row.

    Spark's own parser decides on lines of one pair of braces that it takes without a complaint. The others go to a strict
    parser: what isn't all of that shape, and what has a wrongly typed field, which makes a line no less an object.
    """
    open_ = parsed[CORRUPT].isNotNull() | ~line.rlike(r"(?s)^\{[^{}]*\}$")
    kind = F.coalesce(json_kind(F.when(open_ & (line != ""), line)), F.lit("object"))
    missing = lambda name: parsed[name].isNull() | (parsed[name] == "")
    return (
        F.when(line == "", "blank").when(kind == "invalid", "not_json").when(kind == "other", "not_object")
        .when(missing("ts"), "no_ts").when(missing("model_asked"), "no_model")
    )


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(line, parsed, reason) of each line that is not null; a wrongly typed field is null without rejecting the line."""
    # each step stands in an array of its own, so that no later filter repeats it below
    once = lambda column: F.explode(F.array(column))
    bare = lines.where(F.col(line).isNotNull()).select(once(stripped(F.col(line))).alias("line"))
    parsed = F.from_json("line", T.StructType([*LINE.fields, T.StructField(CORRUPT, T.StringType())]), STRICT)
    rows = bare.select("line", once(parsed).alias("parsed"))
    return rows.withColumn("reason", reject_reason(F.col("line"), F.col("parsed")))


def projection(lines: DataFrame, line: str = "line") -> DataFrame:
    """Usage rows of the accepted lines: the id is the line's SHA-256, the mode defaults to chat, tokens belong to chat only."""
    rows = parse_lines(lines, line).where(F.col("reason").isNull())
    p = F.col("parsed")
    mode = F.coalesce(p["mode"], F.lit("chat"))
    chat = lambda name: F.when(mode == "chat", p[name])
    return rows.select(
        F.sha2("line", 256).alias("event_id"), p["id"].alias("response_id"), p["ts"].alias("ts_raw"), F.try_to_timestamp(p["ts"]).alias("ts"),
        p["project"].alias("project"), p["commit"].alias("commit_sha"), p["session"].alias("session_id"), p["model_asked"].alias("model_asked"),
        p["model_echoed"].alias("model"), mode.alias("mode"), p["via"].alias("via"), F.coalesce(p["cached"], F.lit(False)).alias("cached"),
        chat("in").alias("input_tokens"), chat("out").alias("output_tokens"), chat("cache").alias("cache_tokens"), p["cost_usd"].alias("cost_usd"), p["latency_s"].alias("latency_s"),
    )


def rejects(lines: DataFrame, line: str = "line") -> DataFrame:
    """(reason, n_lines), accepted lines as "accepted"."""
    reason = F.coalesce("reason", F.lit("accepted"))
    return parse_lines(lines, line).groupBy(reason.alias("reason")).agg(F.count("*").alias("n_lines"))


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key `existing` lacks, each key once: loading twice adds nothing. Null keys can't be matched and stay out."""
    keyed = incoming.where(F.col(key).isNotNull()).dropDuplicates([key])
    return keyed.join(existing.select(key), key, "left_anti")


def calls_of(usage: DataFrame, *columns: str) -> DataFrame:
    """The columns of each call, every event once, told apart by 16-byte digests of their ids."""
    return unique_calls(usage.select(F.unhex(F.md5("event_id")).alias("event_id"), *columns))


def group_key(by: str) -> Column:
    """The report's key as text: day is the UTC date; null and empty become (none)."""
    value = F.date_format(utc("ts"), "yyyy-MM-dd") if by == "day" else F.col(by).cast("string")
    return F.when(value.isNull() | (value == ""), NONE).otherwise(value)


def report(usage: DataFrame, by: str, since: str | None = None) -> DataFrame:
    """Calls, cache hits, cost, tokens and hit rate per group, and a TOTAL row.

    Repeated deliveries count once. `since` (YYYY-MM-DD) keeps calls of that UTC day on; rows without `ts` then leave.
    hit_rate is cache_tokens / input_tokens in percent, null without input tokens. No calls give no rows, not even a total.
    """
    wanted = usage if since is None else usage.where(F.col("ts") >= instant(since))  # deliveries are equal in all columns
    calls = calls_of(wanted, *({by} - {"day", "ts"}), "ts", "cached", "cost_usd", "input_tokens", "output_tokens", "cache_tokens")
    keyed = calls.withColumn("group_key", group_key(by))
    total = lambda c: F.sum(c).cast("long").alias(c)
    rows = keyed.rollup("group_key").agg(
        F.count("*").alias("calls"), F.count_if(F.col("cached")).alias("cached_hits"), F.sum("cost_usd").cast("double").alias("cost_usd"),
        total("input_tokens"), total("output_tokens"), total("cache_tokens"), F.grouping("group_key").alias("is_total"),
    )
    rate = F.floor(F.col("cache_tokens") / F.nullif("input_tokens", F.lit(0)) * 1000 + 0.5) / 10.0
    return rows.select(F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col("group_key")).alias("group_key"), "calls", "cached_hits", "cost_usd", "input_tokens", "output_tokens", "cache_tokens", rate.alias("hit_rate"), "is_total")


def ordered(report_: DataFrame) -> DataFrame:
    """A report in the order it is read in: groups by the code points of their key, the total last."""
    return report_.orderBy("is_total", "group_key")


def mode_tokens(lines: DataFrame, line: str = "line") -> DataFrame:
    """(mode, calls, calls_with_tokens, input_tokens, output_tokens): tokens count unless the mode is worker or the line has no `in`."""
    rows = projection_fields(lines, line)
    counts = (F.coalesce("mode", F.lit("chat")) != "worker") & F.col("in").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(counts, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("long")
    return rows.groupBy(F.coalesce("mode", F.lit("chat")).alias("mode")).agg(
        F.count("*").alias("calls"), F.count_if(counts).alias("calls_with_tokens"), total("in").alias("input_tokens"), total("out").alias("output_tokens")
    )


def projection_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """The fields of the accepted lines as they are, each line once."""
    return parse_lines(lines.select(line).distinct(), line).where(F.col("reason").isNull()).select(*(F.col("parsed")[f.name].alias(f.name) for f in LINE.fields))


def spend(usage: DataFrame, as_of: str) -> DataFrame:
    """Per project, in one pass: cost of the month and of the 7 days up to the instant `as_of`, of all time, and calls of its day."""
    now = instant(as_of)
    calls = calls_of(usage.where(F.col("ts") <= now), "project", "ts", "cached", "cost_usd")
    cost = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("cost_usd"))), F.lit(0)).cast("double").alias(name)
    return calls.groupBy(group_key("project").alias("project")).agg(
        cost(F.date_trunc("month", utc("ts")) == F.date_trunc("month", utc(now)), "month_usd"),
        cost(F.col("ts") >= now - F.expr("interval 7 days"), "week_usd"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("all_usd"),
        F.count_if((F.to_date(utc("ts")) == F.to_date(utc(now))) & ~F.coalesce("cached", F.lit(False))).alias("calls_today"),
    )


def calls_today(usage: DataFrame, as_of: str) -> DataFrame:
    """(channel, calls): calls that the cache did not answer on the UTC day of `as_of`, up to that instant, by channel."""
    now = instant(as_of)
    rows = calls_of(usage.where((F.col("ts") <= now) & (F.col("ts") >= instant(as_of[:10]))), "via", "cached").where(~F.coalesce("cached", F.lit(False)))
    return rows.groupBy(group_key("via").alias("channel")).agg(F.count("*").alias("calls"))


def session_spend(usage: DataFrame, as_of: str) -> DataFrame:
    """(session, usd, calls): cost of each session of all time up to `as_of`; calls without a cost count for neither."""
    rows = calls_of(usage.where((F.col("ts") <= instant(as_of)) & (F.col("cost_usd") > 0)), "session_id", "cost_usd")
    return rows.groupBy(group_key("session_id").alias("session")).agg(F.sum("cost_usd").cast("double").alias("usd"), F.count("*").alias("calls"))


def last_calls(usage: DataFrame) -> DataFrame:
    """Each project's latest call with a time (ties: greatest event_id): when, which model, what it cost."""
    latest = F.max(F.struct("ts", "event_id", "model_asked", F.col("cost_usd").cast("double").alias("cost_usd")))
    rows = usage.where(F.col("ts").isNotNull()).groupBy(group_key("project").alias("project")).agg(latest.alias("x"))
    return rows.select("project", "x.event_id", F.date_format(utc("x.ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "x.model_asked", "x.cost_usd")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that come more than once."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def model_summary(usage: DataFrame) -> DataFrame:
    """Calls, cost, mean latency, shares of cached calls and of calls without a response id per model as answered; a missing model is (none)."""
    calls = calls_of(usage, "model", "cached", "cost_usd", "latency_s", "response_id")
    n = F.count("*")
    return calls.groupBy(group_key("model").alias("model")).agg(
        n.alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd"),
        (F.sum(F.col("latency_s") * 100).cast("long") / F.count("latency_s") / 100).alias("mean_latency_s"), (F.count_if(F.col("cached")) / n).alias("cached_share"),
        (F.count_if(F.col("response_id").isNull()) / n).alias("unanswered_share"),
    )


def projection_of_latest(usage: DataFrame, n: int = 100, calls_per_day: int = 500) -> DataFrame:
    """Monthly cost if all calls cost as much as the latest `n` did on average; a top-n report."""
    latest = unique_calls(usage.where(F.col("ts").isNotNull()).select("event_id", "ts", "cost_usd")).orderBy(F.desc("ts"), "event_id").limit(n)
    return latest.agg(F.count("*").alias("n_calls"), (F.sum((F.coalesce("cost_usd", F.lit(0)) * 1_000_000).cast("long")) / F.count("*") / 1e6 * calls_per_day * 30).alias("month_usd"))

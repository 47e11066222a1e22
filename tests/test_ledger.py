import json
from datetime import datetime, timedelta
from decimal import Decimal

from tallyloom.operators import cache, coalesce, ledger
from tallyloom.streaming import jobs

GOOD = {"ts": "2026-01-01T00:00:00+00:00", "model_asked": "m", "in": 5, "out": 2, "cache": 1, "cost_usd": 0.5}


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_reject_reasons(spark):
    df = lines(spark, json.dumps(GOOD), "  " + json.dumps(GOOD) + "\n", "", " \t ", "{oops", '{"a": 1} x', "[1]", "3", json.dumps(GOOD | {"ts": ""}), json.dumps({"ts": "x"}), '{"ts": NaN}', None)
    got = {r.reason: r.n_lines for r in ledger.rejects(df).collect()}
    assert got == {"accepted": 2, "blank": 2, "not_json": 3, "not_object": 2, "no_ts": 1, "no_model": 1}


def test_projection_gates_tokens_and_keeps_mistyped(spark):
    worker, odd = GOOD | {"mode": "worker"}, GOOD | {"in": 1.5}
    rows = ledger.projection(lines(spark, json.dumps(GOOD), json.dumps(worker), json.dumps(odd))).collect()
    by = {(r.mode, r.input_tokens) for r in rows}
    assert by == {("chat", 5), ("worker", None), ("chat", None)}


def test_loading_twice_adds_nothing(spark):
    df = ledger.projection(lines(spark, json.dumps(GOOD), json.dumps(GOOD), json.dumps(GOOD | {"in": 6})))
    first = ledger.new_rows(df, df.limit(0))
    assert first.count() == 2 and ledger.new_rows(df, first).count() == 0


def test_report_totals_equal_sum_of_groups(spark):
    t = datetime(2026, 1, 2)
    rows = [("a", None, t, True, Decimal(1), 10, 1, 5), ("b", "", t, None, Decimal(2), None, None, None), ("c", "TOTAL", t, False, None, 0, 0, 0), ("c", "TOTAL", t, False, None, 0, 0, 0), (None, "x", None, False, Decimal(1), 4, 1, 1)]
    df = spark.createDataFrame(rows, "event_id string, project string, ts timestamp, cached boolean, cost_usd decimal(12,6), input_tokens int, output_tokens int, cache_tokens int")
    got = ledger.report(df, "project").collect()
    groups = {r.group_key: r for r in got}
    assert groups["(none)"].calls == 2 and groups["(none)"].hit_rate == 50.0
    assert sum(r.calls for r in got) == 2 * 4
    assert {r.group_key for r in ledger.report(df, "project", "2026-01-03").collect()} == set()
    assert ledger.report(df, "day").count() == 3


def test_runs_join_exact_gaps_and_midnight(spark):
    t = datetime(2026, 1, 1, 23, 50)
    at = [t, t + timedelta(minutes=15), t + timedelta(minutes=30, seconds=1), t + timedelta(minutes=30, seconds=1), t + timedelta(minutes=45)]
    df = spark.createDataFrame([("k", x) for x in at] + [(None, t), ("k", None), ("j", t)], "key string, ts timestamp")
    got = sorted((r.key, r.first_ts, r.n) for r in coalesce.coalesce_events(df, "key").collect())
    assert got == [("j", t, 1), ("k", t, 2), ("k", at[2], 3)]
    assert coalesce.coalesce_events(df.limit(0), "key").count() == 0


def test_cache_keys_and_eviction(spark):
    rows = [("1", "m", "caf\u00e9  x", "2026-01-01", 1), ("2", "m", "cafe\u0301\u00a0x ", "2026-01-03", None), ("3", "n", "caf\u00e9 x", "2026-01-02", 0), ("4", None, None, None, 5)]
    df = spark.createDataFrame(rows, "key string, model string, prompt string, created string, hits int")
    keys = {r.key: r.exact_key for r in cache.keyed(df).collect()}
    assert keys["1"] == keys["2"] and len(set(keys.values())) == 3
    assert [(r.entries, r.hits, r.kept) for r in cache.duplicates(df).collect()] == [(2, 1, "2")]
    assert {(r.key, r.reason) for r in cache.evicted(df, "2026-01-02", 1).collect()} == {("1", "age"), ("4", "age"), ("3", "size")}
    assert {r.age for r in cache.age_buckets(df, "2026-01-04").collect()} == {"week", "?"}


def test_doubtful_lines(spark):
    df = lines(spark, "{}", '{"a": {"b": 1}, "ts": "t", "model_asked": "m"}', '{"ts": "}", "model_asked": "m"}', json.dumps(GOOD) + json.dumps(GOOD), "{'ts': 't', 'model_asked': 'm'}", '{"ts": "t", "model_asked": "m", "in": "x"}', '{"ts": "t", "model_asked": "m",}')
    assert {r.reason: r.n_lines for r in ledger.rejects(df).collect()} == {"accepted": 3, "no_ts": 1, "not_json": 3}


def test_runs_over_several_midnights(spark):
    t = datetime(2026, 1, 1, 12)
    at = [t + timedelta(hours=h) for h in (0, 6, 13, 20, 27, 34, 60, 61, 100)]
    df = spark.createDataFrame([("k", x) for x in at], "key string, ts timestamp")
    got = sorted((r.first_ts, r.last_ts, r.n) for r in coalesce.coalesce_events(df, "key", gap_s=7 * 3600).collect())
    assert got == [(at[0], at[5], 6), (at[6], at[7], 2), (at[8], at[8], 1)]
    assert coalesce.coalesce_events(df, "key", gap_s=2 * 86400).count() == 1


def test_cache_probe_and_put(spark):
    rows = [("1", "m", "p", "r1", "2026-01-01T00:00:00Z", 1), ("2", "m", " p ", "r2", "2026-01-02T00:00:00Z", None), ("3", "m", "p", None, "2026-01-03T00:00:00Z", 4), ("4", None, None, "x", None, 5)]
    df = spark.createDataFrame(rows, "key string, model string, prompt string, response string, created string, hits int")
    asked = spark.createDataFrame([("a", "m", "p"), ("b", "m", "p"), ("c", "n", "p"), ("d", None, None)], "request string, model string, prompt string")
    probed = cache.probe(asked, df)
    assert {(r.request, r.hit, r.entry) for r in probed.collect()} == {("a", True, "2"), ("b", True, "2"), ("c", False, None), ("d", True, "4")}
    assert {(r.key, r.hits) for r in cache.with_hits(df, probed).collect()} == {("1", 1), ("2", 2), ("3", 4), ("4", 6)}
    new = spark.createDataFrame([("1", "2026-02-01"), ("9", "2026-02-02")], "key string, created string")
    assert {(r.key, r.hits) for r in cache.put(df, new, "2026-01-02", 3).collect()} == {("1", 0), ("9", 0), ("3", 4)}
    assert {r.key for r in cache.live(df, "2026-01-03", 86400).collect()} == {"2", "3"}
    ages = {r.key: r.age for r in df.select("key", cache.age(df.created, "2026-01-03 00:30:00").alias("age")).collect()}
    assert ages == {"1": "2d", "2": "1d", "3": "30m", "4": "?"}


def test_tokens_by_mode_and_spend(spark):
    t = datetime(2026, 1, 2, 5)
    df = lines(spark, *(json.dumps(GOOD | x) for x in ({}, {"mode": "worker"}, {"mode": "agent"})), json.dumps({k: v for k, v in GOOD.items() if k != "in"} | {"mode": "agent"}))
    assert {(r.mode, r.calls, r.calls_with_tokens, r.input_tokens) for r in ledger.mode_tokens(df).collect()} == {("chat", 1, 1, 5), ("worker", 1, 0, 0), ("agent", 2, 1, 5)}
    rows = [("a", "cli", "s", t, False, Decimal(1)), ("a", "cli", "s", t, False, Decimal(1)), ("b", None, "s", t, None, Decimal(0)), ("c", "cli", None, t, True, Decimal(2)), ("d", "cli", "s", t - timedelta(days=1), False, None)]
    usage = spark.createDataFrame(rows, "event_id string, via string, session_id string, ts timestamp, cached boolean, cost_usd decimal(12,6)")
    assert {tuple(r) for r in ledger.calls_today(usage, "2026-01-02 12:00:00").collect()} == {("cli", 1), ("(none)", 1)}
    assert {tuple(r) for r in ledger.session_spend(usage, "2026-01-02 12:00:00").collect()} == {("s", 1.0, 1), ("(none)", 2.0, 1)}


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD) + "\n\n{bad\n")
    read = lambda: spark.readStream.text(str(source))
    jobs.ingest_ledger(read(), str(target), str(tmp_path / "c")).awaitTermination()
    (source / "b.json").write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD | {"in": 9}) + "\n")
    jobs.ingest_ledger(read(), str(target), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(target)).count() == 2


def test_streamed_breaker(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [("a", t + timedelta(seconds=i), True) for i in range(5)] + [("b", t, True), ("b", t + timedelta(seconds=1), False)]
    spark.createDataFrame(rows, "key string, ts timestamp, failed boolean").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("key string, ts timestamp, failed boolean").parquet(str(tmp_path / "e"))
    q = jobs.breaker(stream).writeStream.format("memory").queryName("breaker").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {(r.key, r.state) for r in spark.table("breaker").collect()} == {("a", "open"), ("b", "closed")}


def test_streamed_runs(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [("a", t), ("a", t + timedelta(minutes=15)), ("a", t + timedelta(minutes=31)), ("b", t + timedelta(days=1))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "e"))
    q = jobs.coalesced(stream, "key").writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("runs").where("key = 'a'").collect()) == [1, 2]

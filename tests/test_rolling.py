import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from tallyloom.operators import rolling
from tallyloom.operators.rolling import TwoStackQueue

USAGE = "event_id string, project string, ts timestamp, cost_usd decimal(12,6)"


def test_queue_against_brute_force():
    random.seed(1)
    for combine, identity in ((max, -1), (lambda a, b: a + b, ""), (lambda a, b: a + b, 0)):
        q, held = TwoStackQueue(combine, identity), []
        for _ in range(500):
            if held and random.random() < 0.45:
                q.pop()
                held.pop(0)
            else:
                v = random.randint(0, 9)
                v = str(v) if identity == "" else v
                q.push(v)
                held.append(v)
            expected = identity
            for v in held:
                expected = combine(expected, v)
            assert q.total() == expected and len(q) == len(held)


def test_trailing_against_brute_force(spark):
    random.seed(2)
    start = date(2026, 1, 1)
    rows = {(e, start + timedelta(days=random.randint(0, 80))): random.randint(-5, 50) for e in ("a", "b", "c") for _ in range(30)}
    daily = spark.createDataFrame([(e, d, v) for (e, d), v in rows.items()], "entity string, day date, value long")
    got = {(r.entity, r.day): r for r in rolling.trailing(daily, (1, 7, 30)).collect()}
    days = 0
    for e in ("a", "b", "c"):
        mine = [d for x, d in rows if x == e]
        for k in range((max(mine) - min(mine)).days + 1):
            d = min(mine) + timedelta(days=k)
            days += 1
            r = got[e, d]
            assert r.day_no == k + 1
            for n in (1, 7, 30):
                window = [rows.get((e, d - timedelta(days=i)), 0) for i in range(min(n, k + 1))]
                assert (r[f"total_{n}"], r[f"peak_{n}"]) == (sum(window), max(window))
    assert len(got) == days


def test_nulls_repeats_and_extra_columns(spark):
    t = datetime(2026, 1, 1, 23, 59)
    rows = [("x", "", t, Decimal("1.5")), ("x", "", t, Decimal("1.5")), (None, None, t, Decimal("2")), (None, None, t, Decimal("2")), ("y", "p", None, Decimal("9")), ("z", "p", t, None)]
    df = spark.createDataFrame(rows, USAGE)
    df = df.selectExpr("*", "'clash' as entity", "'clash' as day", "1 as value", "2 as _unmatched")
    got = {(r.project, r.usage_day): r.total_7d for r in rolling.rolling_costs(df).collect()}
    assert got == {("(none)", "2026-01-01"): 5.5, ("p", "2026-01-01"): 0.0}


def test_empty(spark):
    empty = spark.createDataFrame([], USAGE)
    assert rolling.cost_surges(empty).count() == 0 and rolling.rolling_costs(empty).count() == 0


def test_surge_bounds(spark):
    start = datetime(2026, 1, 1)
    calls = [(f"e{i}", "p", start + timedelta(days=i), Decimal(1)) for i in range(23)] + [(f"f{i}", "p", start + timedelta(days=23 + i), Decimal("2.875")) for i in range(7)]
    df = spark.createDataFrame(calls, USAGE)
    # 7 days: 20.125 / 7 = 2.875; 30 days: 43.125 / 30 = 1.4375, exactly half
    assert [r.usage_day for r in rolling.cost_surges(df).collect()] == ["2026-01-30"]


def test_days_are_utc_in_any_session_zone(spark):
    df = spark.createDataFrame([("a", "p", 1767225600 + 3600 * h) for h in (0, 23)], "event_id string, project string, s long")
    df = df.selectExpr("concat(event_id, s) as event_id", "project", "timestamp_seconds(s) as ts", "cast(1 as decimal(12,6)) as cost_usd")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tehran", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [(r.usage_day, r.total_7d) for r in rolling.rolling_costs(df).collect()] == [("2026-01-01", 2.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

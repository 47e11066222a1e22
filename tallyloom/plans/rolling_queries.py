"""Queries and SQL of the rolling totals."""

from tallyloom.operators import rolling
from tallyloom.sources.tables import table

_COLUMNS = ("event_id", "project", "ts", "cost_usd")

QUERIES = {
    "p4_found": lambda spark, d: rolling.cost_surges(table(spark, d, "usage_rows", *_COLUMNS)),
    "p4_rolling": lambda spark, d: rolling.rolling_costs(table(spark, d, "usage_rows", *_COLUMNS)),
}

_DAYS = """
with calls as (select distinct event_id, coalesce(nullif(project, ''), '(none)') as project,
    (ts at time zone 'UTC')::date as day, (coalesce(cost_usd, 0) * 1000000)::bigint as micros
    from usage_rows where ts is not null),
daily as (select project, day, sum(micros)::bigint as micros from calls group by 1, 2),
span as (select project, min(day) as first_day, max(day) as last_day from daily group by 1),
days as (select s.project, s.first_day, g.day::date as day from span s,
    unnest(generate_series(s.first_day::timestamp, s.last_day::timestamp, interval 1 day)) as g(day)),
dense as (select d.project, d.day, (d.day - d.first_day) + 1 as day_no, coalesce(x.micros, 0) as micros
    from days d left join daily x on x.project = d.project and x.day = d.day),
rolled as (select project, day, day_no,
    sum(micros) over w7 as t7, max(micros) over w7 as m7, sum(micros) over w30 as t30, max(micros) over w30 as m30
    from dense window w7 as (partition by project order by day rows 6 preceding),
    w30 as (partition by project order by day rows 29 preceding))
"""

SQL = {
    "p4_found": _DAYS + """select project, strftime(day, '%Y-%m-%d') as usage_day from rolled
        where day_no >= 30 and t30 > 0 and t7 * 30 >= t30 * 14""",
    "p4_rolling": _DAYS + """select project, strftime(day, '%Y-%m-%d') as usage_day, day_no::bigint as day_no,
        t7::double / 1000000 as total_7d, t7::double / 1000000 / 7 as avg_7d, m7::double / 1000000 as peak_7d,
        t30::double / 1000000 as total_30d, t30::double / 1000000 / 30 as avg_30d, m30::double / 1000000 as peak_30d
        from rolled""",
}

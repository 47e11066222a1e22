"""Queries and SQL over the usage ledger and the response cache."""

from pyspark.sql import functions as F

from tallyloom.functions.times import instant
from tallyloom.operators import cache, coalesce, ledger
from tallyloom.sources.tables import table
from tallyloom.streaming import jobs

AS_OF = "2026-06-15 12:00:00"
SINCE = "2026-06-01"
CUTOFF = "2026-04-15"
KEEP = 200
ANSWERED = "2026-07-01T00:00:00+00:00"


def _usage(spark, d):
    return table(spark, d, "usage_rows")


def _lines(spark, d):
    raw = table(spark, d, "usage_rows").select(F.col("raw").alias("line"))
    return raw.unionByName(table(spark, d, "cache_rows").select(F.col("response").alias("line")))


def _load(spark, d):
    rows = ledger.projection(table(spark, d, "usage_rows").select("raw"), "raw")
    before = table(spark, d, "usage_rows").where(F.col("ts") < instant(SINCE)).select("raw")
    stored = ledger.projection(before, "raw")
    return ledger.new_rows(rows, stored).groupBy("mode").agg(F.count("*").alias("loaded"), F.sum("input_tokens").alias("input_tokens"))


def _probe(spark, d):
    """Every prompt of the cache asked again, against the entries made since CUTOFF."""
    rows = table(spark, d, "cache_rows")
    return cache.probe(rows.withColumnRenamed("key", "request"), rows.where(F.col("created") >= CUTOFF))


def _answered(spark, d):
    return table(spark, d, "cache_rows").where(F.col("response").isNull()).select("key", F.lit(ANSWERED).alias("created"))


QUERIES = {
    **{f"cost_report_by_{by}": (lambda spark, d, by=by: ledger.ordered(ledger.report(_usage(spark, d), by)).drop("is_total")) for by in ("model_asked", "project", "day", "session_id", "via", "mode")},
    "cost_report_since": lambda spark, d: ledger.ordered(ledger.report(_usage(spark, d), "project", SINCE)).drop("is_total"),
    "ledger_projection": lambda spark, d: ledger.projection(table(spark, d, "usage_rows").select("raw"), "raw").withColumn("ts", F.unix_micros("ts")),
    "mode_tokens": lambda spark, d: ledger.mode_tokens(table(spark, d, "usage_rows").select("raw"), "raw"),
    "calls_today": lambda spark, d: ledger.calls_today(_usage(spark, d), AS_OF),
    "session_spend": lambda spark, d: ledger.session_spend(_usage(spark, d), AS_OF),
    "ledger_rejects": lambda spark, d: ledger.rejects(_lines(spark, d)),
    "ledger_idempotent_load": _load,
    "ledger_streamed": lambda spark, d: jobs.replayed(table(spark, d, "usage_rows").select(F.col("raw").alias("value"))).select("event_id", "project", "month"),
    "ledger_repeated": lambda spark, d: ledger.repeated(table(spark, d, "usage_rows", "event_id"), "event_id"),
    "ledger_last_calls": lambda spark, d: ledger.last_calls(_usage(spark, d)),
    "spend_by_project": lambda spark, d: ledger.spend(_usage(spark, d), AS_OF),
    "model_summary": lambda spark, d: ledger.model_summary(_usage(spark, d)),
    "monthly_projection": lambda spark, d: ledger.projection_of_latest(_usage(spark, d)),
    "call_runs": lambda spark, d: coalesce.as_text(coalesce.coalesce_events(table(spark, d, "usage_rows", "project", "ts"), "project")),
    "event_runs": lambda spark, d: coalesce.as_text(coalesce.coalesce_events(table(spark, d, "events", "user_id", "ts"), "user_id", gap_s=21600)),
    "cache_keys": lambda spark, d: cache.keyed(table(spark, d, "cache_rows"), "Answer  briefly. ", 1024),
    "cache_probe": lambda spark, d: _probe(spark, d),
    "cache_hits": lambda spark, d: cache.with_hits(table(spark, d, "cache_rows"), _probe(spark, d)),
    "cache_put": lambda spark, d: cache.put(table(spark, d, "cache_rows"), _answered(spark, d), CUTOFF, KEEP),
    "cache_live": lambda spark, d: cache.live(table(spark, d, "cache_rows", "key", "created"), AS_OF, 30 * 86400),
    "cache_entry_ages": lambda spark, d: table(spark, d, "cache_rows", "key", "created").select("key", cache.age(F.col("created"), AS_OF).alias("age")),
    "cache_duplicates": lambda spark, d: cache.duplicates(table(spark, d, "cache_rows")),
    "cache_evicted": lambda spark, d: cache.evicted(table(spark, d, "cache_rows", "key", "created"), CUTOFF, KEEP),
    "cache_ages": lambda spark, d: cache.age_buckets(table(spark, d, "cache_rows", "created", "hits"), AS_OF),
}

_CALLS = "calls as (select distinct on (event_id) * from usage_rows)"


def _key(by):
    value = "strftime(ts at time zone 'UTC', '%Y-%m-%d')" if by == "day" else by
    return f"coalesce(nullif({value}, ''), '(none)')"


def _report(by, where="true"):
    return f"""with {_CALLS}, keyed as (select {_key(by)} as g, * from calls where {where}),
r as (select g, grouping(g) as is_total, count(*) as calls, count_if(cached) as cached_hits, sum(cost_usd)::double as cost_usd,
  sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cache_tokens)::bigint as cache_tokens
  from keyed group by rollup (g))
select case when is_total = 1 then 'TOTAL' else g end as group_key, calls, cached_hits::bigint as cached_hits, cost_usd, input_tokens, output_tokens, cache_tokens,
  floor(cache_tokens::double / nullif(input_tokens, 0) * 1000 + 0.5) / 10.0 as hit_rate from r"""


_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\p{Z}]"
_EXACT_OF = f"sha256(coalesce(model, '') || chr(0) || '{{0}}' || chr(0) || trim(regexp_replace(nfc_normalize(coalesce(prompt, '')), '{_SPACE.replace('{', '{{').replace('}', '}}')}+', ' ', 'g')) || chr(0) || '{{1}}')"
_EXACT = _EXACT_OF.format("", "")
_PROBED = f"""r as (select *, {_EXACT} as exact_key from cache_rows),
n as (select exact_key, key as entry, md5(response) as answer from r where created >= '{CUTOFF}' and response is not null qualify row_number() over (partition by exact_key order by created desc, key desc) = 1),
probed as (select r.key as request, n.entry is not null as hit, n.entry, n.answer from r left join n using (exact_key))"""
_JSON = "json_extract_string(line, '$.{0}')"


def _runs(table_name, key, gap, utc=""):
    return f"""with points as (select distinct {key} as key, ts from {table_name} where {key} is not null and ts is not null),
marked as (select key, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by key order by ts) <= {gap}::bigint * 1000000 then 0 else 1 end as starts from points),
islands as (select key, ts, sum(starts) over (partition by key order by ts) as island from marked),
spans as (select key, min(ts) as first_ts, max(ts) as last_ts from islands group by key, island)
select s.key, strftime(s.first_ts{utc}, '%Y-%m-%d %H:%M:%S.%f') as first_ts, strftime(s.last_ts{utc}, '%Y-%m-%d %H:%M:%S.%f') as last_ts, count(*) as n from spans s join {table_name} t on t.{key} = s.key and t.ts between s.first_ts and s.last_ts group by 1, 2, 3"""


SQL = {
    **{f"cost_report_by_{by}": _report(by) for by in ("model_asked", "project", "day", "session_id", "via", "mode")},
    "cost_report_since": _report("project", f"ts >= timestamptz '{SINCE} 00:00:00+00'"),
    "ledger_projection": f"""with l as (select raw as line from usage_rows)
select sha256(line) as event_id, {_JSON.format('id')} as response_id, {_JSON.format('ts')} as ts_raw, epoch_us(try_cast({_JSON.format('ts')} as timestamptz)) as ts, {_JSON.format('project')} as project, {_JSON.format('commit')} as commit_sha,
  {_JSON.format('session')} as session_id, {_JSON.format('model_asked')} as model_asked, {_JSON.format('model_echoed')} as model, coalesce({_JSON.format('mode')}, 'chat') as mode,
  {_JSON.format('via')} as via, coalesce({_JSON.format('cached')}::boolean, false) as cached,
  case when coalesce({_JSON.format('mode')}, 'chat') = 'chat' then {_JSON.format('in')}::bigint end as input_tokens,
  case when coalesce({_JSON.format('mode')}, 'chat') = 'chat' then {_JSON.format('out')}::bigint end as output_tokens,
  case when coalesce({_JSON.format('mode')}, 'chat') = 'chat' then {_JSON.format('cache')}::bigint end as cache_tokens,
  {_JSON.format('cost_usd')}::double as cost_usd, {_JSON.format('latency_s')}::double as latency_s
from l where {_JSON.format('ts')} <> '' and {_JSON.format('model_asked')} <> ''""",
    "ledger_rejects": rf"""with l as (select regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g') as line from
  (select raw as x from usage_rows union all select response from cache_rows) where x is not null),
k as (select line, json_valid(line) as ok, case when json_valid(line) then json_type(line) end as kind from l)
select case when line = '' then 'blank' when not ok then 'not_json' when kind <> 'OBJECT' then 'not_object'
  when coalesce({_JSON.format('ts')}, '') = '' then 'no_ts' when coalesce({_JSON.format('model_asked')}, '') = '' then 'no_model' else 'accepted' end as reason,
  count(*) as n_lines from k group by 1""",
    "ledger_idempotent_load": f"""select mode, count(*) as loaded, sum(input_tokens)::bigint as input_tokens from (select distinct on (raw) * from usage_rows
  where raw not in (select raw from usage_rows where ts < timestamptz '{SINCE} 00:00:00+00' and raw is not null)) group by 1""",
    "ledger_streamed": f"""select distinct sha256(raw) as event_id, {_JSON.format('project').replace('line', 'raw')} as project, strftime(try_cast({_JSON.format('ts').replace('line', 'raw')} as timestamptz) at time zone 'UTC', '%Y-%m') as month
  from usage_rows where {_JSON.format('ts').replace('line', 'raw')} <> '' and {_JSON.format('model_asked').replace('line', 'raw')} <> ''""",
    "ledger_repeated": "select event_id, count(*) as n from usage_rows where event_id is not null group by 1 having count(*) > 1",
    "ledger_last_calls": """with r as (select coalesce(nullif(project, ''), '(none)') as project, event_id, ts, model_asked, cost_usd::double as cost_usd,
  row_number() over (partition by coalesce(nullif(project, ''), '(none)') order by ts desc, event_id desc) as rn from usage_rows where ts is not null)
select project, event_id, strftime(ts at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as last_ts, model_asked, cost_usd from r where rn = 1""",
    "spend_by_project": f"""with {_CALLS}, c as (select *, timestamptz '{AS_OF}+00' as now from calls where ts <= timestamptz '{AS_OF}+00')
select coalesce(nullif(project, ''), '(none)') as project,
  coalesce(sum(cost_usd) filter (date_trunc('month', ts at time zone 'UTC') = date_trunc('month', now at time zone 'UTC')), 0)::double as month_usd,
  coalesce(sum(cost_usd) filter (ts >= now - interval 7 days), 0)::double as week_usd, coalesce(sum(cost_usd), 0)::double as all_usd,
  count(*) filter ((ts at time zone 'UTC')::date = (now at time zone 'UTC')::date and not coalesce(cached, false)) as calls_today from c group by 1""",
    "model_summary": f"""with {_CALLS} select coalesce(nullif(model, ''), '(none)') as model, count(*) as calls, sum(cost_usd)::double as cost_usd,
  sum(latency_s * 100)::bigint::double / count(latency_s) / 100 as mean_latency_s, count_if(cached)::double / count(*) as cached_share,
  count_if(response_id is null)::double / count(*) as unanswered_share from calls group by 1""",
    "mode_tokens": f"""with l as (select distinct raw as line from usage_rows where {_JSON.format('ts').replace('line', 'raw')} <> '' and {_JSON.format('model_asked').replace('line', 'raw')} <> ''),
f as (select coalesce({_JSON.format('mode')}, 'chat') as mode, {_JSON.format('in')}::bigint as i, {_JSON.format('out')}::bigint as o from l)
select mode, count(*) as calls, count(*) filter (mode <> 'worker' and i is not null) as calls_with_tokens, coalesce(sum(i) filter (mode <> 'worker' and i is not null), 0)::bigint as input_tokens,
  coalesce(sum(o) filter (mode <> 'worker' and i is not null), 0)::bigint as output_tokens from f group by 1""",
    "calls_today": f"""with {_CALLS} select coalesce(nullif(via, ''), '(none)') as channel, count(*) as calls from calls
  where ts <= timestamptz '{AS_OF}+00' and ts >= timestamptz '{AS_OF[:10]} 00:00:00+00' and not coalesce(cached, false) group by 1""",
    "session_spend": f"""with {_CALLS} select coalesce(nullif(session_id, ''), '(none)') as session, sum(cost_usd)::double as usd, count(*) as calls from calls
  where ts <= timestamptz '{AS_OF}+00' and cost_usd > 0 group by 1""",
    "monthly_projection": f"""with {_CALLS}, latest as (select * from calls where ts is not null order by ts desc, event_id limit 100)
select count(*) as n_calls, sum((coalesce(cost_usd, 0) * 1000000)::bigint)::double / count(*) / 1000000 * 500 * 30 as month_usd from latest""",
    "call_runs": _runs("usage_rows", "project", 900, " at time zone 'UTC'"),
    "event_runs": _runs("events", "user_id", 21600),
    "cache_keys": f"select key, {_EXACT_OF.format('Answer briefly.', 1024)} as exact_key from cache_rows",
    "cache_probe": f"with {_PROBED} select * from probed",
    "cache_hits": f"with {_PROBED}, c as (select entry as key, count(*) as new from probed where hit group by 1) select key, (coalesce(hits, 0) + coalesce(new, 0))::bigint as hits from cache_rows left join c using (key)",
    "cache_put": f"""with p as (select key, case when response is null then 0 else coalesce(hits, 0) end::bigint as hits, case when response is null then '{ANSWERED}' else coalesce(created, '') end as created from cache_rows where key is not null)
select * from p where created >= '{CUTOFF}' qualify row_number() over (order by created desc, key) <= {KEEP}""",
    "cache_live": f"select key from cache_rows where epoch(timestamptz '{AS_OF}+00')::bigint - epoch(try_cast(created as timestamptz))::bigint between 0 and 2592000",
    "cache_entry_ages": rf"""with a as (select key, epoch(timestamptz '{AS_OF}+00')::bigint - epoch(case when regexp_matches(created, '(Z|[+-]\d\d:?\d\d)$') then try_cast(created as timestamptz) end)::bigint as s from cache_rows)
select key, case when s is null then '?' when s < 3600 then floor(s / 60.0)::bigint || 'm' when s < 86400 then floor(s / 3600.0)::bigint || 'h' else floor(s / 86400.0)::bigint || 'd' end as age from a""",
    "cache_duplicates": f"""with r as (select {_EXACT} as exact_key, key, coalesce(created, '') as created, coalesce(hits, 0) as hits from cache_rows)
select exact_key, count(*) as entries, sum(hits)::bigint as hits, max(struct_pack(a := created, b := key)).b as kept from r group by 1 having count(*) > 1""",
    "cache_evicted": f"""with r as (select distinct key, coalesce(created, '') as created from cache_rows where key is not null),
fresh as (select key, row_number() over (order by created desc, key) as rn from r where created >= '{CUTOFF}')
select key, 'age' as reason from r where created < '{CUTOFF}' union all select key, 'size' from fresh where rn > {KEEP}""",
    "cache_ages": f"""with a as (select hits, floor((epoch(timestamptz '{AS_OF}+00')::bigint - epoch(try_cast(created as timestamptz))::bigint) / 86400.0) as days from cache_rows)
select case when days is null then '?' when days < 7 then 'week' when days < 30 then 'month' when days < 90 then 'quarter' else 'older' end as age,
  count(*) as entries, coalesce(sum(hits), 0)::bigint as hits from a group by 1""",
}

"""Queries and SQL of line- and path-level measures."""

from pyspark.sql import functions as F

from tallyloom.operators import retrieval, texts
from tallyloom.plans.corpus_queries import _EDGES, _LINES
from tallyloom.plans.ledger_queries import AS_OF
from tallyloom.sources.tables import table

TABLES = ("rules_chunks", "session_chunks", "code_chunks")
FIGURE = r"[0-9]+ (percent|Prozent|pour cent|por ciento)"


def _paths(spark, d):
    rows = table(spark, d, "documents", "path")
    for t in TABLES:
        rows = rows.unionByName(table(spark, d, t, "path"))
    return rows.where(F.col("path").isNotNull()).groupBy(texts.collection_of(F.col("path")).alias("collection")).agg(F.count("*").alias("rows"), F.countDistinct("path").alias("paths"))


def _edges(code):
    return retrieval.resolved(retrieval.call_sites(code), code)


def _uncalled(spark, d):
    code = table(spark, d, "code_chunks", "id", "repo", "symbol", "chunk")
    return texts.uncalled(code, _edges(code))


def _rules(spark, d):
    return table(spark, d, "rules_chunks", "id", "repo", "path", "heading", "chunk")


QUERIES = {
    "pipe_rows": lambda spark, d: texts.pipe_rows(table(spark, d, "documents", "doc_id", "text")),
    "figure_lines": lambda spark, d: texts.matching_lines(table(spark, d, "documents", "doc_id", "text"), FIGURE),
    "heading_once": lambda spark, d: _rules(spark, d).select("id", texts.once(F.col("chunk"), F.col("heading")).alias("found")),
    "chunks_kept": lambda spark, d: _rules(spark, d).where(texts.worth_keeping(F.col("chunk"), F.col("heading"))).select("id"),
    "heading_slugs": lambda spark, d: _rules(spark, d).select("id", texts.slug(F.col("heading")).alias("slug")),
    "path_collections": _paths,
    "chunk_positions": lambda spark, d: texts.positions(table(spark, d, "session_chunks", "id", "repo", "path")),
    "file_symbols": lambda spark, d: texts.file_symbols(table(spark, d, "code_chunks", "id", "repo", "path", "symbol", "start_line")),
    "top_definitions": lambda spark, d: texts.top_definitions(table(spark, d, "code_chunks", "id", "lang", "chunk")),
    "run_totals": lambda spark, d: texts.run_totals(table(spark, d, "usage_rows").select(F.col("raw").alias("line"))),
    "live_sessions": lambda spark, d: texts.live_sessions(table(spark, d, "usage_rows", "event_id", "session_id", "ts"), AS_OF),
    "code_definitions": lambda spark, d: texts.code_definitions(table(spark, d, "code_chunks", "id", "lang", "chunk")),
    "uncalled_symbols": _uncalled,
    "document_kinds": lambda spark, d: texts.kinds(table(spark, d, "documents", "kind", "lang", "text")),
    "embedding_headers": lambda spark, d: table(spark, d, "code_chunks", "id", "lang", "symbol", "path").select("id", F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("symbol", F.lit("")), F.lit(" in "), F.coalesce("path", F.lit(""))).alias("header")),
    "dialogues": lambda spark, d: table(spark, d, "cache_rows", "key", "prompt", "response").select("key", F.sha2(F.concat(F.lit("User: "), F.coalesce("prompt", F.lit("")), F.lit("\n\nAssistant: "), F.coalesce("response", F.lit(""))), 256).alias("digest")),
}

_L = "lines as (select {0}, unnest({1}) as line, generate_subscripts({1}, 1)::bigint as line_no from {2} where {3} is not null)"
_DOC_LINES = _L.format("doc_id", _LINES.format("text"), "documents", "text")
_PATHS = " union all ".join(f"select path from {t}" for t in ("documents", *TABLES))

SQL = {
    "pipe_rows": rf"""with {_DOC_LINES}, r as (select doc_id, line_no, list_transform(string_split(regexp_replace(line, '^ *\||\| *$', '', 'g'), '|'), lambda c: trim(c, ' ')) as cells
  from lines where regexp_matches(line, '^ *\|.*\| *$') and not regexp_matches(line, '^[ |:-]+$'))
select doc_id, line_no, len(cells) as n_cells, cells[list_position(list_transform(cells, lambda c: length(c)), list_max(list_transform(cells, lambda c: length(c))))] as longest from r""",
    "figure_lines": f"with {_DOC_LINES} select doc_id, count(*) as n from lines where regexp_matches(line, '{FIGURE}') group by 1",
    "heading_once": """with n as (select id, case when length(heading) > 0 and chunk is not null then (length(chunk) - length(replace(chunk, heading, ''))) / length(heading) end as n from rules_chunks)
select id, case when n is null then 'empty' when n = 0 then 'missing' when n = 1 then 'once' else 'many' end as found from n""",
    "chunks_kept": r"""select id from rules_chunks where regexp_matches(chunk, '[\p{L}\p{N}]') and regexp_replace(chunk, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') is distinct from trim(heading, ' ')""",
    "heading_slugs": r"""with s as (select id, regexp_replace(substring(regexp_replace(regexp_replace(lower(coalesce(heading, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 20), '-+$', '') as slug from rules_chunks)
select id, case when slug = '' then 'note' else slug end as slug from s""",
    "path_collections": f"""with p as ({_PATHS}) select case when contains(path, 'skills') then 'skills' when contains(path, 'rules') or path like '%.mdc' then 'rules'
  when regexp_matches(path, '\\.(py|js|ts|go|rs)$') then 'code' else 'sessions' end as collection, count(*) as rows, count(distinct path) as paths from p where path is not null group by 1""",
    "chunk_positions": "select id, row_number() over (partition by repo, path order by id) as position, count(*) over (partition by repo, path) as n from session_chunks",
    "file_symbols": """with f as (select repo, path, symbol, min(struct_pack(line := coalesce(start_line, 0), id := id)) as pos from code_chunks where symbol is not null group by 1, 2, 3)
select repo, path, string_agg(symbol, ', ' order by pos, symbol) as symbols from f group by 1, 2""",
    "top_definitions": f"""with n as (select id, unnest(list_distinct(case when lang = 'python' then regexp_extract_all(chunk, '{texts.PYTHON_DEFINITION}', 1) else regexp_extract_all(chunk, '{texts.SHELL_DEFINITION}', 1) end)) as name
  from code_chunks where chunk is not null) select id, name from n where name <> ''""",
    "run_totals": "select json_extract_string(raw, '$.run_id') as run_id, count(*) as calls, coalesce(sum(json_extract_string(raw, '$.cost_usd')::decimal(12,6)), 0)::double as cost_usd from (select distinct raw from usage_rows where raw is not null) where json_extract_string(raw, '$.run_id') is not null group by 1",
    "live_sessions": f"""select session_id, count(distinct event_id) as calls, strftime(max(ts) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as last_ts from usage_rows
  where session_id is not null and ts <= timestamptz '{AS_OF}+00' group by 1 having epoch_us(timestamptz '{AS_OF}+00') - epoch_us(max(ts)) <= 86400000000""",
    "uncalled_symbols": f"with {_EDGES} select id, symbol from code_chunks where symbol is not null and id not in (select resolved_id from edges where resolved_id is not null)",
    "document_kinds": """with d as (select lower(coalesce(kind, '(none)')) as kind, lower(coalesce(lang, '(none)')) as lang, length(text) as n from documents)
select case when grouping(kind) = 1 then '(all)' else kind end as kind, case when grouping(lang) = 1 then '(all)' else lang end as lang, count(*) as documents, coalesce(sum(n), 0)::bigint as chars from d group by rollup (kind, lang)""",
    "embedding_headers": "select id, coalesce(lang, '') || ' ' || coalesce(symbol, '') || ' in ' || coalesce(path, '') as header from code_chunks",
    "dialogues": "select key, sha256('User: ' || coalesce(prompt, '') || chr(10) || chr(10) || 'Assistant: ' || coalesce(response, '')) as digest from cache_rows",
}

"""Queries and SQL over the chunk tables, documents, the call graph and identifiers."""

from pyspark.sql import functions as F

from tallyloom.operators import cache, corpus, registry, retrieval, texts
from tallyloom.sources.tables import table

DIM = 384
TABLES = ("rules_chunks", "session_chunks", "code_chunks")


def _chunks(spark, d, name="rules_chunks"):
    return table(spark, d, name)


def _known(df):
    return df.where(F.col("repo_commit").isNotNull() & (F.col("repo_commit") != corpus.UNKNOWN))


def _headed(df):
    return df.where(F.coalesce("heading", F.lit("")) != "")


def _diff(spark, d):
    rules = _chunks(spark, d)
    return corpus.manifest_diff(corpus.manifest(_known(rules)), corpus.manifest(_headed(rules)))


def _sweep(spark, d):
    return corpus.sweep({t: _chunks(spark, d, t) for t in TABLES})


def _dates(spark, d):
    rows = _chunks(spark, d, "session_chunks")
    return rows.select("id", corpus.session_date(F.col("heading"), F.col("chunk"), F.col("path")).alias("date"))


def _queries(spark, d, name="code_chunks"):
    """Searches ask for every row whose id is divisible by 50."""
    return table(spark, d, name, "id", "embedding").where(F.col("id") % 50 == 0)


def _topk(spark, d, wanted=None, k=10):
    chunks = table(spark, d, "code_chunks", "id", "repo", "path", "embedding")
    return retrieval.top_k(chunks if wanted is None else chunks.where(wanted), _queries(spark, d), k, DIM)


def _budget(spark, d):
    sizes = table(spark, d, "code_chunks", "id", "chunk").select("id", F.coalesce(F.length("chunk"), F.lit(0)).alias("size"))
    return retrieval.within_budget(_topk(spark, d, k=20), sizes, 8000)


def _edges(spark, d):
    code = table(spark, d, "code_chunks", "id", "repo", "symbol", "chunk")
    return retrieval.resolved(retrieval.call_sites(code), code)


def _sites(spark, d):
    return retrieval.call_sites(table(spark, d, "code_chunks", "id", "symbol", "chunk"))


def _replaced(spark, d):
    again = table(spark, d, "code_chunks", "id", "repo", "symbol", "chunk").where(F.col("repo") == "quill-desk")
    return retrieval.replaced(_sites(spark, d), retrieval.call_sites(again).where(F.length("callee_symbol") > 4))


def _defining(spark, d):
    code = table(spark, d, "code_chunks", "id", "repo", "path", "lang", "symbol", "chunk")
    names = texts.top_definitions(code).join(code.select("id", "repo", "path"), "id")
    return retrieval.defining_chunks(names, code)


def _mentions(spark, d, ledger=None):
    """All mentions, or those of reports (which an identifier ledger is made from) or of all other documents."""
    documents = table(spark, d, "documents", "doc_id", "text", "kind", "source", "updated_at")
    report = F.coalesce(F.col("kind") == "report", F.lit(False))
    return registry.mentions(documents if ledger is None else documents.where(report if ledger else ~report))


def _ledger(spark, d):
    lines = _mentions(spark, d, True).select(F.concat_ws("\t", "ident", F.concat(F.lit("line "), "line_no"), F.concat(F.lit("doc "), "doc_id"), "line").alias("line"))
    return registry.ledger_rows(lines)


def _allocated(spark, d):
    requests = table(spark, d, "documents", "doc_id", "kind").select(F.upper(F.substring("kind", 1, 1)).alias("prefix"), F.col("doc_id").alias("request"))
    return registry.allocated(requests, _mentions(spark, d))


def _all_paths(spark, d):
    rows = table(spark, d, "documents", "path")
    for t in TABLES:
        rows = rows.unionByName(table(spark, d, t, "path"))
    return rows


def _losses(spark, d):
    before = table(spark, d, "session_chunks", "repo", "path", "chunk")
    return corpus.joiner_losses(before, before.withColumn("chunk", F.regexp_replace("chunk", "‌(?=[ .،])|(?<=ه)‌", "")))


QUERIES = {
    "manifest": lambda spark, d: corpus.manifest(_chunks(spark, d)),
    "manifest_diff": _diff,
    "manifest_upsert": lambda spark, d: corpus.manifest_upsert(corpus.manifest(_headed(_chunks(spark, d))), corpus.manifest(_known(_chunks(spark, d)))),
    "chunk_restamped": lambda spark, d: corpus.restamped(_chunks(spark, d), _known(_chunks(spark, d))),
    "commit_stamped": lambda spark, d: corpus.stamped(_chunks(spark, d), corpus.heads(_chunks(spark, d))),
    "chunks_behind": lambda spark, d: corpus.behind(_chunks(spark, d), corpus.heads(_chunks(spark, d))),
    "ingest_stats": lambda spark, d: corpus.ingest_stats(_known(_chunks(spark, d)), _headed(_chunks(spark, d))),
    "discovered_files": lambda spark, d: corpus.discovered(_all_paths(spark, d)),
    "first_chunks": lambda spark, d: corpus.first_per_key(table(spark, d, "session_chunks", "path", "id", "heading"), "path", ["id"]),
    "chunk_upsert": lambda spark, d: corpus.upsert(_known(_chunks(spark, d)), _chunks(spark, d)),
    "chunk_stale": lambda spark, d: corpus.stale(_chunks(spark, d), _known(_headed(_chunks(spark, d)))),
    "collection_counts": lambda spark, d: corpus.counts(_sweep(spark, d)),
    "collection_stale_paths": lambda spark, d: corpus.stale_paths(_sweep(spark, d)),
    "receipts": lambda spark, d: corpus.receipts(table(spark, d, "rules_chunks", "id", "repo", "path", "chunk")),
    "session_dates": _dates,
    "document_measures": lambda spark, d: corpus.measures(table(spark, d, "documents", "doc_id", "text")),
    "script_shares": lambda spark, d: corpus.script_shares(table(spark, d, "documents", "lang", "text")),
    "joiner_losses": _losses,
    "chunk_markdown": lambda spark, d: corpus.chunk_documents(table(spark, d, "documents", "doc_id", "text")),
    "section_lines": lambda spark, d: corpus.sections(table(spark, d, "rules_chunks", "id", "chunk")),
    "vector_topk": lambda spark, d: _topk(spark, d),
    "vector_topk_filtered": lambda spark, d: _topk(spark, d, F.col("repo") == "quill-desk"),
    "vector_topk_under_path": lambda spark, d: _topk(spark, d, F.col("path").startswith("lib/")),
    "vector_topk_budget": _budget,
    "path_vectors": lambda spark, d: retrieval.mean_pooled(table(spark, d, "code_chunks", "path", "embedding").withColumnRenamed("path", "key"), DIM),
    "call_edges": _edges,
    "call_graph_expand": lambda spark, d: retrieval.expand(_topk(spark, d), _edges(spark, d)),
    "call_edges_replaced": _replaced,
    "definition_chunks": _defining,
    "python_calls": lambda spark, d: retrieval.parsed_calls(table(spark, d, "code_chunks", "id", "lang", "chunk")),
    "id_mentions": lambda spark, d: _mentions(spark, d).select("ident", "doc_id", "line_no"),
    "id_gaps": lambda spark, d: registry.gaps(_mentions(spark, d, False), _ledger(spark, d)),
    "id_gap_report": lambda spark, d: registry.gap_report(_mentions(spark, d)),
    "id_ledger": lambda spark, d: _ledger(spark, d).select("ident", "number", "ts", "who").distinct(),
    "id_unrecorded": lambda spark, d: registry.unrecorded(_mentions(spark, d, False), _ledger(spark, d)),
    "id_allocated": _allocated,
    "id_next": lambda spark, d: registry.next_ids(_mentions(spark, d, False), _ledger(spark, d)),
    "id_digests": lambda spark, d: registry.digests(_mentions(spark, d)),
    "prompts_escaped": lambda spark, d: table(spark, d, "cache_rows").select("key", registry.escaped(registry.shortened(F.col("prompt"), 60)).alias("html"), F.md5(registry.redacted(F.concat(F.coalesce("prompt", F.lit("")), F.lit(" see https://x.example/q?key="), F.col("key"), F.lit("&m=1")))).alias("masked")),
    "documents_normal": lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2(cache.normal(F.col("text")), 256).alias("digest")),
}

_LINES = r"regexp_split_to_array({0}, '\r\n|\n|\r')"
_FILES = """(select repo, path, sha256(string_agg(part, '' order by span)) as digest, min(first_id) as first_id, max(last_id) as last_id, sum(n)::bigint as n from (
  select repo, path, floor(id / 10000) as span, sha256(string_agg(coalesce({0}, ''), '' order by id)) as part, min(id) as first_id, max(id) as last_id, count(*) as n
  from rules_chunks where path is not null and {1} group by 1, 2, 3) group by 1, 2)"""
_MANIFEST = "select repo, path, digest as content_hash from " + _FILES.format("chunk_sha", "{0}")
_KNOWN = "repo_commit is not null and repo_commit <> 'unknown'"
_HEADED = "coalesce(heading, '') <> ''"
_HEADS = f"n as (select repo, repo_commit, count(*) as n from rules_chunks where {_KNOWN} and repo is not null group by 1, 2), h as (select repo, max(struct_pack(n := n, c := repo_commit)).c as head from n group by 1)"
_PATHS = " union all ".join(f"select path from {t}" for t in ("documents", *TABLES))
_SWEEP = " union all ".join(f"select '{t}' as collection, id, repo, path, repo_commit from {t}" for t in TABLES)
_USABLE = f"embedding is not null and len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SCORED = f"""q as (select id as query_id, embedding::double[] as q from code_chunks where id % 50 = 0 and {_USABLE}),
scored as (select q.query_id, c.*, round(list_cosine_similarity(c.embedding::double[], q.q), 6) as similarity from code_chunks c, q where {_USABLE.replace('embedding', 'c.embedding')})"""
_TOP = "select query_id, id, similarity from scored where {0} qualify row_number() over (partition by query_id order by similarity desc, id) <= {1}"
_EDGES = r"""sites as (select id as caller_id, string_split(coalesce(symbol, ''), '.')[-1] as own, unnest(list_distinct(regexp_extract_all(chunk, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) as callee_symbol from code_chunks where chunk is not null),
defined as (select repo, string_split(symbol, '.')[-1] as callee_symbol, min(id) as resolved_id from code_chunks where symbol is not null group by 1, 2),
edges as (select distinct s.caller_id, s.callee_symbol, d.resolved_id from sites s join code_chunks c on c.id = s.caller_id
  left join defined d on d.repo = c.repo and d.callee_symbol = s.callee_symbol where s.callee_symbol <> s.own)"""
_IDS = rf"""lines as (select doc_id, unnest({_LINES.format('text')}) as line, generate_subscripts({_LINES.format('text')}, 1) as line_no from documents where text is not null),
found as (select doc_id, line_no::bigint as line_no, line, unnest(list_distinct(regexp_extract_all(line, '\b([DTNBW]-[0-9]+)\b', 1))) as ident from lines),
m as (select *, string_split(ident, '-')[1] as prefix, try_cast(string_split(ident, '-')[2] as bigint) as number from found)"""
_NUMBERED = f"""{_IDS}, u as (select distinct prefix, number from m where number is not null),
b as (select prefix, number, coalesce(lag(number) over (partition by prefix order by number), 0) + 1 as first from u where number > 0),
runs as (select prefix, first, number - 1 as last, number - first as n from b where number > first)"""
_PADDED = "prefix || '-' || case when length(({0})::varchar) < 3 then lpad(({0})::varchar, 3, '0') else ({0})::varchar end"
_JOINERS = "length({0}) - length(replace({0}, '‌', ''))"
_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\p{Z}]"
_T = "coalesce(text, '')"
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ANY_LINE = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

SQL = {
    "manifest": _MANIFEST.format("true"),
    "manifest_diff": f"""with a as ({_MANIFEST.format(_KNOWN)}), b as ({_MANIFEST.format(_HEADED)})
select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed'
  when a.content_hash <> b.content_hash then 'changed' else 'same' end as status from a full join b on a.repo = b.repo and a.path = b.path""",
    "chunk_upsert": f"""with n as (select repo, path, chunk_sha, min(id) as new_id from rules_chunks group by 1, 2, 3), o as (select repo, path, chunk_sha, min(id) as old_id from rules_chunks where {_KNOWN} group by 1, 2, 3)
select repo, path, chunk_sha, coalesce(old_id, new_id) as id, old_id is null as is_new from n left join o using (repo, path, chunk_sha)""",
    "chunk_stale": f"""with i as (select distinct repo, path, chunk_sha from rules_chunks where {_KNOWN} and {_HEADED}), p as (select distinct repo, path from i)
select s.id, case when p.path is not null then 'chunk_gone' else 'path_gone' end as reason from rules_chunks s
  left join i on i.repo = s.repo and i.path = s.path and i.chunk_sha = s.chunk_sha left join p on p.repo = s.repo and p.path = s.path where i.path is null""",
    "collection_counts": f"""with s as ({_SWEEP}) select collection, repo, count(*) as chunks, count(distinct path) as files, count(*) filter (repo_commit is null or repo_commit = 'unknown') as unknown_commit,
  count(distinct repo_commit) filter (repo_commit <> 'unknown') as commits from s group by 1, 2""",
    "collection_stale_paths": f"""with s as ({_SWEEP}) select collection, repo, path, count(*) as chunks, count(distinct coalesce(repo_commit, 'unknown')) as commits from s group by 1, 2, 3
  having count(distinct coalesce(repo_commit, 'unknown')) > 1 or count(*) filter (coalesce(repo_commit, 'unknown') = 'unknown') > 0""",
    "receipts": f"select repo, path, substring(digest, 1, 12) as receipt, first_id, last_id, n from {_FILES.format('sha256(chunk)', 'true').replace('coalesce(sha256(chunk), ' + chr(39) * 2 + ')', 'sha256(coalesce(chunk, ' + chr(39) * 2 + '))')}",
    "manifest_upsert": f"with a as ({_MANIFEST.format(_HEADED)}), b as ({_MANIFEST.format(_KNOWN)}) select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, coalesce(b.content_hash, a.content_hash) as content_hash from a full join b on a.repo = b.repo and a.path = b.path",
    "chunk_restamped": f"with i as (select repo, path, chunk_sha, max(repo_commit) as c from rules_chunks where {_KNOWN} group by 1, 2, 3) select s.id, coalesce(i.c, s.repo_commit) as repo_commit from rules_chunks s left join i on i.repo = s.repo and i.path = s.path and i.chunk_sha = s.chunk_sha",
    "commit_stamped": f"with {_HEADS} select id, coalesce(head, repo_commit) as repo_commit from rules_chunks left join h using (repo)",
    "chunks_behind": f"with {_HEADS} select repo, count(*) as chunks, count(*) filter (repo_commit is distinct from head) as behind from rules_chunks join h using (repo) group by 1",
    "ingest_stats": f"""with i as (select distinct repo, path, chunk_sha from rules_chunks where {_HEADED}), s as (select * from rules_chunks where {_KNOWN}), k as (select distinct repo, path, chunk_sha from s),
seen as (select i.repo, count(*) as seen, count(*) filter (k.repo is null) as written, count(*) filter (k.repo is not null) as skipped from i left join k on k.repo = i.repo and k.path = i.path and k.chunk_sha = i.chunk_sha group by 1),
gone as (select s.repo, count(*) as deleted from s left join i on i.repo = s.repo and i.path = s.path and i.chunk_sha = s.chunk_sha where i.path is null group by 1)
select coalesce(seen.repo, gone.repo) as repo, coalesce(seen, 0) as seen, coalesce(written, 0) as written, coalesce(skipped, 0) as skipped, coalesce(deleted, 0) as deleted from seen full join gone on seen.repo = gone.repo""",
    "discovered_files": " union ".join(f"select '{name}' as collection, path from ({_PATHS}) where regexp_matches(path, '{take}') and not regexp_matches(path, '{leave}')" for name, (take, leave) in corpus.DISCOVERY.items()),
    "first_chunks": "select path, id, heading from session_chunks where path is not null qualify row_number() over (partition by path order by id) = 1",
    "session_dates": r"""with s as (select id, heading, chunk, string_split(path, '/')[-1] as name from session_chunks), d as (select *, nullif(regexp_extract(name, '([0-9]{8})', 1), '') as digits from s)
select id, coalesce(nullif(regexp_extract(heading, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), nullif(regexp_extract(heading, '([0-9]{4}-[0-9]{2})', 1), ''),
  nullif(regexp_extract(chunk, '[dD]ate:[ \t\n\r]*["'']?([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), nullif(regexp_extract(name, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''),
  substring(digits, 1, 4) || '-' || substring(digits, 5, 2) || '-' || substring(digits, 7, 2), nullif(regexp_extract(name, '([0-9]{4}-[0-9]{2})', 1), '')) as date from d""",
    "document_measures": rf"""select doc_id, length({_T})::bigint as chars, (case when {_T} = '' then 0 else len({_LINES.format(_T)}) end)::bigint as lines, len(regexp_extract_all({_T}, '[^ \t\r\n]+'))::bigint as words,
  (length({_T}) // 3)::bigint as est_tokens, (length({_T}) // 4)::bigint as est_tokens_4, len(regexp_extract_all({_T}, '[^ \t\r\n]+'))::bigint * 2 as est_tokens_words, ({_JOINERS.format(_T)})::bigint as joiners from documents""",
    "script_shares": f"select lower(coalesce(lang, '(none)')) as lang, count(*) as documents, count(*) filter (regexp_matches({_T}, '[؀-ۿ]')) as arabic, sum({_JOINERS.format(_T)})::bigint as joiners from documents group by 1",
    "joiner_losses": f"""with b as (select repo, path, sum({_JOINERS.format('chunk')})::bigint as joiners_before from session_chunks group by 1, 2),
a as (select repo, path, sum({_JOINERS.format("regexp_replace(regexp_replace(chunk, '‌([ .،])', '" + chr(92) + "1', 'g'), 'ه‌', 'ه', 'g')")})::bigint as joiners_after from session_chunks group by 1, 2)
select repo, path, joiners_before, joiners_after from b join a using (repo, path) where joiners_after < joiners_before""",
    "chunk_markdown": rf"""with recursive t as (select doc_id, regexp_split_to_array(text, '{_ANY_LINE}') as a from documents where text <> ''),
l as (select * from (select doc_id, unnest(a) as line, generate_subscripts(a, 1) - 1 as i, len(a) as n from t) where i < n - 1 or line <> ''),
m as (select *, regexp_matches(line, '^{_WHITE}*```') as mark, sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as before, not regexp_matches(line, '[^{_WHITE[1:-1]}]') as blank from l),
h as (select *, not mark and sum(mark::int) over (partition by doc_id order by i) % 2 = 0 and regexp_matches(line, '^#+ ') as head from m),
s as (select *, sum(head::int) over (partition by doc_id order by i) as sec from h),
e as (select doc_id, sec, min(i) as first, max(i) + 1 as last, coalesce(max(regexp_replace(line, '^{_WHITE}+|{_WHITE}+$', '', 'g')) filter (head), '') as heading from s group by 1, 2),
b as (select doc_id, sec, i, before from s where blank),
j as (select s.doc_id, s.sec, s.i, b.i as cut from s asof left join b on s.doc_id = b.doc_id and s.sec = b.sec and s.before + 904 <= b.before),
p as (select doc_id, sec, first as i from e union all select p.doc_id, p.sec, j.cut + 1 from p join j on j.doc_id = p.doc_id and j.sec = p.sec and j.i = p.i join e on e.doc_id = p.doc_id and e.sec = p.sec where j.cut + 1 < e.last),
c as (select p.doc_id, p.i, heading, case when p.i = first then p.i + 1 else p.i end as start_line, regexp_replace(array_to_string(a[p.i + 1:coalesce(j.cut, last)], chr(10)), '^{_WHITE}+|{_WHITE}+$', '', 'g') as chunk
  from p join j on j.doc_id = p.doc_id and j.sec = p.sec and j.i = p.i join e on e.doc_id = p.doc_id and e.sec = p.sec join t on t.doc_id = p.doc_id)
select doc_id, (row_number() over (partition by doc_id order by i))::int as chunk_no, heading, start_line::int as start_line, chunk from c where chunk <> heading and regexp_matches(chunk, '[\p{{L}}\p{{N}}]')""",
    "section_lines": rf"""with l as (select id, unnest({_LINES.format('chunk')}) as line, generate_subscripts({_LINES.format('chunk')}, 1)::bigint as line_no from rules_chunks where chunk is not null),
f as (select *, regexp_matches(line, '^[ \t]*```') as fence, sum(regexp_matches(line, '^[ \t]*```')::int) over (partition by id order by line_no) % 2 = 1 as fenced from l)
select id, line_no, line, last_value(case when regexp_matches(line, '^#+ ') then trim(line, ' ') end ignore nulls) over (partition by id order by line_no) as heading from f where not fenced and not fence""",
    "vector_topk": f"with {_SCORED} {_TOP.format('true', 10)}",
    "vector_topk_under_path": f"with {_SCORED} {_TOP.format(chr(39).join(('starts_with(path, ', 'lib/', ')')), 10)}",
    "path_vectors": f"""with v as (select path as key, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from code_chunks where path is not null and {_USABLE}),
c as (select path as key, count(*) as n from code_chunks where path is not null and {_USABLE} group by 1), t as (select key, i, sum(x) as x from v group by 1, 2),
l as (select key, greatest(sqrt(sum(x * x)), 1e-9) as l from t group by 1) select key, any_value(n) as n, list(round(x / l, 6) + 0.0 order by i) as embedding from t join l using (key) join c using (key) group by 1""",
    "vector_topk_filtered": f"with {_SCORED} {_TOP.format(chr(39).join(('repo = ', 'quill-desk', '')), 10)}",
    "vector_topk_budget": f"""with {_SCORED}, top as ({_TOP.format('true', 20)}),
cut as (select t.*, sum(coalesce(length(chunk), 0)) over (partition by query_id order by similarity desc, id) as upto from top t join code_chunks using (id)) select query_id, id, similarity from cut where upto <= 8000""",
    "call_edges": f"with {_EDGES} select * from edges",
    "call_graph_expand": f"""with {_SCORED}, {_EDGES}, hits as ({_TOP.format('true', 10)}),
every as (select query_id, id, 0 as r from hits union all select query_id, caller_id, 1 from edges join hits on resolved_id = id union all select query_id, resolved_id, 2 from edges join hits on caller_id = id where resolved_id is not null)
select query_id, id, case min(r) when 0 then 'hit' when 1 then 'caller' else 'callee' end as role from every group by 1, 2""",
    "call_edges_replaced": f"""with {_EDGES}, again as (select id from code_chunks where repo = 'quill-desk'), n as (select caller_id, callee_symbol from edges where caller_id in (select id from again) and length(callee_symbol) > 4)
select caller_id, callee_symbol from edges where caller_id not in (select caller_id from n) union select * from n""",
    "definition_chunks": f"""with n as (select id, repo, path, unnest(list_distinct(case when lang = 'python' then regexp_extract_all(chunk, '{texts.PYTHON_DEFINITION}', 1) else regexp_extract_all(chunk, '{texts.SHELL_DEFINITION}', 1) end)) as name from code_chunks where chunk is not null),
s as (select repo, path, symbol as name, min(id) as symbol_id from code_chunks where symbol is not null group by 1, 2, 3) select n.id, n.name, symbol_id from n join s on s.repo = n.repo and s.path = n.path and s.name = n.name""",
    "id_mentions": f"with {_IDS} select ident, doc_id, line_no from m",
    "id_gaps": f"with {_NUMBERED} select prefix, first, last, n from runs",
    "id_gap_report": f"""with {_NUMBERED}, each as (select prefix, unnest(generate_series(first, least(last, first + 9))) as number from runs),
head as (select prefix, number from each qualify row_number() over (partition by prefix order by number) <= 10), named as (select prefix, string_agg(number::varchar, ', ' order by number) as gaps, count(*) as shown from head group by 1)
select prefix, gaps, (n - shown)::bigint as more from named join (select prefix, sum(n) as n from runs group by 1) using (prefix)""",
    "id_ledger": f"with {_IDS} select distinct ident, number, 'line ' || line_no as ts, 'doc ' || m.doc_id as who from m join documents d on d.doc_id = m.doc_id where kind = 'report'",
    "id_unrecorded": f"with {_IDS}, k as (select ident, coalesce(kind = 'report', false) as report from m join documents d on d.doc_id = m.doc_id) select ident from k group by 1 having not bool_or(report)",
    "id_allocated": f"""with {_IDS}, g as (select prefix, max(number) as greatest from m group by 1), r as (select distinct upper(substring(kind, 1, 1)) as prefix, doc_id as request from documents where kind is not null)
select prefix, request, {_PADDED.format('coalesce(greatest, 0) + row_number() over (partition by prefix order by request)')} as ident from r left join g using (prefix)""",
    "id_next": f"with {_IDS} select prefix, prefix || '-' || case when length((max(number) + 1)::varchar) < 3 then lpad((max(number) + 1)::varchar, 3, '0') else (max(number) + 1)::varchar end as next_id, max(number) as greatest from m group by 1",
    "id_digests": rf"""with {_IDS}, g as (select ident, count(*) as n_lines, count(distinct doc_id) as n_docs, min(struct_pack(a := doc_id, b := line_no, c := line)) as x from m group by 1),
c as (select *, trim(regexp_replace(regexp_replace(x.c, '[*_`]+', '', 'g'), '{registry.SIGNS}', ''), ' ') as clean from g), h as (select *, substring(clean, 1, 79) as head from c), w as (select *, regexp_extract(head, '(?s)^(.*) ', 1) as word from h)
select ident, n_lines, n_docs, x.a as first_doc, case when length(clean) <= 80 then clean else (case when word <> '' then word else head end) || '…' end as summary from w""",
    "prompts_escaped": r"""with t as (select key, case when length(prompt) <= 60 then prompt else rtrim(substring(prompt, 1, 59), ' ') || '…' end as short,
  coalesce(prompt, '') || ' see https://x.example/q?key=' || key || '&m=1' as url from cache_rows)
select key, replace(replace(replace(short, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html,
  md5(regexp_replace(regexp_replace(url, '([?&]key=)[^&\s''"]+([^&\s''"]{4})', '\1<redacted...\2>', 'g'), '([?&]key=)[^&\s''"<]{1,4}([&\s''"]|$)', '\1<redacted>\2', 'g')) as masked from t""",
    "documents_normal": f"select doc_id, sha256(trim(regexp_replace(nfc_normalize({_T}), '{_SPACE}+', ' ', 'g'))) as digest from documents",
}

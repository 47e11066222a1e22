"""Queries and SQL of the operators for training data."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import confusables, leakage, neighbours, pairs, residue, splitting, tokenizing
from tallyloom.sources.tables import table


def _look_forms(spark: SparkSession, d: str) -> DataFrame:
    rules, sessions = (confusables.forms(table(spark, d, t, "id", "chunk"), t) for t in ("rules_chunks", "session_chunks"))
    return rules.unionByName(sessions)


def _split(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "rules_chunks", "id", "start_line", "chunk").withColumn("end_line", F.lit(None).cast("int"))
    code = table(spark, d, "code_chunks", "id", "start_line", "end_line", "chunk")
    both = rules.withColumn("chunk_table", F.lit("rules_chunks")).unionByName(code.withColumn("chunk_table", F.lit("code_chunks")))
    return splitting.split_oversized(both)


def _leaks(spark: SparkSession, d: str, edits: int = 0) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"), edits=edits)


def _embedded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t, "id", "embedding") for t in ("code_chunks", "rules_chunks", "session_chunks")}


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.not_content(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {
    "p1_found": lambda spark, d: pairs.defects(table(spark, d, "cache_rows", "key", "prompt", "response"), table(spark, d, "documents", "doc_id", "text", "lang")),
    "p2_found": lambda spark, d: confusables.look_alike_pairs(_look_forms(spark, d)),
    "p2_forms": lambda spark, d: confusables.consistent(table(spark, d, "rules_chunks", "id", "chunk"), "rules_chunks").unionByName(confusables.consistent(table(spark, d, "session_chunks", "id", "chunk"), "session_chunks")),
    "p2_classes": lambda spark, d: confusables.look_classes(_look_forms(spark, d)),
    "p3_found": lambda spark, d: neighbours.nearest_pairs(_embedded(spark, d)),
    "p3_nearest": lambda spark, d: neighbours.nearest(_embedded(spark, d)),
    "p3_search": lambda spark, d: neighbours.searched(_embedded(spark, d)),
    "p5_found": lambda spark, d: splitting.hardest_cuts(_split(spark, d)),
    "p5_pieces": lambda spark, d: splitting.piece_rows(_split(spark, d)),
    "p5_checked": lambda spark, d: splitting.checked(_split(spark, d)),
    "p6_ids": lambda spark, d: tokenizing.encode_ids(table(spark, d, "documents", "doc_id", "text")),
    "p7_found": lambda spark, d: _leaks(spark, d).select("doc_id", "item_id"),
    "p7_passages": _leaks,
    "p7_edited": lambda spark, d: _leaks(spark, d, edits=2),
    "p8_found": lambda spark, d: _residue(spark, d).select("doc_id"),
    "p8_kinds": _residue,
    "p6_round_trip": lambda spark, d: tokenizing.round_trip(table(spark, d, "documents", "doc_id", "text")),
}

_USABLE = "embedding is not null and len(embedding) = 384 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VECTORS = " union all ".join(f"select '{t}' as chunk_table, id, embedding::double[] as e from {t} where {_USABLE}" for t in ("code_chunks", "rules_chunks", "session_chunks"))
_WINDOWS = r"""(select {0}, array_to_string(ws[i:i + 19], ' ') as passage from (select {0}, regexp_extract_all(lower(nfc_normalize(text)), '[\p{{L}}\p{{N}}]+') as ws from {1} where text is not null) w,
  unnest(range(1, len(ws) - 18)) as r(i))"""

SQL = {
    "p3_found": f"""with v as ({_VECTORS}), s as (select a.chunk_table, a.id, b.id as other, round(list_cosine_similarity(a.e, b.e), 12) as similarity from v a join v b on a.chunk_table = b.chunk_table and a.id <> b.id),
r as (select *, row_number() over (partition by chunk_table, id order by similarity desc, other) as rank from s)
select distinct chunk_table, least(id, other) as id_a, greatest(id, other) as id_b from r where rank <= 5""",
    "p7_found": f"select distinct doc_id, item_id from {_WINDOWS.format('doc_id', 'documents')} d join {_WINDOWS.format('item_id', 'eval_items')} i on i.passage = d.passage",
    "p5_checked": " union all ".join(f"select '{t}' as chunk_table, id, md5(chunk) as digest, true as within, true as overlapping from {t} where length(chunk) > 1200" for t in ("rules_chunks", "code_chunks")),
    "p5_found": r"""
with chunks as (select 'rules_chunks' as chunk_table, id, chunk from rules_chunks union all
    select 'code_chunks', id, chunk from code_chunks),
longest as (select chunk_table, id,
    list_max(list_transform(regexp_split_to_array(chunk, '\r\n|\n|\r'), lambda x: length(x))) as line,
    list_max(list_transform(regexp_split_to_array(chunk, '[ \t\r\n]+'), lambda x: length(x))) as word
    from chunks where length(chunk) > 1200)
select distinct chunk_table, id, case when line <= 1200 then 'line' when word <= 1200 then 'word' else 'hard' end as cut from longest""",
}

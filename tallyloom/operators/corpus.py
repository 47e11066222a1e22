"""Corpus indexing: manifests, upserts, garbage collection, receipts, dates, Markdown chunks and text measures."""

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
LINE_END = r"\r\n|[\n\r]"
LINE_ENDS, HEADING = re.compile(LINE_END), re.compile("#+ ")


SPAN = 10_000  # consecutive ids of which the digests make one


def digest_of_file(chunks: DataFrame, part: Column) -> DataFrame:
    """(repo, path, digest, first_id, last_id, n): SHA-256 over the digests of a file's spans of ids, each over its chunks' parts in id order.

    Two steps, so that of a file with any share of all rows no task holds more than the digests of SPAN ids, then one for each span. Rows
    of a null path or id belong to no file.
    """
    known = chunks.where(F.col("path").isNotNull() & F.col("id").isNotNull()).select("repo", "path", "id", F.coalesce(part, F.lit("")).alias("part"))
    over = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "part"))), lambda x: x["part"]), ""), 256)
    spans = known.groupBy("repo", "path", F.floor(F.col("id") / SPAN).alias("span")).agg(over("id").alias("part"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))
    return spans.groupBy("repo", "path").agg(over("span").alias("digest"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))


def manifest(chunks: DataFrame) -> DataFrame:
    """(repo, path, content_hash): one row per file; a hash of the hashes of its spans, each of its chunks' hashes in id order."""
    return digest_of_file(chunks, F.col("chunk_sha")).select("repo", "path", F.col("digest").alias("content_hash"))


def manifest_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(repo, path, content_hash): one row per file after `incoming` was written over `stored`."""
    rows = stored.select("repo", "path", F.lit(0).alias("order"), "content_hash").unionByName(incoming.select("repo", "path", F.lit(1).alias("order"), "content_hash"))
    return rows.groupBy("repo", "path").agg(F.max(F.struct("order", "content_hash"))["content_hash"].alias("content_hash"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, status): added, removed, changed or same for every file of either manifest."""
    a, b = old.select("repo", "path", F.col("content_hash").alias("old_hash")), new.select("repo", "path", F.col("content_hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    return a.join(b, ["repo", "path"], "full_outer").select("repo", "path", status.alias("status"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(repo, path, chunk_sha, id, is_new): incoming chunks once per (repo, path, chunk_sha), with the id they already have.

    Equal chunks of a file collapse to the least id. Chunks already stored keep their id, others bring their own.
    """
    key = ["repo", "path", "chunk_sha"]
    once = lambda df, name: df.groupBy(*key).agg(F.min("id").alias(name))
    joined = once(incoming, "new_id").join(once(stored, "old_id"), key, "left")
    return joined.select(*key, F.coalesce("old_id", "new_id").alias("id"), F.col("old_id").isNull().alias("is_new"))


def stale(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunk ids whose (repo, path, chunk_sha) the incoming corpus lacks, with the reason: path_gone or chunk_gone."""
    gone = stored.join(incoming.select("repo", "path", "chunk_sha").distinct(), ["repo", "path", "chunk_sha"], "left_anti").select("repo", "path", "id")
    paths = incoming.select("repo", "path", F.lit(True).alias("seen")).distinct()
    return gone.join(paths, ["repo", "path"], "left").select("id", F.when(F.col("seen"), "chunk_gone").otherwise("path_gone").alias("reason"))


def restamped(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, repo_commit): stored chunks with the commit of the incoming chunk of the same repo, path and hash, if there is one.

    Of several equal incoming chunks the greatest commit counts.
    """
    key = ["repo", "path", "chunk_sha"]
    new = incoming.groupBy(*key).agg(F.max("repo_commit").alias("new_commit"))
    return stored.select("id", "repo_commit", *key).join(new, key, "left").select("id", F.coalesce("new_commit", "repo_commit").alias("repo_commit"))


def stamped(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, repo_commit): all chunks of a repo in heads (repo, head) at its head, others as they are."""
    return chunks.select("id", "repo", "repo_commit").join(heads.select("repo", "head"), "repo", "left").select("id", F.coalesce("head", "repo_commit").alias("repo_commit"))


def heads(chunks: DataFrame) -> DataFrame:
    """(repo, head): the known commit that most chunks of a repo have; the greatest of several."""
    known = chunks.where(F.col("repo_commit").isNotNull() & (F.col("repo_commit") != UNKNOWN) & F.col("repo").isNotNull())
    counted = known.groupBy("repo", "repo_commit").agg(F.count("*").alias("n"))
    return counted.groupBy("repo").agg(F.max(F.struct("n", "repo_commit"))["repo_commit"].alias("head"))


def behind(chunks: DataFrame, heads_: DataFrame) -> DataFrame:
    """(repo, chunks, behind): how many chunks of a repo are not at its head."""
    joined = chunks.select("repo", "repo_commit").join(heads_, "repo")
    return joined.groupBy("repo").agg(F.count("*").alias("chunks"), F.count_if(~F.col("repo_commit").eqNullSafe(F.col("head"))).alias("behind"))


def ingest_stats(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(repo, seen, written, skipped, deleted): what an ingest of `incoming` over `stored` does, in chunks per repo.

    seen: incoming files' chunks, each distinct one once; written or skipped: whether it was new; deleted: stored rows without a counterpart.
    """
    new = upsert(stored, incoming).groupBy("repo").agg(F.count("*").alias("seen"), F.count_if("is_new").alias("written"), F.count_if(~F.col("is_new")).alias("skipped"))
    gone = stale(stored, incoming).join(stored.select("id", "repo"), "id").groupBy("repo").agg(F.count("*").alias("deleted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return new.join(gone, "repo", "full_outer").select("repo", *map(zero, ("seen", "written", "skipped", "deleted")))


# Where the files of each collection lie, as patterns of paths, and what is left out.
DISCOVERY = {
    "rules": (r"(^|/)\.agent/constitution/rules/[^/]+\.md$|(^|/)docs/.+\.md$|(^|/)CLAUDE\.md$", r"(^|/)docs/(.+/)?(fa|legacy)/|\.fa\.md$"),
    "skills": (r"(^|/)\.agent/constitution/skills/[^/]+\.md$", r"^$"),
    "sessions": (r"(^|/)workspace/SESSION\.md$|/archive[^/]*/(.+/)?[^/]+\.(md|txt)$|(^|/)_memory/sessions/.+\.md$|(^|/)_memory/handoffs/[^/]+\.(md|txt)$|(^|/)_memory/REGISTRY-IDS\.md$", r"(^|/)\.[^/]*$"),
    "code": (r"\.(py|sh)$", r"^$"),
}


def discovered(files: DataFrame) -> DataFrame:
    """(collection, path): each path of a file listing (path) under every collection that takes it, once."""
    takes = [F.when(F.col("path").rlike(take) & ~F.col("path").rlike(leave), F.lit(name)) for name, (take, leave) in DISCOVERY.items()]
    return files.select("path", F.explode(F.array_compact(F.array(*takes))).alias("collection")).select("collection", "path").distinct()


def first_per_key(rows: DataFrame, key: str, order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that tells all rows apart; ranked before the shuffle too. Null keys are left out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.where(F.col(key).isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sweep(tables: dict[str, DataFrame]) -> DataFrame:
    """All collections in one: (collection, id, repo, path, repo_commit)."""
    parts = [df.select(F.lit(name).alias("collection"), "id", "repo", "path", "repo_commit") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def counts(chunks: DataFrame) -> DataFrame:
    """Chunks, files, chunks of unknown commit and distinct commits per collection and repo."""
    known = F.when(F.col("repo_commit").isNotNull() & (F.col("repo_commit") != UNKNOWN), F.col("repo_commit"))
    return chunks.groupBy("collection", "repo").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"), F.count_if(known.isNull()).alias("unknown_commit"), F.countDistinct(known).alias("commits"))


def stale_paths(chunks: DataFrame) -> DataFrame:
    """Files whose chunks do not all have one known commit: (collection, repo, path, chunks, commits)."""
    commit = F.coalesce("repo_commit", F.lit(UNKNOWN))
    grouped = chunks.groupBy("collection", "repo", "path").agg(F.count("*").alias("chunks"), F.countDistinct(commit).alias("commits"), F.count_if(commit == UNKNOWN).alias("unknown"))
    return grouped.where((F.col("commits") > 1) | (F.col("unknown") > 0)).select("collection", "repo", "path", "chunks", "commits")


def receipts(chunks: DataFrame) -> DataFrame:
    """(repo, path, receipt, first_id, last_id, n): 12 hex digits over a file's chunks in id order, as a hash of hashes; texts stay where they are read."""
    rows = digest_of_file(chunks, F.sha2(F.coalesce("chunk", F.lit("")), 256))
    return rows.select("repo", "path", F.substring("digest", 1, 12).alias("receipt"), "first_id", "last_id", "n")


def session_date(heading: Column, text: Column, path: Column) -> Column:
    """The first of: a day or month in the heading, a date: field in the text, a day, eight digits or a month in the file name.

    Kept as text, since a month is no date; null where there is none.
    """
    name = F.element_at(F.split(path, "/"), -1)
    take = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    digits = take(name, r"([0-9]{8})")
    return F.coalesce(
        take(heading, r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), take(heading, r"([0-9]{4}-[0-9]{2})"), take(text, r"[dD]ate:[ \t\n\r]*[\"']?([0-9]{4}-[0-9]{2}-[0-9]{2})"),
        take(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2)),
        take(name, r"([0-9]{4}-[0-9]{2})"),
    )


def measures(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters, lines, words, tokens as estimated in three ways (a third and a quarter of the characters, twice the words) and
    zero-width non-joiners of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.when(t == "", 0).otherwise(F.size(F.split(t, LINE_END)))
    words = F.regexp_count(t, F.lit(r"[^ \t\r\n]+")).cast("long")
    return documents.select(
        key, F.length(t).cast("long").alias("chars"), lines.cast("long").alias("lines"), words.alias("words"), F.floor(F.length(t) / 3).cast("long").alias("est_tokens"),
        F.floor(F.length(t) / 4).cast("long").alias("est_tokens_4"), (words * 2).alias("est_tokens_words"), (F.length(t) - F.length(F.replace(t, F.lit("‌")))).cast("long").alias("joiners"),
    )


def script_shares(documents: DataFrame) -> DataFrame:
    """(lang, documents, arabic, joiners): per declared language, texts with Arabic-script letters and their non-joiners."""
    t = F.coalesce("text", F.lit(""))
    joiners = F.length(t) - F.length(F.replace(t, F.lit("‌")))
    return documents.groupBy(F.lower(F.coalesce("lang", F.lit("(none)"))).alias("lang")).agg(F.count("*").alias("documents"), F.count_if(t.rlike("[؀-ۿ]")).alias("arabic"), F.sum(joiners).cast("long").alias("joiners"))


def joiner_losses(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, joiners_before, joiners_after) of files, present in both, with fewer zero-width non-joiners after than before."""
    per_file = lambda df, name: df.groupBy("repo", "path").agg(F.sum(F.length("chunk") - F.length(F.replace("chunk", F.lit("‌")))).cast("long").alias(name))
    both = per_file(before, "joiners_before").join(per_file(after, "joiners_after"), ["repo", "path"])
    return both.where(F.col("joiners_after") < F.col("joiners_before"))


def outside_fences(rows: list[str]) -> list[bool]:
    """Whether each line stands outside code fences; the marks of a fence count as inside."""
    marks = [row.lstrip().startswith("```") for row in rows]
    return [not mark and seen % 2 == 0 for mark, seen in zip(marks, accumulate(marks))]


def markdown_chunks(text: str | None, max_tokens: int = 300, chars_per_token: int = 3) -> list[tuple[str, int, str]]:
    """(heading, start_line, text): the sections between headings outside code fences, long ones in parts.

    A part ends at the first blank line at which it has more than `max_tokens`, as estimated from its characters; the next one
    begins after that line and has its number. Parts of only their heading or without any letter or digit are dropped.
    """
    rows = (text or "").splitlines()
    before = [0, *accumulate(len(row) + 1 for row in rows)]  # characters before each line, line ends included
    blank = [i for i, row in enumerate(rows) if not row.strip()]
    heads = [i for i, (row, free) in enumerate(zip(rows, outside_fences(rows))) if free and HEADING.match(row)]
    starts, chunks = set(heads), []
    for begin, end in pairwise([0, *heads, len(rows)] if heads[:1] != [0] else [*heads, len(rows)]):
        heading, number = rows[begin].strip() if begin in starts else "", begin + 1
        while begin < end:
            enough = before[begin] + 1 + chars_per_token * (max_tokens + 1)
            cut = bisect_left(blank, enough, lo=bisect_left(blank, begin), key=before.__getitem__)
            stop = blank[cut] if cut < len(blank) and blank[cut] < end else end
            part = "\n".join(rows[begin:stop]).strip()
            if part != heading and any(map(str.isalnum, part)):
                chunks.append((heading, number, part))
            begin, number = stop + 1, stop + 1
    return chunks


def chunk_documents(documents: DataFrame, max_tokens: int = 300, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, heading, start_line, chunk) of every text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, *c) for d, t in zip(b["doc_id"], b["text"]) for n, c in enumerate(markdown_chunks(t, max_tokens), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "heading", "start_line", "chunk"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, chunk_no int, heading string, start_line int, chunk string")


def sections(texts: DataFrame, key: str = "id", text: str = "chunk") -> DataFrame:
    """(id, line_no, line, heading): the lines of a text outside code fences under the heading seen last; lines before any have none.

    A text is looked at where it is read; nothing is shuffled. Null texts have no lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for i, t in zip(b["key"], b["text"]):
                rows, heading = LINE_ENDS.split(t), None
                for n, (row, free) in enumerate(zip(rows, outside_fences(rows)), 1):
                    if free:
                        heading = row.strip(" ") if HEADING.match(row) else heading
                        found.append((i, n, row, heading))
            yield pd.DataFrame(found, columns=["key", "line_no", "line", "heading"])

    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key long, line_no long, line string, heading string").withColumnRenamed("key", key)

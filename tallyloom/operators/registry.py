"""Registries of identifiers like D-017 in running text and in ledgers: extraction, gaps, next numbers and digests.

An identifier of more than 18 digits has no number: it is mentioned, but no gap or next number follows from it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = r"\b([DTNBW]-[0-9]+)\b"
MARKS = r"[*_`]+"
SIGNS = r"^[ \x{2190}-\x{2bff}\x{fe0f}\x{1f300}-\x{1faff}]+"  # arrows, check marks and pictures that tell a status
LONGEST = 80


def mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, prefix, number, doc_id, line_no, line): one row per line and distinct identifier in it."""
    rows = documents.where(F.col(text).rlike(ID)).select(key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("at", "line"))
    each = rows.where(F.col("line").rlike(ID)).select("*", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(ID), F.lit(1)))).alias("ident"))
    parts = F.split("ident", "-")
    return each.select("ident", parts[0].alias("prefix"), parts[1].try_cast("long").alias("number"), key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def ledger_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """(ident, prefix, number, ts, who, intent) of an identifier ledger, one line of tab-divided fields each.

    Lines whose first field is not just an identifier are left out; missing fields are null.
    """
    rows = lines.select(F.split(line, "\t").alias("f")).where(F.col("f")[0].rlike(r"^[DTNBW]-[0-9]+$"))
    parts, field = F.split(F.col("f")[0], "-"), lambda i: F.get("f", F.lit(i))
    return rows.select(F.col("f")[0].alias("ident"), parts[0].alias("prefix"), parts[1].try_cast("long").alias("number"), field(1).alias("ts"), field(2).alias("who"), field(3).alias("intent"))


def unrecorded(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """(ident): identifiers that are mentioned but not in the ledger."""
    return found.select("ident").distinct().join(ledger.select("ident"), "ident", "left_anti")


def used(*sources: DataFrame) -> DataFrame:
    """(prefix, number): the numbers in any of the sources, once each."""
    numbers = [s.where(F.col("number").isNotNull()).select("prefix", "number") for s in sources]
    every = numbers[0]
    for n in numbers[1:]:
        every = every.unionByName(n)
    return every.distinct()


def gaps(*sources: DataFrame) -> DataFrame:
    """(prefix, first, last, n): runs of numbers from 1 to a prefix's greatest that no source has.

    A run is one row however long it is; a window holds the used numbers of a prefix.
    """
    before = F.coalesce(F.lag("number").over(Window.partitionBy("prefix").orderBy("number")), F.lit(0))
    rows = used(*sources).where("number > 0").withColumn("first", before + 1).where(F.col("number") > F.col("first"))
    return rows.select("prefix", "first", (F.col("number") - 1).alias("last"), (F.col("number") - F.col("first")).alias("n"))


def gap_report(*sources: DataFrame, most: int = 10) -> DataFrame:
    """(prefix, gaps, more): the first `most` missing numbers of a prefix with commas, and how many there are besides."""
    runs = gaps(*sources)
    first = F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + most - 1)))
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("number"))
    head = runs.select("prefix", first.alias("number")).withColumn("rank", rank).where(F.col("rank") <= most)
    named = head.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("number")).cast("array<string>"), ", ").alias("gaps"), F.count("*").alias("shown"))
    return named.join(runs.groupBy("prefix").agg(F.sum("n").alias("n")), "prefix").select("prefix", "gaps", (F.col("n") - F.col("shown")).alias("more"))


def allocated(requests: DataFrame, *sources: DataFrame, block: int = 100_000) -> DataFrame:
    """(prefix, request, ident): the next free identifiers of a prefix for a batch of requests (prefix, request), in their order.

    Requests are numbered within blocks of `block` consecutive values, and blocks by the counts of those before, so that a prefix with
    most of the requests is spread over tasks. A repeated request gets one identifier.
    """
    rows = requests.where(F.col("prefix").isNotNull() & F.col("request").isNotNull()).distinct().withColumn("block", F.floor(F.col("request") / block))
    sizes = rows.groupBy("prefix", "block").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("prefix").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    greatest = used(*sources).groupBy("prefix").agg(F.max("number").alias("greatest"))
    offsets = sizes.select("prefix", "block", earlier.alias("earlier")).join(greatest, "prefix", "left")
    place = F.row_number().over(Window.partitionBy("prefix", "block").orderBy("request"))
    numbered = rows.withColumn("place", place).join(offsets, ["prefix", "block"])
    return numbered.select("prefix", "request", identifier(F.col("prefix"), F.coalesce("greatest", F.lit(0)) + F.col("earlier") + F.col("place")).alias("ident"))


def identifier(prefix: Column, number: Column) -> Column:
    """Prefix and number, padded to three digits."""
    digits = number.cast("string")
    return F.concat(prefix, F.lit("-"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def next_ids(*sources: DataFrame) -> DataFrame:
    """(prefix, next_id, greatest): the next free identifier."""
    rows = used(*sources).groupBy("prefix").agg(F.max("number").alias("greatest"))
    return rows.select("prefix", identifier(F.col("prefix"), F.col("greatest") + 1).alias("next_id"), "greatest")


def summary(line: Column) -> Column:
    """Without emphasis marks and leading signs, cut at the last space within LONGEST - 1 characters (else there), with an ellipsis."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), SIGNS, ""))
    head = F.substring(clean, 1, LONGEST - 1)
    word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(clean) <= LONGEST, clean).otherwise(F.concat(F.when(word != "", word).otherwise(head), F.lit("…")))


def digests(found: DataFrame) -> DataFrame:
    """(ident, n_lines, n_docs, first_doc, summary): summary is from the first line, by document and line number."""
    first = F.min(F.struct("doc_id", "line_no", "line"))
    rows = found.groupBy("ident").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"), first.alias("x"))
    return rows.select("ident", "n_lines", "n_docs", F.col("x.doc_id").alias("first_doc"), summary(F.col("x.line")).alias("summary"))


def redacted(text: Column) -> Column:
    """Values of `key=` parameters masked: the last four characters stay of those longer than four."""
    longer = F.regexp_replace(text, r"([?&]key=)(?!<redacted)[^&\s'\"]+([^&\s'\"]{4})(?=[&\s'\"]|$)", "$1<redacted...$2>")
    return F.regexp_replace(longer, r"([?&]key=)(?!<redacted)[^&\s'\"]+", "$1<redacted>")


def shortened(text: Column, most: int) -> Column:
    """At most `most` characters, the last of them an ellipsis, without a space before it, where something was cut off."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def escaped(text: Column) -> Column:
    """Safe inside HTML."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

"""Line- and path-level measures of chunks: tables, patterns, positions, slugs, symbols and syntax-tree chunks."""

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.times import instant, utc
from tallyloom.operators.corpus import LINE_END

CODE_TOKENS = 400


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), from 1."""
    rows = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, LINE_END)).alias("at", "line"))
    return rows.select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def pipe_rows(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, n_cells, longest): rows of pipe tables without their separators; the first of equally long cells counts."""
    rows = lines(texts, key, text).where(F.col("line").rlike(r"^ *\|.*\| *$") & ~F.col("line").rlike(r"^[ |:-]+$"))
    inner = F.regexp_replace("line", r"^ *\||\| *$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))
    ranked = F.transform("cells", lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("cell")))
    return rows.select(key, "line_no", cells.alias("cells")).select(key, "line_no", F.size("cells").cast("long").alias("n_cells"), F.array_max(ranked)["cell"].alias("longest"))


def matching_lines(texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n): lines, not occurrences, that match; texts without any are left out. Counted inside each text's own array."""
    n = F.size(F.filter(F.split(text, LINE_END), lambda line: line.rlike(pattern)))
    return texts.where(F.col(text).rlike(pattern)).select(key, n.cast("long").alias("n"))


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` stands in `text` without overlap; null if either is null or `part` empty."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("long"))


def once(text: Column, part: Column) -> Column:
    """once, many, missing, or empty where there is nothing to look for."""
    n = occurrences(text, part)
    return F.when(n.isNull(), "empty").when(n == 0, "missing").when(n == 1, "once").otherwise("many")


def worth_keeping(chunk: Column, heading: Column) -> Column:
    """Not blank, not only its heading, and with a letter or digit."""
    bare = F.trim(F.regexp_replace(chunk, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    return F.coalesce((bare != "") & ~bare.eqNullSafe(F.trim(heading)) & chunk.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def slug(text: Column, size: int = 20) -> Column:
    """ASCII letters and digits in lower case, everything else one dash; at most `size`, `note` if nothing is left."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, size), r"-+$", "")
    return F.when(cut == "", "note").otherwise(cut)


def collection_of(path: Column) -> Column:
    """The collection a path belongs to, by its name: skills, rules, code or sessions."""
    return F.when(path.contains("skills"), "skills").when(path.contains("rules") | path.endswith(".mdc"), "rules").when(path.rlike(r"\.(py|js|ts|go|rs)$"), "code").otherwise("sessions")


def positions(chunks: DataFrame) -> DataFrame:
    """(id, position, n): a chunk's place among the chunks of its file, by id; a file is what bounds a window."""
    file = Window.partitionBy("repo", "path")
    return chunks.select("id", F.row_number().over(file.orderBy("id")).cast("long").alias("position"), F.count("*").over(file).alias("n"))


def file_symbols(chunks: DataFrame) -> DataFrame:
    """(repo, path, symbols): the distinct symbols of a file in order of appearance, with commas."""
    first = chunks.where(F.col("symbol").isNotNull()).groupBy("repo", "path", "symbol").agg(F.min(F.struct(F.coalesce("start_line", F.lit(0)).alias("line"), "id")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    return first.groupBy("repo", "path").agg(F.array_join(F.transform(ordered, lambda x: x["symbol"]), ", ").alias("symbols"))


PYTHON_DEFINITION = r"(?m)^(?:async +def|def|class) +(\w+)"
SHELL_DEFINITION = r"(?m)^(?:function +)?(\w[\w.-]*) *\(\)"


def top_definitions(chunks: DataFrame) -> DataFrame:
    """(id, name): functions and classes that a chunk defines at the start of a line, in Python or shell."""
    of = lambda p: F.regexp_extract_all("chunk", F.lit(p), F.lit(1))
    names = F.when(F.col("lang") == "python", of(PYTHON_DEFINITION)).otherwise(of(SHELL_DEFINITION))
    return chunks.where(F.col("chunk").isNotNull()).select("id", F.explode(F.array_distinct(names)).alias("name"))


def run_totals(lines_: DataFrame) -> DataFrame:
    """(run_id, calls, cost_usd) of JSON ledger lines (line) that name a run, each line once."""
    run = F.get_json_object("line", "$.run_id")
    rows = lines_.where(F.col("line").isNotNull()).distinct().select(run.alias("run_id"), F.get_json_object("line", "$.cost_usd").cast("decimal(12,6)").alias("cost"))
    return rows.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost_usd"))


def live_sessions(usage: DataFrame, as_of: str, ttl_s: int = 86_400) -> DataFrame:
    """(session_id, calls, last_ts): sessions whose last call before `as_of` is at most `ttl_s` seconds old."""
    now = instant(as_of)
    rows = usage.where(F.col("session_id").isNotNull() & (F.col("ts") <= now)).groupBy("session_id").agg(F.countDistinct("event_id").alias("calls"), F.max("ts").alias("last"))
    live = rows.where(F.unix_micros(now) - F.unix_micros("last") <= ttl_s * 1_000_000)
    return live.select("session_id", "calls", F.date_format(utc("last"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


def definitions(source: str | None, max_tokens: int = CODE_TOKENS) -> list[tuple[str, str | None, int, int, str]]:
    """(symbol, parent, start_line, end_line, text) of every function and class, nested ones with their parents' names.

    A definition of more than `max_tokens` (a third of its characters) is cut between statements of its body; each part
    starts with the definition's first line. A source that can't be parsed has none.
    """
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows = (source or "").splitlines()
    found: list[tuple[str, str | None, int, int, str]] = []

    def text_of(first: int, last: int) -> str:
        return "\n".join(rows[first - 1 : last])

    def keep(node, symbol: str, parent: str | None) -> None:
        whole = text_of(node.lineno, node.end_lineno)
        if len(whole) // 3 <= max_tokens:
            found.append((symbol, parent, node.lineno, node.end_lineno, whole))
            return
        head = rows[node.lineno - 1]
        first, last = node.body[0].lineno, 0
        for statement in node.body:
            if last and (len(head) + 1 + len(text_of(first, statement.end_lineno))) // 3 > max_tokens:
                found.append((symbol, parent, first, last, f"{head}\n{text_of(first, last)}"))
                first = statement.lineno
            last = statement.end_lineno
        found.append((symbol, parent, first, last, f"{head}\n{text_of(first, last)}"))

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                symbol = f"{parent}.{child.name}" if parent else child.name
                keep(child, symbol, parent)
                visit(child, symbol)
            else:
                visit(child, parent)

    visit(tree, None)
    return found


def code_definitions(chunks: DataFrame, max_tokens: int = CODE_TOKENS) -> DataFrame:
    """(id, part, symbol, parent_symbol, start_line, end_line, text) of the Python chunks, lines counted within the chunk."""
    columns = ["id", "part", "symbol", "parent_symbol", "start_line", "end_line", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, n, *d) for i, s in zip(b["id"], b["chunk"]) for n, d in enumerate(definitions(s, max_tokens), 1)], columns=columns)

    python = chunks.where((F.col("lang") == "python") & F.col("chunk").isNotNull()).select("id", "chunk")
    return python.mapInPandas(run, "id long, part int, symbol string, parent_symbol string, start_line int, end_line int, text string")


def uncalled(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, symbol): defining chunks that no resolved edge points to."""
    called = edges.where(F.col("resolved_id").isNotNull()).select(F.col("resolved_id").alias("id"))
    return chunks.where(F.col("symbol").isNotNull()).select("id", "symbol").join(called, "id", "left_anti")


def kinds(documents: DataFrame) -> DataFrame:
    """(kind, lang, documents, chars): with subtotals per kind and a total, marked by (all)."""
    name = lambda c: F.lower(F.coalesce(c, F.lit("(none)"))).alias(c)
    rows = documents.select(name("kind"), name("lang"), F.length("text").alias("n"))
    grouped = rows.rollup("kind", "lang").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chars"), F.grouping("kind").alias("k"), F.grouping("lang").alias("l"))
    shown = lambda c, g: F.when(F.col(g) == 1, "(all)").otherwise(F.col(c)).alias(c)
    return grouped.select(shown("kind", "k"), shown("lang", "l"), "documents", "chars")

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators import texts


def test_definitions():
    source = "class A:\n    x = 1\n    def method_1(self):\n        pass\n\ndef func_outer():\n    def func_inner():\n        pass\n    return 1\n"
    got = [(s, p, a, b) for s, p, a, b, _ in texts.definitions(source)]
    assert got == [("A", None, 1, 4), ("A.method_1", "A", 3, 4), ("func_outer", None, 6, 9), ("func_outer.func_inner", "func_outer", 7, 8)]
    long = "def f(a):\n" + "".join(f"    value_{i} = a + {i}\n" for i in range(150))
    parts = texts.definitions(long)
    assert len(parts) > 1 and all(t.startswith("def f(a):\n") and len(t) // 3 <= 400 for *_, t in parts)
    assert parts[0][2] == 2 and parts[-1][3] == 151
    assert texts.definitions("def (") == [] and texts.definitions(None) == [] and texts.definitions("") == []


def test_lines_and_patterns(spark):
    df = spark.createDataFrame([(1, "| a | bb |\n|---|---|\n| ccc | dd |\nx | y\n||"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 as line", "2 as cells", "3 as n")
    assert sorted((r.line_no, r.n_cells, r.longest) for r in texts.pipe_rows(df).collect()) == [(1, 2, "bb"), (3, 2, "ccc")]
    assert [(r.doc_id, r.n) for r in texts.matching_lines(df, "a|y").collect()] == [(1, 2)]
    assert texts.pipe_rows(df.limit(0)).count() == 0


def test_once_slug_and_keep(spark):
    df = spark.createDataFrame([("# A b", "# A b\ntext # A b"), ("# A", "# A"), ("", "x"), (None, None), ("# C", "---"), ("é", "né")], "h string, c string")
    assert [r[0] for r in df.select(texts.once(df.c, df.h)).collect()] == ["many", "once", "empty", "empty", "missing", "once"]
    assert [r[0] for r in df.select(texts.worth_keeping(df.c, df.h)).collect()] == [True, False, True, False, False, True]
    assert [r[0] for r in df.select(texts.slug(df.h)).collect()] == ["a-b", "a", "note", "note", "c", "note"]
    assert spark.createDataFrame([("x" * 19 + " y z",)], "h string").select(texts.slug(F.col("h"))).first()[0] == "x" * 19


def test_live_sessions_bound_is_inclusive(spark):
    now = datetime(2026, 1, 2)
    rows = [("a", "s", now - timedelta(days=1)), ("a", "s", now - timedelta(days=1)), ("b", "t", now - timedelta(days=1, microseconds=1)), ("c", None, now), ("d", "u", None), ("e", "v", now + timedelta(1))]
    df = spark.createDataFrame(rows, "event_id string, session_id string, ts timestamp")
    assert [(r.session_id, r.calls) for r in texts.live_sessions(df, "2026-01-02 00:00:00").collect()] == [("s", 1)]


def test_runs_kinds_positions_and_symbols(spark):
    lines = spark.createDataFrame([('{"run_id": "r", "cost_usd": 0.5}',), ('{"run_id": "r", "cost_usd": 0.5}',), ('{"run_id": "r"}',), ("{bad",), (None,)], "line string")
    assert [tuple(r) for r in texts.run_totals(lines).collect()] == [("r", 2, 0.5)]
    docs = spark.createDataFrame([("a", "EN", "xx"), ("a", None, None), (None, "en", "")], "kind string, lang string, text string")
    got = {(r.kind, r.lang): (r.documents, r.chars) for r in texts.kinds(docs).collect()}
    assert got[("(all)", "(all)")] == (3, 2) and got[("a", "(all)")] == (2, 2) and got[("a", "en")] == (1, 2)
    chunks = spark.createDataFrame([(2, "r", "p", "g", 5), (1, "r", "p", "f", 9), (3, "r", "p", "g", 20), (4, "r", "q", None, None)], "id long, repo string, path string, symbol string, start_line int")
    assert [(r.path, r.symbols) for r in texts.file_symbols(chunks).collect()] == [("p", "g, f")]
    assert {(r.id, r.position, r.n) for r in texts.positions(chunks).collect()} == {(1, 1, 3), (2, 2, 3), (3, 3, 3), (4, 1, 1)}
    edges = spark.createDataFrame([(1, "g", 2), (2, "x", None)], "caller_id long, callee_symbol string, resolved_id long")
    assert {r.id for r in texts.uncalled(chunks, edges).collect()} == {1, 3}

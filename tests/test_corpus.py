from tallyloom.operators import corpus, registry, retrieval

CHUNK = "id long, repo string, path string, chunk_sha string, repo_commit string, chunk string"


def test_markdown_chunks():
    long = "word " * 200
    assert [(h, s) for h, s, _ in corpus.markdown_chunks("# Heading 1\ntext\n\nmore\n# Heading 2\ntext")] == [("# Heading 1", 1), ("# Heading 2", 5)]
    assert [(h, s, t) for h, s, t in corpus.markdown_chunks(f"# A\n{long}\n\nnext", 100)][1] == ("# A", 3, "next")
    assert corpus.markdown_chunks("# A\n## B\nx") == [("## B", 2, "## B\nx")]
    assert corpus.markdown_chunks("```\n# c\n```\nx")[0][0] == ""
    assert corpus.markdown_chunks("---") == [] and corpus.markdown_chunks("") == [] and corpus.markdown_chunks(None) == []
    assert corpus.markdown_chunks("می‌شود")[0][2] == "می‌شود"


def test_manifest_and_upsert(spark):
    a = spark.createDataFrame([(1, "r", "p", "x", "c", "t"), (2, "r", "p", "y", None, None), (3, "r", "q", "x", "c", "t")], CHUNK)
    b = spark.createDataFrame([(5, "r", "p", "x", "c", "t"), (6, "r", "p", "x", "c", "t"), (7, "r", "n", "z", "unknown", "t"), (8, None, None, None, None, None)], CHUNK)
    status = {(r.path, r.status) for r in corpus.manifest_diff(corpus.manifest(a), corpus.manifest(b)).collect()}
    assert status == {("p", "changed"), ("q", "removed"), ("n", "added")}
    again = corpus.manifest_diff(corpus.manifest(a), corpus.manifest(a)).collect()
    assert {r.status for r in again} == {"same"}
    got = {(r.path, r.chunk_sha): (r.id, r.is_new) for r in corpus.upsert(a, b.where("path is not null")).collect()}
    assert got == {("p", "x"): (1, False), ("n", "z"): (7, True)}
    assert {(r.id, r.reason) for r in corpus.stale(a, b).collect()} == {(2, "chunk_gone"), (3, "path_gone")}
    assert corpus.stale(a, a).count() == 0 and corpus.upsert(a, a.limit(0)).count() == 0
    assert {r.first_id for r in corpus.receipts(a).collect()} == {1, 3}


def test_session_dates(spark):
    rows = [("## 2026-07-21 x", "", "f"), ("# 2026-07", "date: 2026-01-01", "f"), ("", "Date: '2026-02-03'", "2026-09-09.md"), (None, None, "a/20260405-x.md"), ("", "", "n-2026-05.md"), ("", "", "n.md"), (None, None, None)]
    df = spark.createDataFrame(rows, "heading string, chunk string, path string")
    got = [r[0] for r in df.select(corpus.session_date(df.heading, df.chunk, df.path)).collect()]
    assert got == ["2026-07-21", "2026-07", "2026-02-03", "2026-04-05", "2026-05", None, None]


def test_joiner_losses_and_measures(spark):
    z = "\u200c"
    before = spark.createDataFrame([("r", "p", f"a{z}b{z}"), ("r", "q", f"{z}"), ("r", "gone", z)], "repo string, path string, chunk string")
    after = spark.createDataFrame([("r", "p", "ab"), ("r", "q", f"{z}"), ("r", "new", "x")], "repo string, path string, chunk string")
    assert [(r.path, r.joiners_before, r.joiners_after) for r in corpus.joiner_losses(before, after).collect()] == [("p", 2, 0)]
    m = corpus.measures(spark.createDataFrame([(1, f"a b\r\nc{z}"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r.chars, r.lines, r.words, r.joiners) for r in m] == [(7, 2, 3, 1), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_registry(spark):
    df = spark.createDataFrame([(1, "- T-1 one D-003\nT-1 again T-5"), (2, "N-12 **x**"), (3, None), (4, "XT-1 D-")], "doc_id long, text string")
    m = registry.mentions(df)
    assert m.count() == 5
    assert {(r.prefix, r.first, r.last, r.n) for r in registry.gaps(m).collect()} == {("T", 2, 4, 3), ("D", 1, 2, 2), ("N", 1, 11, 11)}
    assert {(r.prefix, r.gaps, r.more) for r in registry.gap_report(m, most=2).collect()} == {("T", "2, 3", 1), ("D", "1, 2", 0), ("N", "1, 2", 9)}
    assert {r.next_id for r in registry.next_ids(m).collect()} == {"T-006", "D-004", "N-013"}
    long = spark.createDataFrame([("word " * 30,), ("x" * 100,), ("`short`",)], "t string")
    cut = [r[0] for r in long.select(registry.summary(long.t)).collect()]
    assert all(len(x) <= 80 for x in cut) and cut[0].endswith("word…") and cut[2] == "short"
    urls = spark.createDataFrame([("u?key=abcdefgh&x=1 ?key=abc",)], "t string")
    assert urls.select(registry.redacted(urls.t)).first()[0] == "u?key=<redacted...efgh>&x=1 ?key=<redacted>"


def test_registry_of_large_numbers_and_ledgers(spark):
    df = spark.createDataFrame([(1, "D-99999999999999999999 and D-20260615123000 and D-2"), (2, "D-0")], "doc_id long, text string")
    m = registry.mentions(df)
    assert m.count() == 4 and m.where("number is null").count() == 1
    assert {(r.first, r.last) for r in registry.gaps(m).collect()} == {(1, 1), (3, 20260615122999)}
    assert [r.more for r in registry.gap_report(m).collect()] == [20260615122999 - 3 + 1 + 1 - 10]
    assert [r.next_id for r in registry.next_ids(m).collect()] == ["D-20260615123001"]
    ledger = registry.ledger_rows(spark.createDataFrame([("D-1\tt\tme\twhy",), ("D-7",), ("x D-3\t",), ("",), (None,)], "line string"))
    assert {(r.ident, r.who) for r in ledger.collect()} == {("D-1", "me"), ("D-7", None)}
    assert {(r.first, r.last) for r in registry.gaps(ledger, m.where("number < 5")).collect()} == {(3, 6)}
    assert {r.ident for r in registry.unrecorded(m, ledger).collect()} == {"D-99999999999999999999", "D-20260615123000", "D-2", "D-0"}
    requests = spark.createDataFrame([("D", 5), ("D", 1), ("D", 250_000), ("T", 9), ("D", 5), (None, 1), ("T", None)], "prefix string, request long")
    got = {(r.prefix, r.request): r.ident for r in registry.allocated(requests, ledger).collect()}
    assert got == {("D", 1): "D-008", ("D", 5): "D-009", ("D", 250_000): "D-010", ("T", 9): "T-001"}
    assert registry.gaps(m.limit(0)).count() == 0 and registry.allocated(requests.limit(0), m).count() == 0


def test_index_upkeep(spark):
    a = spark.createDataFrame([(1, "r", "p", "x", "c1", "t"), (2, "r", "p", "y", None, "u"), (3, "s", "q", "x", "c2", None), (4, None, None, None, None, "v")], CHUNK)
    b = spark.createDataFrame([(9, "r", "p", "x", "c3", "t"), (8, "r", "n", "z", "c3", "t")], CHUNK)
    assert {(r.id, r.repo_commit) for r in corpus.restamped(a, b).collect()} == {(1, "c3"), (2, None), (3, "c2"), (4, None)}
    assert {(r.repo, r.head) for r in corpus.heads(a).collect()} == {("r", "c1"), ("s", "c2")}
    assert {(r.id, r.repo_commit) for r in corpus.stamped(a, corpus.heads(a)).collect()} == {(1, "c1"), (2, "c1"), (3, "c2"), (4, None)}
    assert {(r.repo, r.chunks, r.behind) for r in corpus.behind(a, corpus.heads(a)).collect()} == {("r", 2, 1), ("s", 1, 0)}
    assert {tuple(r) for r in corpus.ingest_stats(a.where("repo is not null"), b).collect()} == {("r", 2, 1, 1, 1), ("s", 0, 0, 0, 1)}
    up = corpus.manifest_upsert(corpus.manifest(a), corpus.manifest(b))
    assert {(r.path, r.content_hash) for r in up.collect()} == {(r.path, r.content_hash) for r in corpus.manifest(b).unionByName(corpus.manifest(a.where("path = 'q'"))).collect()}
    assert [(r.path, r.id) for r in corpus.first_per_key(a, "path", ["id"]).orderBy("id").collect()] == [("p", 1), ("q", 3)]
    files = spark.createDataFrame([(p,) for p in ("x/docs/a/b.md", "docs/fa/b.md", "docs/b.fa.md", ".agent/constitution/skills/s.md", "p/_memory/sessions/x/y.md", "p/workspace/archive-1/n.txt", "lib/a.py", None)], "path string")
    got = {(r.collection, r.path) for r in corpus.discovered(files).collect()}
    assert got == {("rules", "x/docs/a/b.md"), ("skills", ".agent/constitution/skills/s.md"), ("sessions", "p/_memory/sessions/x/y.md"), ("sessions", "p/workspace/archive-1/n.txt"), ("code", "lib/a.py")}


def test_retrieval(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").selectExpr("*", "repeat('x', 10) as chunk")
    asked = spark.createDataFrame([(50, [1.0, 0.0]), (60, [0.0, 1.0]), (70, None)], "id long, embedding array<float>")
    for block in (1, 100):
        got = {(r.query_id, r.id): r.similarity for r in retrieval.top_k(df, asked, 2, 2, block).collect()}
        assert got == {(50, 1): 1.0, (50, 2): 1.0, (60, 3): 1.0, (60, 1): 0.0}
    hits = retrieval.top_k(df, asked.where("id = 50"), 3, 2)
    assert {r.id for r in retrieval.within_budget(hits, df.selectExpr("id", "length(chunk) as size"), 25).collect()} == {1, 2}
    assert retrieval.top_k(df.limit(0), asked, 2, 2).count() == 0 and retrieval.top_k(df, asked.limit(0), 2, 2).count() == 0
    pooled = retrieval.mean_pooled(df.selectExpr("if(id < 4, 'a', null) as key", "embedding"), 2).collect()
    assert [(r.key, r.n, list(r.embedding)) for r in pooled] == [("a", 3, [0.707107, 0.707107])]


def test_calls_and_graph(spark, monkeypatch):
    code = "class A:\n    def m(self):\n        f()\n        self.g()\n\ndef f():\n    def inner():\n        h()\n    inner()\nf()\n"
    assert retrieval.python_calls(code) == {("A.m", "f"), ("A.m", "g"), ("inner", "h"), ("f", "inner")}
    assert retrieval.python_calls("def (") == set() and retrieval.python_calls(None) == set()
    rows = [(1, "r", "f", "def f(): g()"), (2, "r", "A.g", "def g(): h()"), (3, "r", "g", "def g(): pass"), (4, "s", "k", "k(); g()"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, repo string, symbol string, chunk string")
    edges = retrieval.resolved(retrieval.call_sites(df), df)
    assert {tuple(r) for r in edges.collect()} == {(1, "g", 2), (2, "h", None), (4, "g", None)}
    hits = df.where("id = 2").selectExpr("7 as query_id", "id")
    assert {tuple(r) for r in retrieval.expand(hits, edges).collect()} == {(7, 2, "hit"), (7, 1, "caller")}
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in retrieval.resolved(retrieval.call_sites(df), df).collect()} == {(1, "g", 2), (2, "h", None), (4, "g", None)}
    new = edges.where("caller_id = 1").selectExpr("caller_id", "'z' as callee_symbol", "resolved_id")
    assert {(r.caller_id, r.callee_symbol) for r in retrieval.replaced(edges, new.union(new)).collect()} == {(1, "z"), (2, "h"), (4, "g")}


def test_sections(spark):
    df = spark.createDataFrame([(1, "a\n# H\nb\n```\n# no\n```\nc"), (2, None), (3, "")], "id long, chunk string")
    got = {(r.id, r.line_no): r.heading for r in corpus.sections(df).collect()}
    assert got == {(1, 1): None, (1, 2): "# H", (1, 3): "# H", (1, 7): "# H", (3, 1): None}

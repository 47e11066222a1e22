from tallyloom.llm import residue

CONTENT = "We moved the price table out of the old job because it was read far too often in every run."
CASES = {
    1: (f"Dear {{{{name}}}}, the total is due.\n\n{CONTENT}", "placeholder"),
    2: ("# {{name}}\nAll is well in this report and nothing has to be changed before the next run.", "placeholder"),
    3: (f"The template has `{{{{name}}}}` in it.\n\n{CONTENT}", None),
    4: (f"```\nDear {{{{name}}}}\n```\n{CONTENT}", None),
    5: (f'It began with "Dear {{{{name}}}}" in spring.\n{CONTENT}', None),
    6: (f"Dear <name>, all is well.\n{CONTENT}", "placeholder"),
    7: (f"<b>bold</b> and [link](x) and [other](y) [citation] $5 and $6.\n{CONTENT}", None),
    8: ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "filler"),
    9: (f"We replaced the lorem ipsum in the demo page.\n{CONTENT}", None),
    10: ("Menu\nSearch\n\n# 404 Not Found\n\nNo route matches this address.\n© 2026 Firm", "error"),
    11: (f'Callers saw "502 Bad Gateway" for an hour until the proxy was restarted.\n{CONTENT}', None),
    12: ("Please enable JavaScript to view this page.", "script"),
    13: ("JavaScript is disabled.\nasdf asdf asdfasdf asdf", "mixed"),
    14: (CONTENT, None),
    15: (None, None),
    16: ("", None),
    17: (" \n​", None),
    18: ('{"error": {"code": 429, "message": "too many requests"}}', "error"),
    19: ("Menu\nSearch\nAbout", None),
    20: ("Sample copy goes here.\nSample copy goes here.", "filler"),
    21: ("Zugriff verweigert", "error"),
    23: ("# Notes on the long retry loop of spring\n\nLorem ipsum dolor sit amet consectetur.", "filler"),
    24: ("# Notes on the long retry loop of spring\n\nWe moved it.", None),
    25: (f"Dear [Your Name], all is well.\n{CONTENT}", "placeholder"),
    26: ("# Notes on the long retry loop of spring", None),
    22: ("```\n404 Not Found\n```", None),
}


def test_cases(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id long, text string").selectExpr("*", "'x' as kind", "'y' as leaf", "1 as message", "2 as name")
    got = {r.doc_id: r.kind for r in residue.not_content(df).collect()}
    assert got == {k: kind for k, (_, kind) in CASES.items() if kind}


def test_repeats_long_texts_and_empty(spark):
    rows = [(1, "404 Not Found"), (1, "404 Not Found"), (2, (CONTENT + "\n") * 5000), (3, "lorem ipsum dolor " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.kind) for r in residue.not_content(df).collect()) == [(1, "error"), (3, "filler")]
    assert residue.not_content(df.limit(0)).count() == 0


def test_divided_leaves_are_judged_one_by_one(spark):
    rows = [(1, "you really should now enable javascript"), (2, "you really should now feed goldfish"), (3, "you really should now visit grandmother")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.kind) for r in residue.not_content(df).collect()] == [(1, "script")]


def test_messages_between_the_ends_of_a_leaf_are_judged(spark):
    rows = [(1, "you really should now adopt cats"), (2, "you really should now enable javascript"), (3, "you really should now feed goldfish")]
    rows += [(4, "error 500 in the alpha"), (5, "error 500 in the server"), (6, "error 500 in the zeta")]
    rows += [(7, "the old page was not found"), (8, "the old page was opened again"), (9, "the old page was read. the old page was timed out")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kind for r in residue.not_content(df).collect()}
    assert got == {2: "script", 4: "error", 5: "error", 6: "error", 7: "error"}


def test_templates_keep_what_all_messages_have(spark):
    said = spark.createDataFrame([(i, f"the page of our {x} was {y}", False) for i, (x, y) in enumerate([("alpha", "read"), ("beta", "not found"), ("zeta", "read")])], "doc_id long, message string, heading boolean")
    judged = residue.judgements(said.withColumn("leaf", residue.leaf(said.message)))
    assert {(r.template, r.kind, r.n_messages) for r in residue.templates(judged).collect()} == {("the page of our <*> was read", "content", 2), ("the page of our beta was not found", "error", 1)}
    news = [(4, "our new service is a not found"), (5, "our new service is zone not found"), (6, "our new service is better for harbours")]
    got = residue.not_content(spark.createDataFrame(news, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(4, "error"), (5, "error")}


def test_long_messages_need_a_cue_for_every_thirty_words(spark):
    page = "<html><head><title>404 Not Found</title></head><body class='a b'>" + " the page you requested was not found and we could not load it so please try again later" * 6 + "</body></html>"
    detail = '{"error": {"code": 503, "detail": "' + "the service is unavailable since the server did not respond within the time that was set " * 3 + '"}}'
    report = "we read in the notes of spring that the job had timed out once, " + "and then we wrote down what each of the tables held before it ran again " * 6
    df = spark.createDataFrame([(1, page), (2, detail), (3, report), (4, "Dear {{" + "the whole name of the person " * 4 + "}}, all is well."), (5, f'They wrote "{"404 not found " * 30}" on it.\n{CONTENT}')], "doc_id long, text string")
    assert {(r.doc_id, r.kind) for r in residue.not_content(df).collect()} == {(1, "error"), (2, "error"), (4, "placeholder")}

import random

from tallyloom.llm import pairs

SCHEMA = "key string, prompt string, response string"
WHY = "Why does the nightly job of the small team fail when the price table is empty?"
CASES = {
    # empty
    "e1": (WHY, None, "empty"), "e2": (WHY, "", "empty"), "e3": (WHY, " ​\n", "empty"), "e4": (WHY, "<p></p>", "empty"), "e5": (WHY, "N/A.", "empty"), "e6": (WHY, "```\n```", "empty"), "e7": (None, "{}", "empty"),
    # copies
    "c1": (WHY, WHY, "copied"), "c2": (WHY, f"> {WHY.upper()}", "copied"), "c3": (WHY, WHY.replace("?", " ..."), "copied"), "c4": (WHY, f"Question: {WHY}", "copied"), "c5": (WHY, f"{WHY}\n{WHY}", "copied"),
    "c6": (f"Repeat this line exactly as it is: {WHY}", WHY, None), "c7": (WHY, f"> {WHY}\n\nThe job reads the table before it is there and then gives up at once.", None),
    # refusals
    "r1": (WHY, "I'm sorry, but I can't help with that. Please contact the team that owns it.", "refusal"), "r2": (WHY, "**DAZU MÖCHTE ICH MICH NICHT ÄUSSERN.**", "refusal"), "r3": (WHY, "Je préfère ne pas traiter ce sujet.", "refusal"),
    "r4": (WHY, "I can't reproduce the error with this model, so look at the input first. The job reads an empty table.", None), "r5": (WHY, "I'm sorry, but I can't help with that. The job reads the table before it is there.", None),
    "r6": (None, "I must decline to work on the price table.", "refusal"),
    "r7": (WHY, "I'm sorry, but I can't help with the price table of the small team and with all that was written about it in the long report on the nightly job and its many failures of the past spring and summer.", "refusal"),
    "c8": (WHY, " ".join(w for i, w in enumerate(WHY.split(), 1) if i % 5), "copied"), "c11": (WHY, " ".join(w for i, w in enumerate(WHY.split()) if i % 5 not in (2, 4)), "copied"), "c12": ("Restart the harbour?", "the harbour", "copied"), "c9": ("Harbour?", "harbour", "copied"), "c10": ("Which town? Answer in one word.", "Harbour", None),
    # language
    "l5": (WHY, "Il processo notturno legge la tabella dei prezzi prima che sia pronta e quindi si ferma subito senza scrivere nulla.", "wrong_language"),
    "l6": (WHY, "Het nachtelijke proces leest de prijstabel voordat deze klaar is en stopt dan meteen zonder iets te schrijven.", "wrong_language"),
    "l7": (WHY, "En resumen, sí. Hubo 189 líneas rechazadas, casi todas cortadas en medio de un número.", "wrong_language"),
    "l8": (WHY, "`etl/run_job.py` uses `price_table` and `load_rows` via `run()`.", None),
    "l1": (WHY, "Der Lauf liest die Tabelle, bevor sie da ist, und wird dann nicht mehr gestartet.", "wrong_language"), "l2": ("Translate into German: " + WHY, "Der Lauf liest die Tabelle, bevor sie da ist, und wird dann nicht mehr gestartet.", None),
    "l3": (WHY, "```bash\ncd etl && ./run.sh\n```", None), "l4": (WHY, "اگر پرونده نباشد وضعیت کهنه شمرده می‌شود.", "wrong_language"),
    # truncation
    "t11": (WHY, "There are three steps.\n\n1. Stop the job.\n2. Fill the table.", "truncated"), "t12": (WHY, "There are three steps.\n\n1. Stop the job.\n2. Fill the table.\n3. Start the job.", None),
    "t13": (WHY.replace("Why", "Warum"), "The 4 main points:\n- Stop the job now.\n- Fill the table again.", "truncated"), "t14": (WHY, "The job ran three times.\n\n1. Stop the job.\n2. Fill the table.", None),
    "t1": (WHY, "The job reads the table before it is there. The next step is to", "truncated"), "t2": (WHY, "Like this:\n\n```python\nfor x in y:", "truncated"), "t3": (WHY, '[{"a": 1}, {"a": ', "truncated"),
    "t4": (WHY, "The steps are:\n1. Stop the job now.\n2. **`run`** –", "truncated"), "t5": (WHY, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | ", "truncated"), "t6": (WHY, "The job is late. The next [stream closed after 10 ms]", "truncated"),
    "t7": (WHY, "These are at fault.\n\n- the price table\n- the nightly job", None), "t8": (WHY, "It is in this file.\n\netl/run_job.py", None), "t9": (WHY + " Answer yes or no.", "Yes", None), "t10": (WHY, "| a | b |\n|---|---|\n| 1 | 2 |", None),
}


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def test_cases(spark):
    df = spark.createDataFrame([(k, p, r) for k, (p, r, _) in CASES.items()], SCHEMA)
    got = {r.cache_key: r.defect for r in pairs.defects(df, documents(spark)).collect()}
    assert got == {k: d for k, (_, _, d) in CASES.items() if d}


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(None, None, None), ("k", None, None), ("k", None, None), ("long", "p " * 50_000, "p " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as empty", "'x' as defect", "2 as copied")
    assert sorted((r.cache_key, r.defect) for r in pairs.defects(df, documents(spark)).collect()) == [("k", "empty"), ("long", "copied")]
    assert pairs.defects(df.limit(0), documents(spark).limit(0)).count() == 0


def test_common_length_against_brute_force():
    random.seed(3)
    for _ in range(300):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert pairs.common_length(a, b) == table[-1][-1]

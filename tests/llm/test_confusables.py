from tallyloom.llm import confusables as c

SAME = [
    ("Straße 12", "Straße 12"), ("Café", "Café"), ("abc", "ａｂｃ"), ("office fix", "oﬃce ﬁx"), ("scope", "ѕсоре"), ("a b", "a b"), ("word", "wo​rd"), ("word", "wo­rd"), ("a\nb", "a\r\nb"),
    ("a", "﻿a"), ("می‌شود", "می‌⁠شود"), ("ab", "a‌b"), ("A+B=1", "Ａ＋Ｂ＝１"), ("naïve", "naïve"),
]
DIFFERENT = [
    ("a", "A"), ("1", "¹"), ("1", "①"), ("e", "é"), ("می‌شود", "میشود"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("rn", "m"), ("0", "O"), ("a b", "a  b"), ("a b", "a\tb"), ("1", "l"),
]


def test_same():
    for a, b in SAME:
        assert c.skeleton(a) == c.skeleton(b), (a, b)


def test_different():
    for a, b in DIFFERENT:
        assert c.skeleton(a) != c.skeleton(b), (a, b)


def test_idempotent_and_null():
    assert c.skeleton(None) is None and c.skeleton("") == ""
    for pair in SAME + DIFFERENT:
        for text in pair:
            assert c.skeleton(c.skeleton(text)) == c.skeleton(text)


def test_pairs_and_classes(spark):
    rows = [(1, "abc"), (2, "ａbc"), (3, "abc"), (4, "x"), (5, None), (6, ""), (7, ""), (8, "ab​c"), (2, "ａbc")]
    df = spark.createDataFrame(rows, "id long, chunk string").selectExpr("*", "1 as look", "2 as form", "'t' as chunk_table")
    forms = c.forms(df, "t")
    assert {(r.id_a, r.id_b) for r in c.look_alike_pairs(forms).collect()} == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}
    got = {r.id: (r.class_id, r.n_forms) for r in c.look_classes(forms).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 8: (1, 3), 4: (4, 1), 6: (6, 1), 7: (6, 1)}
    assert c.look_alike_pairs(c.forms(df.limit(0), "t")).count() == 0


def test_tables_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, "ａ")], "id long, chunk string")
    both = c.forms(df.where("id = 1"), "s").unionByName(c.forms(df.where("id = 2"), "t"))
    assert c.look_alike_pairs(both).count() == 0

import random
from functools import lru_cache

import numpy as np

from tallyloom.llm import leakage as lk

VOCABULARY = [f"w{i}" for i in range(400)]


def runs(item, doc, least):
    windows = {tuple(item[i : i + least]) for i in range(len(item) - least + 1)}
    return any(tuple(doc[i : i + least]) in windows for i in range(len(doc) - least + 1))


def test_against_brute_force(spark):
    random.seed(5)
    items = [(i, [random.choice(VOCABULARY) for _ in range(random.randint(15, 60))]) for i in range(30)]
    items += [(100 + i, items[0][1][:25] + [f"y{i}"] * 3) for i in range(3)]  # shared passages
    docs = []
    for d in range(120):
        words = [random.choice(VOCABULARY) for _ in range(random.randint(0, 200))]
        for _ in range(random.randint(0, 2)):
            w = random.choice(items)[1]
            a = random.randint(0, len(w) - 1)
            at = random.randint(0, len(words))
            words[at:at] = w[a : a + random.randint(17, 40)]
        docs.append((d, words))
    layout = lambda ws: "".join(f"{w.upper() if random.random() < 0.3 else w}{random.choice([' ', '\n> ', ', ', ' **', ' '])}" for w in ws)
    dd = spark.createDataFrame([(d, layout(w)) for d, w in docs] + [(900, None), (901, ""), (902, "—")], "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as region")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(800, None), (801, "too short")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = {(d, i) for d, w in docs for i, x in items if runs(x, w, 20)}
    assert want
    for most in (lk.BROADCAST_GRAMS, 0):
        got = [(r.doc_id, r.item_id) for r in lk.leaked_passages(dd, ii, broadcast_grams=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def best_alignment(item, text, edits):
    """Words in common of the best alignment of parts of both, without bands."""

    @lru_cache(None)
    def after(i, j, e):
        if e < 0:
            return -(10**6)
        best = 0
        if i < len(item) and j < len(text) and item[i] == text[j]:
            best = 1 + after(i + 1, j + 1, e)
        if e and (i < len(item) or j < len(text)):
            best = max(best, after(min(i + 1, len(item)), min(j + 1, len(text)), e - 1), after(min(i + 1, len(item)), j, e - 1), after(i, min(j + 1, len(text)), e - 1))
        return best

    return max((after(i, j, edits) for i in range(len(item)) for j in range(len(text)) if item[i] == text[j]), default=0)


def test_edits_against_brute_force(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abc") for _ in range(random.choice([1, 1, 2, 3, 5, 60])))
    items = [(i, [word() for _ in range(random.randint(18, 40))]) for i in range(12)]
    docs = []
    for d in range(40):
        w = list(random.choice(items)[1])
        a = random.randint(0, 5)
        w = w[a : a + random.randint(18, 26)]
        for _ in range(random.randint(0, 4)):
            at = random.randrange(len(w))
            w[at : at + 1] = random.choice([[], [word()], [w[at], word()]])
        docs.append((d, [word() for _ in range(random.randint(0, 12))] + w + [word() for _ in range(random.randint(0, 12))]))
    dd = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for edits in (0, 1, 2):
        every = {(d, i): best_alignment(tuple(x), tuple(w), edits) for d, w in docs for i, x in items}
        want = {k: n for k, n in every.items() if n >= 20}
        assert want
        for most in (lk.BROADCAST_GRAMS, 0):
            assert {(r.doc_id, r.item_id): r.n_words for r in lk.leaked_passages(dd, ii, edits=edits, broadcast_grams=most).collect()} == want


def test_a_long_word_changed(spark):
    text = [f"w{i}" for i in range(10)] + ["x" * 100] + [f"v{i}" for i in range(11)]
    docs = spark.createDataFrame([(1, " ".join(text[:10] + ["other"] + text[11:]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(text)), (1, "another text under the same id")], "item_id long, text string")
    assert lk.leaked_passages(docs, items, edits=0).count() == 0
    assert [(r.doc_id, r.n_words) for r in lk.leaked_passages(docs, items, edits=1).collect()] == [(1, 21)]


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 50)], "item_id long, text string")
    assert lk.leaked_passages(docs, items.limit(0)).count() == 0 and lk.leaked_passages(docs.limit(0), items).count() == 0
    assert [(r.doc_id, r.item_id) for r in lk.leaked_passages(docs.union(docs), items.union(items)).collect()] == [(1, 1)]


def test_grams():
    s = lk.stream(["Ab, cd!", "", " É_ab\0cd "])
    assert s.words(0, 2) == ["ab", "cd"] and s.words(2, 5) == ["é", "ab", "cd"] and list(s.of) == [0, 0, 2, 2, 2]
    codes = lk.stream(["abcdefghijklmnopq" * 2]).codes
    for q in (1, 2, 4, 16):
        h = lk.grams(codes, np.arange(34), q)
        assert all((h[i] == h[i + 17]) == (i + 17 + q <= 34) for i in range(17))

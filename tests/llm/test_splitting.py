import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import splitting as sp


def hardest(text, limit):
    if all(len(x) <= limit for x in re.split(r"\r\n|\n|\r", text)):
        return "line"
    return "word" if all(len(x) <= limit for x in re.split(r"[ \t\r\n]+", text)) else "hard"


def check(text, limit, overlap):
    pieces = sp.cut_text(text, limit, overlap)
    assert all(0 < b - a <= limit and 0 <= o <= overlap and a + o < b for a, b, o, _ in pieces)
    assert "".join(text[a + o : b] for a, b, o, _ in pieces) == text
    assert all(o > 0 or b - a == limit for a, b, o, _ in pieces[1:] if overlap)
    if len(text) > limit:
        kinds = {k for *_, k in pieces}
        assert max(kinds, key=sp.KINDS.index) == hardest(text, limit)
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\n\ré漢🚀́", max_size=400), st.integers(41, 90), st.integers(0, 40))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_edges():
    for n in (1199, 1200, 1201, 2400, 2401, 5000):
        for text in ("a" * n, "a" * n + "\n" + "b" * 1200 + "\r\n" + "c" * 1200, " " * n, "\n" * n, "\r\n" * n, ("x" * 1200 + " ") * 3, ("x y\t" * n)[: n * 2]):
            check(text, 1200, 100)
    assert sp.cut_text("") == [] and sp.cut_text("short") == [(0, 5, 0, "line")]


def test_hard_cuts_repeat_the_whole_overlap():
    for n in (1300, 2400, 5000, 12_345):
        pieces = check("a" * n, 1200, 100)
        assert all(o == 100 for _, _, o, _ in pieces[1:])


def test_blank_lines_are_preferred():
    text = ("line of words here\n" * 10 + "\n") * 4
    pieces = sp.cut_text(text, 250, 0)
    assert all(text[:b].endswith("\n\n") for _, b, _, _ in pieces)


def test_rows(spark):
    lines = "".join(f"line {i} " + "x" * 40 + "\n" for i in range(60))
    rows = [("t", 1, 10, 69, lines), ("t", 2, None, None, lines), ("t", 3, 5, None, "w" * 1300), ("t", 4, 1, 1, None), ("t", 5, 1, 1, ""), ("t", 6, 1, 1, "w " * 600), ("t", 7, 1, 2, "w " * 900)]
    df = spark.createDataFrame(rows, "chunk_table string, id long, start_line int, end_line int, chunk string").selectExpr("*", "1 as cut", "2 as pieces")
    split = sp.split_oversized(df)
    assert {(r.id, r.cut) for r in sp.hardest_cuts(split).collect()} == {(1, "line"), (2, "line"), (3, "hard"), (7, "word")}
    pieces = sp.piece_rows(split).where("id = 1").orderBy("piece_no").collect()
    assert pieces[0].first_line == 10 and pieces[-1].last_line == 69
    for p in pieces:
        assert p.text.startswith(f"line {p.first_line - 10} ") and lines[p.start_char : p.end_char] == p.text
    assert sp.piece_rows(split).where("id = 2 and first_line is not null").count() == 0
    assert sp.split_oversized(df.limit(0)).count() == 0
    assert {(r.within, r.overlapping) for r in sp.checked(split).collect()} == {(True, True)}

"""Cutting oversized texts at natural boundaries into overlapping pieces under a limit.

Boundaries come in three kinds: line ends everywhere, spaces and tabs inside lines that are too long, and positions inside
words that are too long. A dynamic program over the boundaries minimises cut penalties, size imbalance and missing overlap;
a piece's size includes what it repeats of the piece before. Every step looks only at boundaries within one limit's reach,
so its cost grows with the text, not with its square.
"""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 100
KINDS = ("line", "word", "hard")
#: What a cut costs by kind; a perfectly balanced piece costs 0, one of half or one and a half the target size 0.25.
PENALTY = {"blank": 0.0, "line": 0.15, "indent": 0.02, "before_end": 0.5, "word": 20.0, "hard": 1000.0}
#: What it costs by kind of cut that the piece after it has no room for its whole overlap: more than imbalance, and inside a
#: word, where nothing else tells how the pieces hang together, more than a further cut.
LESS_OVERLAP = {"line": 2.0, "word": 2.0, "hard": 2000.0}
HARD_STEP = 20  # characters between two cut positions offered inside a word that is too long
LINE_END = re.compile(r"\r\n|\n|\r")
LINE_START, WORD_START = re.compile(r"\r\n|\n|\r(?!\n)"), re.compile(r"[ \t]+")

PIECE = "piece_no int, start_char int, end_char int, overlap int, cut string, first_line int, last_line int, text string"


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut positions in order, what a cut there costs, and its kind (index into KINDS). The text's two ends are included."""
    cost: dict[int, tuple[float, int]] = {}

    def offer(at: int, penalty: float, kind: int) -> None:
        if 0 < at < len(text):
            cost[at] = min(cost.get(at, (penalty, kind)), (penalty, kind), key=lambda x: (x[1], x[0]))

    ends = [(m.start(), m.end()) for m in LINE_END.finditer(text)]
    begins = [0, *(after for _, after in ends)]
    lines = [text[b:e] for b, e in zip(begins, [*(stop for stop, _ in ends), len(text)])]
    for n, (begin, line) in enumerate(zip(begins, lines)):
        if len(line) > limit:
            _inside(line, begin, limit, offer)
        if n == len(ends):
            break
        stop, after, following = *ends[n], lines[n + 1].lstrip(" \t")
        blank = not line.strip() or not following and n + 1 < len(ends)
        offer(after, PENALTY["blank"] if blank else PENALTY["line"] + PENALTY["indent"] * min(len(lines[n + 1]) - len(following), 40), 0)
        if after - begin > limit:  # the line fits only without its end
            offer(stop, PENALTY["before_end"], 0)
    at = np.array([0, *sorted(cost), len(text)])
    inner = [cost[p] for p in at[1:-1]]
    return at, np.array([0.0, *(p for p, _ in inner), 0.0]), np.array([0, *(k for _, k in inner), 0])


def _inside(line: str, begin: int, limit: int, offer) -> None:
    for m in re.finditer(r"[ \t]|[^ \t]+", line):
        size = m.end() - m.start()
        if line[m.start()] in " \t" or size >= limit:  # after every space; before it only where word and space don't fit together
            offer(begin + m.end(), PENALTY["word"], 1)
        if size > limit:
            for p in range(m.start() + HARD_STEP, m.end(), HARD_STEP):
                while p < m.end() and unicodedata.combining(line[p]) and p % HARD_STEP:  # not inside a letter with its marks
                    p += 1
                offer(begin + p, PENALTY["hard"], 2)


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, overlap, kind of the cut at the end; of the last piece the kind is "line").

    Every piece has at most `limit` characters, pieces cover the text, and each repeats up to `overlap` characters of the
    one before: from the first line start in reach on, else the first word start, else all of them. It repeats less where
    its own text leaves no room, and nothing only where its own text has `limit` characters. A text within the limit is one
    piece; an empty text has none.
    """
    if len(text) <= limit:
        return [(0, len(text), 0, "line")] if text else []
    at, penalty, kind = boundaries(text, limit)
    begins = np.array([_overlap_start(text, p, max(p - overlap, 0)) for p in at.tolist()])
    step = limit - overlap
    target = len(text) / max(1, -(-len(text) // max(1, step)))
    # The imbalance (x_i - x_j - 1)**2 of a piece, with x in target sizes, splits into terms of i, of j, and -2 (x_i - 1) x_j.
    x = at / target
    less = np.array([LESS_OVERLAP[k] for k in KINDS])[kind]
    of_j, came, low, whole = np.zeros(len(at)), [0] * len(at), 0, 0
    positions, starts, places, costs = at.tolist(), begins.tolist(), x.tolist(), penalty.tolist()
    for i in range(1, len(positions)):
        while positions[low] < positions[i] - limit:
            low += 1
        while starts[whole] < positions[i] - limit:  # boundaries from here on leave room for their whole overlap
            whole += 1
        total = of_j[low:i] - (2 * places[i] - 2) * x[low:i]
        if low < whole:
            room = limit - positions[i] + at[low : min(whole, i)]
            total[: len(room)] += less[low : low + len(room)] * (2 - room / max(1, overlap))
        k = int(total.argmin())
        came[i] = low + k
        of_j[i] = float(total[k]) + (places[i] - 1) ** 2 + costs[i] + places[i] ** 2
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    cuts.reverse()
    pieces = []
    for a, b in zip(cuts, cuts[1:]):
        cut, end = positions[a], positions[b]
        start = starts[a] if starts[a] >= end - limit else _overlap_start(text, cut, end - limit)
        pieces.append((start, end, cut - start, KINDS[kind[b]]))
    return pieces


def _overlap_start(text: str, cut: int, earliest: int) -> int:
    """The first line start at or after `earliest`, else the first word start, else `earliest`, with the marks of a letter together."""
    if earliest >= cut:
        return cut
    if earliest == 0 or text[earliest - 1] == "\n":
        return earliest
    for pattern in (LINE_START, WORD_START):
        m = pattern.search(text, earliest, cut)
        if m and m.end() < cut:
            return m.end()
    start = earliest
    while start < cut and unicodedata.combining(text[start]):
        start += 1
    return start if start < cut else earliest


def _pieces(text: str, first: float | None, last: float | None, limit: int, overlap: int) -> list[dict]:
    ends = np.array([m.end() for m in LINE_END.finditer(text)], dtype=int)
    known = lambda x: x is not None and not pd.isna(x)
    out = []
    for n, (start, end, repeated, cut) in enumerate(cut_text(text, limit, overlap), 1):
        lines = (None, None)
        if known(first):
            lines = tuple(int(first) + int(np.searchsorted(ends, p, side="right")) for p in (start, end - 1))
            if known(last):
                lines = tuple(min(x, max(int(last), int(first))) for x in lines)
        out.append({"piece_no": n, "start_char": start, "end_char": end, "overlap": repeated, "cut": cut, "first_line": lines[0], "last_line": lines[1], "text": text[start:end]})
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk of more than `limit` characters.

    chunks: (chunk_table, id, start_line, end_line, chunk). Returns chunk_table, id, pieces (array, in order). Null and
    short chunks are left out by Spark before any Python runs; null line numbers give null line ranges; an `end_line`
    bounds the lines of the last pieces. Repeated ids are treated row by row.
    """
    if overlap >= limit:
        raise ValueError("overlap must be less than limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = [_pieces(*row, limit, overlap) for row in zip(b["chunk"], b["start_line"], b["end_line"])]
            yield pd.DataFrame({"chunk_table": b["chunk_table"], "id": b["id"], "pieces": pieces})

    large = chunks.where(F.length("chunk") > limit).select("chunk_table", "id", "start_line", "end_line", "chunk")
    return large.mapInPandas(run, f"chunk_table string, id long, pieces array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>")


def hardest_cuts(split: DataFrame) -> DataFrame:
    """(chunk_table, id, cut): the least natural kind of cut that a chunk needed."""
    uses = lambda kind: F.exists("pieces", lambda p: p["cut"] == kind)
    cut = F.when(uses("hard"), "hard").when(uses("word"), "word").otherwise("line")
    return split.select("chunk_table", "id", cut.alias("cut")).distinct()


def checked(split: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_table, id, digest, within, overlapping): what the pieces of a chunk say of it, for comparison with the chunk itself.

    digest is the MD5 of the pieces' texts without their overlaps, in order; within, whether each has at most `limit`
    characters; overlapping, whether each but the first repeats 1 to `overlap` characters of the text before, if it has room.
    """
    own = F.transform("pieces", lambda p: F.substring(p["text"], p["overlap"] + 1, F.lit(limit)))
    fits = F.forall("pieces", lambda p: (F.length(p["text"]) <= limit) & (p["end_char"] - p["start_char"] == F.length(p["text"])))
    repeated = lambda p: p["overlap"].between(1, overlap) | (p["overlap"] == 0) & (F.length(p["text"]) == limit)
    repeats = F.forall("pieces", lambda p: F.when(p["piece_no"] == 1, p["overlap"] == 0).otherwise(repeated(p)))
    return split.select("chunk_table", "id", F.md5(F.array_join(own, "")).alias("digest"), fits.alias("within"), repeats.alias("overlapping"))


def piece_rows(split: DataFrame) -> DataFrame:
    """One row per piece."""
    return split.select("chunk_table", "id", F.inline("pieces"))

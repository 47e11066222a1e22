"""Token ids of whole documents by a public byte-level tokenizer, as a monoid over pieces of text.

A place is stable where a character that is no white space is followed by a space or line feed: whatever stands around
it, a word of the splitter begins there, so tokens on either side don't depend on the other side. A piece of text is
kept as its text up to its first stable place, the ids from there to its last one, and the text from there on. Two
neighbours are joined by encoding the window around their seam, which grows to the next stable place on either side. So
texts are encoded by halves down to leaves, and only ids and seams go up the tree, never whole texts. Parts of one text
that several tasks encoded meet in one shuffle, since its ids make one row in the end.
"""

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 1 << 10  # characters that are encoded at once: the base case of the tree
PART = 1 << 16  # characters of a document that one task encodes; longer documents are spread over tasks
STABLE = re.compile(r"\S(?=[ \n])")
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")  # too long for the splitter's stack
NONE = np.zeros(0, dtype=np.int32)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(4)
def load(path: str):
    """The tokenizer of a file of ranks, once per worker; it has no special tokens, so their strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("of_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Piece(NamedTuple):
    """A text as head, ids of what is between its first and last stable place, and tail; without such a place, a head only."""

    head: str
    ids: np.ndarray | None
    tail: str


def encode_text(text: str, tokenizer) -> np.ndarray:
    """The ids of a text; of a very long run of white space all but the last character before more text is one word."""
    m = LONG_BLANK.search(text) if len(text) >= 10_000 else None
    if m is None:
        return np.array(tokenizer.encode_ordinary(text), dtype=np.int32) if text else NONE
    end = m.end() - (m.end() < len(text))
    blank = np.array(tokenizer._encode_single_piece(text[m.start() : end]), dtype=np.int32)
    return np.concatenate([encode_text(text[: m.start()], tokenizer), blank, encode_text(text[end:], tokenizer)])


def _last_stable(text: str, first: int) -> int:
    at = len(text)
    while True:
        at = max(text.rfind(" ", first, at), text.rfind("\n", first, at))
        if at <= first or not text[at - 1].isspace():
            return max(at, first)


def leaf_piece(text: str, tokenizer) -> Piece:
    m = STABLE.search(text)
    if m is None:
        return Piece(text, None, "")
    last = _last_stable(text, m.end())
    return Piece(text[: m.end()], encode_text(text[m.end() : last], tokenizer), text[last:])


def join(a: Piece, b: Piece, tokenizer) -> Piece:
    """The piece of both texts in a row: an associative operation, of which the empty text is the unit."""
    if a.ids is None and b.ids is None:
        return leaf_piece(a.head + b.head, tokenizer)
    if a.ids is None:
        return Piece(a.head + b.head, b.ids, b.tail)
    if b.ids is None:
        return Piece(a.head, a.ids, a.tail + b.head)
    return Piece(a.head, np.concatenate([a.ids, encode_text(a.tail + b.head, tokenizer), b.ids]), b.tail)


def encode(text: str, tokenizer, leaf: int = LEAF) -> Piece:
    """By halves down to leaves, joined on the way back."""
    if len(text) <= leaf:
        return leaf_piece(text, tokenizer)
    half = len(text) // 2
    return join(encode(text[:half], tokenizer, leaf), encode(text[half:], tokenizer, leaf), tokenizer)


def joined(pieces: list[Piece], tokenizer) -> Piece:
    """All pieces in a row, pairwise up a tree."""
    while len(pieces) > 1:
        pieces = [join(*pieces[i : i + 2], tokenizer) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def ids_of(piece: Piece, tokenizer) -> np.ndarray:
    """The ids of a piece that is a whole text."""
    if piece.ids is None:
        return encode_text(piece.head, tokenizer)
    return np.concatenate([encode_text(piece.head, tokenizer), piece.ids, encode_text(piece.tail, tokenizer)])


def encode_ids(documents: DataFrame, path: str | None = None, part: int = PART, leaf: int = LEAF, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; an empty or null text has no ids. Nothing is cut off, whatever a text's length.

    Texts of up to `part` characters are encoded where they are read, without a shuffle. Longer ones are cut into parts,
    which any tasks encode; the parts of a text are joined after one shuffle of ids and seams. Rows of equal doc_id and
    text give as many equal rows.
    """
    path = path or default_path()
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    short = rows.where(F.col("text").isNull() | (F.length("text") <= part)).mapInArrow(_whole(path, leaf), "doc_id long, ids array<int>")
    parts = F.expr(f"transform(sequence(0, int((length(text) - 1) / {part})), i -> struct(i as node, substring(text, i * {part} + 1, {part}) as text))")
    cut = rows.where(F.length("text") > part).select("doc_id", F.md5("text").alias("digest"), F.inline(parts))
    encoded = cut.repartition("doc_id", "digest", "node").mapInArrow(_parts(path, leaf), "doc_id long, digest string, node int, head string, ids array<int>, tail string")
    return short.unionByName(encoded.groupBy("doc_id", "digest").applyInArrow(_whole_of_parts(path), "doc_id long, ids array<int>"))


def _lists(ids: list[np.ndarray], missing: list[bool] | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
    flat = pa.array(np.concatenate(ids) if ids else NONE, pa.int32())
    return pa.ListArray.from_arrays(offsets, flat, mask=pa.array(missing) if missing is not None else None)


def _whole(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            ids = [ids_of(encode(t or "", tokenizer, leaf), tokenizer) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return run


def _parts(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            pieces = [encode(t, tokenizer, leaf) for t in batch.column("text").to_pylist()]
            ids = _lists([NONE if p.ids is None else p.ids for p in pieces], [p.ids is None for p in pieces])
            seams = [pa.array([getattr(p, f) for p in pieces], pa.string()) for f in ("head", "tail")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "digest", "node")), seams[0], ids, seams[1]], ["doc_id", "digest", "node", "head", "ids", "tail"])

    return run


def _whole_of_parts(path: str):
    def run(parts: pa.Table) -> pa.Table:
        tokenizer, nodes = load(path), parts["node"].to_numpy()
        first = {int(n): i for i, n in reversed(list(enumerate(nodes)))}  # of equal rows each part comes several times
        at = [first[n] for n in sorted(first)]
        heads, tails, ids = parts["head"].to_pylist(), parts["tail"].to_pylist(), parts["ids"].combine_chunks()
        pieces = [Piece(heads[i], ids[i].values.to_numpy() if ids[i].is_valid else None, tails[i]) for i in at]
        whole, n = ids_of(joined(pieces, tokenizer), tokenizer), int((nodes == 0).sum())
        return pa.table({"doc_id": pa.array([parts["doc_id"][0].as_py()] * n, pa.int64()), "ids": _lists([whole] * n)})

    return run


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); the bytes of all ids are put together before they are read as characters."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [load(path).decode(np.asarray(x).tolist()) for x in b["ids"]]})

    return encoded.mapInPandas(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, n_chars, same): the length of each document in ids and whether decoding gives its text back."""
    ids = encode_ids(documents, path)
    back = decode_ids(ids, path).select("doc_id", F.md5("text").alias("digest"))
    given = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.md5("t").alias("given"), F.length("t").cast("long").alias("n_chars"))
    sizes = ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"))
    return sizes.join(back, "doc_id").join(given, "doc_id").select("doc_id", "n_ids", "n_chars", (F.col("digest") == F.col("given")).alias("same"))

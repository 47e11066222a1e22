"""Evaluation texts that stand, wholly or partly, inside documents.

Both sides become streams of words (runs of letters and digits, case folded) joined by single spaces. Shared character
q-grams, those that begin with a word, are counted per document, item and band of diagonals; a diagonal is the distance
between a q-gram's word in the document and in the item. An edit of a word moves what follows by one diagonal at most, and
bands overlap by half, so a passage with few edits falls whole into one of them. By the q-gram lemma such a passage keeps a
least number of q-grams, so a band with fewer cannot hold one. What is left is verified by banded alignment of the words.

Few enough q-grams of items are sent to all tasks, and a document meets them where it is read; beyond a counted bound the
q-grams of both sides meet in a shuffle join. Either way the documents are passed over once.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stored

Q = 16  # characters of a q-gram; halved until every item keeps at least one under the edits allowed
WORDS = 20  # consecutive words of the item that make a passage
BROADCAST_GRAMS = 2_000_000  # q-grams of items (20 bytes each, besides about as many bytes of text) that are sent to every task
AT_ONCE = 1 << 20  # characters of documents that are looked at together

_GRAMS = "gram long, id long, word int"
_CANDIDATES = "doc_id long, item_id long, band int"
_FOUND = "doc_id long, item_id long, n_words int"


# --- words and q-grams -------------------------------------------------------------------------------------------------


@lru_cache(1)
def _alphanumeric() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


class Stream(NamedTuple):
    """Several texts as codes of characters, words divided by 32 and texts ended by 0, with each word's place and text."""

    codes: np.ndarray
    starts: np.ndarray
    of: np.ndarray

    def words(self, first: int, last: int) -> list[str]:
        """The words from number `first` to before `last`, of one text."""
        end = self.starts[last] if last < len(self.starts) else len(self.codes)
        return self.codes[self.starts[first] : end].tobytes().decode("utf-32-le").rstrip("\0 ").split(" ")


def stream(texts: list[str]) -> Stream:
    """The words of texts, composed and case folded."""
    joined = "\0".join([t.replace("\0", " ") for t in texts] + [""])
    if joined.isascii():
        joined = joined.lower()
    else:
        joined = unicodedata.normalize("NFC", unicodedata.normalize("NFC", joined).casefold())
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    in_word, ends = _alphanumeric()[codes], codes == 0
    keep = in_word | ends
    keep[1:] |= in_word[:-1]
    codes = np.where(in_word | ends, codes, np.uint32(32))[keep]
    in_word = codes > 32
    starts = in_word.copy()
    starts[1:] &= ~in_word[:-1]
    starts = np.flatnonzero(starts)
    return Stream(codes, starts, np.searchsorted(np.flatnonzero(codes == 0), starts))


def grams(codes: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each of the places; q is a power of two, so that doubling gets there."""
    h = np.concatenate([codes, np.zeros(q, np.uint32)]).astype(np.uint64)
    size = 1
    with np.errstate(over="ignore"):
        h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        double = lambda a, b: (a ^ (a >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + b * np.uint64(0xD6E8FEB86659FD93)
        while 2 * size < q:
            h = double(h[:-size], h[size:])
            size *= 2
        return double(h[at], h[at + size]) if size < q else h[at]


def least_shared(starts: np.ndarray, q: int, least_words: int, edits: int) -> int:
    """q-grams that a passage of `least_words` words of an item with words at `starts` keeps at least.

    A q-gram touches at most r words. At most edits + 1 runs of unchanged words make up the passage, and each loses the
    q-grams of its last r - 1 words.
    """
    touched = np.searchsorted(starts, starts + q, side="right") - np.arange(len(starts))
    return least_words - (edits + 1) * (int(touched.max()) - 1)


# --- alignment ---------------------------------------------------------------------------------------------------------


def longest_run(item: list[str], text: list[str], first: int, width: int, edits: int) -> int:
    """Words that a part of `item` and a part of `text` have in common, in order and with at most `edits` words changed, left
    out or put in between; only places are met of which the distance is `first` to before `first + width`.
    """
    if not edits:
        best = 0
        for d in range(first, first + width):
            low = max(0, -d)
            run = 0
            for x, y in zip(item[low:], text[low + d :]):
                run = run + 1 if x == y else 0
                best = max(best, run)
        return best
    best, before = 0, [[0] * (width + 2) for _ in range(edits + 1)]
    for i, x in enumerate(item):
        now = [[0] * (width + 2) for _ in range(edits + 1)]
        for e in range(edits + 1):
            for d in range(width):
                j = i + first + d
                n = before[e][d] + 1 if 0 <= j < len(text) and text[j] == x else 0
                if e:
                    n = max(n, before[e - 1][d], before[e - 1][d + 1], now[e - 1][d - 1] if d else 0)
                now[e][d] = n
                best = max(best, n)
        before = now
    return best


# --- search ------------------------------------------------------------------------------------------------------------


class Items(NamedTuple):
    """All q-grams of the items in order of hash, with the item and word of each, and the items with the least counts."""

    hashes: np.ndarray
    of: np.ndarray
    word: np.ndarray
    seen: np.ndarray
    ids: np.ndarray
    texts: list[str]
    least: np.ndarray


def _items(gram: pa.Table, known: pa.Table) -> Items:
    ids = known["item_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], known["words"].to_pylist()
    hashes = gram["gram"].to_numpy().view(np.uint64)
    by_hash = np.argsort(hashes, kind="stable")
    seen = np.zeros(1 << 20, dtype=bool)  # first look by 20 bits; most q-grams of a corpus end here
    seen[hashes >> np.uint64(44)] = True
    of = np.searchsorted(ids, gram["id"].to_numpy()[by_hash])
    return Items(hashes[by_hash], of, gram["word"].to_numpy()[by_hash], seen, ids, [texts[i] for i in order], known["least"].to_numpy()[order])


def _bands(hits: tuple[np.ndarray, ...], edits: int) -> tuple[np.ndarray, ...]:
    """(text, item, band) of each hit in both bands that its diagonal lies in."""
    text, item, diagonal = hits
    band = np.floor_divide(diagonal, edits + 1)
    return np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1])


def candidates(s: Stream, items: Items, q: int, edits: int) -> Iterator[tuple[int, int, int]]:
    """(text, item's place, band) wherever a band of a text has the q-grams that a passage keeps at least."""
    h = grams(s.codes, s.starts, q)
    maybe = np.flatnonzero(items.seen[h >> np.uint64(44)])
    low = np.searchsorted(items.hashes, h[maybe], side="left")
    n = np.searchsorted(items.hashes, h[maybe], side="right") - low
    if not n.any():
        return
    word = np.repeat(maybe, n)
    k = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(word))
    first_word = np.searchsorted(s.of, s.of[word])
    text, item, band = _bands((s.of[word], items.of[k], word - first_word - items.word[k]), edits)
    order = np.lexsort((band, item, text))
    text, item, band = text[order], item[order], band[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
    begin = np.flatnonzero(new)
    shared = np.diff(np.concatenate([begin, [len(text)]]))
    for b in begin[shared >= items.least[item[begin]]]:
        yield int(text[b]), int(item[b]), int(band[b])


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in blocks of about AT_ONCE characters, or of one longer text, with the place of the first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def _search(items, q: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for at, texts in _blocks(batch.column("text").to_pylist()):
                s = stream(texts)
                for text, item, band in candidates(s, known, q, edits):
                    first, last = np.searchsorted(s.of, [text, text + 1])
                    words = known.texts[item].split(" ")
                    # of the document only the words that the band can meet
                    low, width = band * (edits + 1), 2 * (edits + 1)
                    begin = max(int(first), min(int(last) - 1, int(first) + low))
                    end = max(begin + 1, min(int(last), int(first) + low + width + len(words)))
                    n = longest_run(words, s.words(begin, end), low - (begin - int(first)), width, edits)
                    rows.append((ids[at + text], int(known.ids[item]), n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "n_words"])

    return run


def _known_items(least_words: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                s = stream([text])
                if len(s.starts) >= least_words:
                    q = Q
                    while q > 1 and least_shared(s.starts, q, least_words, edits) < 1:
                        q //= 2
                    rows.append((item_id, " ".join(s.words(0, len(s.starts))), q))
            kinds = (pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["item_id", "words", "q"])

    return run


def _with_least(q: int, least_words: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [max(1, least_shared(stream([w]).starts, q, least_words, edits)) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("words"), pa.array(least, pa.int32())], ["item_id", "words", "least"])

    return run


def _grams(q: int, whole: bool):
    """q-grams of texts (id, text): of items those that end with the text at the latest, of documents all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _blocks(batch.column("text").to_pylist()):
                s = stream(texts)
                ids = batch.column("id").to_numpy(zero_copy_only=False)[at : at + len(texts)]
                ends = np.flatnonzero(s.codes == 0)
                keep = s.starts + q <= ends[s.of] if whole else np.ones(len(s.starts), bool)
                word = np.arange(len(s.starts)) - np.searchsorted(s.of, s.of)
                h = grams(s.codes, s.starts[keep], q).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[s.of[keep]], pa.int64()), pa.array(word[keep].astype(np.int32))], ["gram", "id", "word"])

    return run


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for text, item, band in zip(*(batch.column(c).to_pylist() for c in ("text", "words", "band"))):
                s = stream([text])
                n.append(longest_run(item.split(" "), s.words(0, len(s.starts)), band * (edits + 1), 2 * (edits + 1), edits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(n, pa.int32())], ["doc_id", "item_id", "n_words"])

    return run


def _joined(documents: DataFrame, known: DataFrame, item_grams: DataFrame, q: int, edits: int) -> DataFrame:
    """(doc_id, item_id, n_words) by a shuffle join of q-grams, counted per band before the texts of the candidates meet."""
    document_grams = documents.select(F.col("doc_id").alias("id"), "text").mapInArrow(_grams(q, False), _GRAMS)
    hits = document_grams.withColumnsRenamed({"id": "doc_id", "word": "at"}).join(item_grams.withColumnRenamed("id", "item_id"), "gram")
    band = F.floor((F.col("at") - F.col("word")) / (edits + 1)).cast("int")
    counted = hits.select("doc_id", "item_id", F.explode(F.array(band, band - 1)).alias("band")).groupBy("doc_id", "item_id", "band").agg(F.count("*").alias("shared"))
    kept = stored(counted.join(known.select("item_id", "least"), "item_id").where(F.col("shared") >= F.col("least")).select("doc_id", "item_id", "band"))
    return kept.join(documents, "doc_id").join(known.select("item_id", "words"), "item_id").select("doc_id", "item_id", "band", "text", "words").mapInArrow(_verify(edits), _FOUND)


def leaked_passages(documents: DataFrame, items: DataFrame, least_words: int = WORDS, edits: int = 0, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, item_id, n_words): documents with a passage of an item and the words that the longest one has in common with it.

    A passage has at least `least_words` words of the item in order, with at most `edits` words changed, left out or put
    in between. documents: (doc_id, text); items: (item_id, text). Null and empty texts hold and are no passage, rows of
    a null id are left out; items of fewer words than `least_words` leak nowhere; repeated rows give one row. No item gives an
    empty result.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    long_enough = stored(given.mapInArrow(_known_items(least_words, edits), "item_id long, words string, q int"))
    q = long_enough.agg(F.min("q")).first()[0] or Q
    # items that are repeated under one id count as one row each; the id names them all
    known = long_enough.select("item_id", "words").distinct().mapInArrow(_with_least(q, least_words, edits), "item_id long, words string, least int")
    item_grams = known.select(F.col("item_id").alias("id"), F.col("words").alias("text")).mapInArrow(_grams(q, True), _GRAMS)
    if long_enough.groupBy("item_id").count().where("count > 1").isEmpty() and item_grams.count() <= broadcast_grams:
        sent = spark.sparkContext.broadcast(_items(item_grams.toArrow(), known.toArrow()))
        found = rows.mapInArrow(_search(sent, q, edits), _FOUND)
    else:
        found = _joined(rows, known, item_grams, q, edits)
    return found.where(F.col("n_words") >= least_words).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))

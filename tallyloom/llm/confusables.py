"""One consistent form for texts that look alike but are stored with different characters.

The skeleton of a text: decompose it, replace every character by the prototype it looks like, decompose again. Spaces of
any single width become U+0020, invisible characters go, full-width forms and ligatures become ordinary letters. What
differs visibly stays different: letter, digit, case, accent, raised or circled digits, a zero-width non-joiner between
Arabic-script letters, a joiner between pictographs.
"""

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.plans.lineage import stored

# Letters of other scripts and the Latin letter each looks like (a choice from Unicode's confusables data).
LOOK_ALIKES = {
    "a": "аɑ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іⅰ", "j": "јϳ",
    "l": "ӏⅼ", "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛգ", "s": "ѕ", "u": "ս", "v": "ѵνⅴ", "w": "ԝ",
    "x": "хⅹ", "y": "уү", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹⅭ", "D": "ᎠⅮ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀⅠ", "J": "ЈᎫ",
    "K": "КΚK", "L": "ᏞⅬ", "M": "МΜⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ",
    "U": "Ս", "V": "ѴᏙⅤ", "W": "ԜᎳ", "X": "ХΧⅩ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "-": "‐‑", ".": "․", "/": "⁄∕", ":": "꞉", ";": ";", "|": "ǀ", "!": "ǃ", "'": "ʹ", ",": "‚",
}
# Characters that are drawn as nothing (besides the categories Cf and the variation selectors).
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
ZWNJ, ZWJ = "\u200c", "\u200d"
#: Kinds of compatibility decomposition that do not change how a character looks, for all characters.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

ARABIC = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff"
BETWEEN_ARABIC = re.compile(f"(?<=[{ARABIC}]){ZWNJ}+(?=[{ARABIC}])")
PICTURES = "\u2190-\u2bff\ufe0f\U0001f000-\U0001faff"
BETWEEN_PICTURES = re.compile(f"(?<=[{PICTURES}]){ZWJ}(?=[{PICTURES}])")
KEPT_ZWNJ, KEPT_ZWJ = "\ue000", "\ue001"  # stand-ins while the others are removed


@lru_cache(1)
def prototypes() -> dict[int, str]:
    """For every character that is replaced: what by. Built from Unicode's character data and the lists above."""
    table: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        category = unicodedata.category(c)
        kind = unicodedata.decomposition(c).split(" ")[0]
        if category == "Zs":
            table[code] = " "
        elif category == "Cf" and code not in range(0x600, 0x606) or c in INVISIBLE or unicodedata.name(c, "").startswith("VARIATION SELECTOR"):
            table[code] = ""
        elif kind in SAME_LOOK or kind == "<compat>" and category in ("Ll", "Lu", "Lt", "Lo") and c != "ſ":
            plain = unicodedata.normalize("NFKD", c)
            table[code] = plain if plain.strip() == plain else c
    table |= {ord(c): plain for plain, likes in LOOK_ALIKES.items() for c in likes}
    return table


def skeleton(text: str | None) -> str | None:
    """The form that texts which look alike share; null stays null, an empty text empty. Line ends become U+000A."""
    if text is None:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    if ZWNJ in text or ZWJ in text:
        shown = "".join(c for c in text if c in (ZWNJ, ZWJ) or prototypes().get(ord(c)) != "")
        text = BETWEEN_PICTURES.sub(KEPT_ZWJ, BETWEEN_ARABIC.sub(KEPT_ZWNJ, shown))
    text = text.translate(prototypes())
    return unicodedata.normalize("NFD", text).replace(KEPT_ZWNJ, ZWNJ).replace(KEPT_ZWJ, ZWJ)


@F.pandas_udf(T.StringType())
def skeleton_udf(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def consistent(chunks: DataFrame, table: str, text: str = "chunk", key: str = "id") -> DataFrame:
    """(chunk_table, id, form): every text in the one form that all texts which look like it share; null stays null."""
    return chunks.select(F.lit(table).alias("chunk_table"), F.col(key).cast("long").alias("id"), skeleton_udf(F.col(text)).alias("form"))


def forms(chunks: DataFrame, table: str, text: str = "chunk", key: str = "id") -> DataFrame:
    """(chunk_table, id, look, form): digests of a text's skeleton and of its characters. Rows with a null text are left out.

    Texts are read once and never shuffled; everything after this works on 16-byte digests.
    """
    rows = chunks.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    digest = lambda c: F.unhex(F.md5(c))
    return rows.select(F.lit(table).alias("chunk_table"), "id", digest(skeleton_udf("text")).alias("look"), digest(F.col("text")).alias("form"))


def mixed_looks(rows: DataFrame) -> DataFrame:
    """The (chunk_table, look) of more than one form."""
    ends = rows.groupBy("chunk_table", "look").agg(F.min("form").alias("least"), F.max("form").alias("most"))
    return ends.where(F.col("least") != F.col("most")).select("chunk_table", "look")


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows of one table with equal skeletons and different characters; rows of equal characters are no pair.

    rows: as from `forms`; the digests are written out once, so that texts are not read again for each side of the join.
    Looks with a single form leave before the join, so only rows of a real case meet.
    """
    rows = stored(rows)
    cases = rows.join(mixed_looks(rows), ["chunk_table", "look"], "left_semi")
    a, b = cases.alias("a"), cases.alias("b")
    same: Column = (
        (F.col("a.chunk_table") == F.col("b.chunk_table"))
        & (F.col("a.look") == F.col("b.look"))
        & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.form") != F.col("b.form"))
    )
    return a.join(b, same).select("a.chunk_table", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def look_classes(rows: DataFrame) -> DataFrame:
    """One row per text: (chunk_table, id, class_id, n_rows, n_forms); class_id is the least id that looks the same."""
    rows = stored(rows)
    by_form = rows.groupBy("chunk_table", "look", "form").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = by_form.groupBy("chunk_table", "look").agg(
        F.min("id").alias("class_id"), F.sum("n").cast("long").alias("n_rows"), F.count("*").alias("n_forms")
    )
    return rows.join(classes, ["chunk_table", "look"]).select("chunk_table", "id", "class_id", "n_rows", "n_forms")

"""P6: one form for visually identical text.

``canonical`` gives the form for comparisons: compatibility normalisation in composed form,
full case folding, white space mapped to the space and the line feed, default-ignorable
characters removed, look-alike letters brought to Latin. ``visible`` keeps what a reader can see
(case, fractions, superscripts); it is the exact check behind ``same_look``.
Both work on the distinct values of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.lineage import cut

# Letters of other scripts that are drawn like Latin ones.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҺаеорсухіјѕһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ",
        "ABESIJKMHOPCTYXhaeopcyxijshdqw" "ABEZHIKMNOPTYXocj",
    )
)
# The characters with the property Default_Ignorable_Code_Point, as ranges.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

_JOINERS = (0x200C, 0x200D)
_IGNORE = {c: None for a, b in IGNORABLE for c in range(a, b + 1)}
_UNSEEN = {c: None for c in _IGNORE if c not in _JOINERS}
# A joiner changes what is drawn only after a mark, an Indic letter or a picture.
_IDLE_JOINER = re.compile("(?<![़-෿‍☀-⟿\U0001f000-\U0001faff])[‌‍]")
_SPACES = {c: " " for c in (0x9, 0x1F, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_BREAKS = {c: "\n" for c in (0xB, 0xD, 0x85, 0x2028, 0x2029)}
_TRAIL = re.compile(r" +(?=\n|\Z)")
_ALIKE = str.maketrans(LOOK_ALIKE)
_OTHER_SCRIPT = re.compile("[Ͱ-ϿЀ-ԯ]")


def _widths() -> dict[int, str]:
    """Full-width and half-width forms and ligatures, from the Unicode tables."""
    out = {}
    for a, b in ((0xFF01, 0xFFEF), (0xFB00, 0xFB50), (0x132, 0x134), (0x1C4, 0x1CD), (0x1F1, 0x1F4)):
        for c in range(a, b):
            how = unicodedata.decomposition(chr(c))
            if how.startswith(("<wide>", "<narrow>", "<compat>")):
                out[c] = unicodedata.normalize("NFKC", chr(c))
    return out


_CANONICAL = _SPACES | _BREAKS | _IGNORE
_VISIBLE = _widths() | _SPACES | _BREAKS | _UNSEEN


def _alike(text: str) -> str:
    """Latin letters for those drawn alike, marks apart while they are exchanged."""
    if _OTHER_SCRIPT.search(text):
        text = unicodedata.normalize("NFD", text).translate(_ALIKE)
    return unicodedata.normalize("NFC", text)


def _trimmed(text: str) -> str:
    return _TRAIL.sub("", text).strip()


def canonical_text(text: str) -> str:
    """The form for comparisons. Idempotent."""
    text = text.replace("\r\n", "\n").translate(_CANONICAL)
    if text.isascii():
        return _trimmed(text.lower())
    text = _alike(unicodedata.normalize("NFKC", text)).casefold()
    text = unicodedata.normalize("NFKC", _alike(text)).casefold()
    return _trimmed(unicodedata.normalize("NFKC", text.translate(_CANONICAL)))


def visible_text(text: str) -> str:
    """What a reader sees, width and ligatures aside."""
    text = text.replace("\r\n", "\n").translate(_VISIBLE)
    if not text.isascii():
        if "‌" in text or "‍" in text:
            text = _IDLE_JOINER.sub("", text)
        text = _alike(text)
    return _trimmed(text)


def _column(function, text_col: str):
    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            codes, values = pd.factorize(batch)
            done = [function(v) for v in values]
            yield pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)

    return run(F.col(text_col))


def canonical(text_col: str):
    """Column: the comparison form; null stays null, blank text becomes empty."""
    return _column(canonical_text, text_col)


def visible(text_col: str):
    """Column: the visible form; null stays null, blank text becomes empty."""
    return _column(visible_text, text_col)


def looks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _c, _v, _t): the hashes of the canonical form, of the visible form and of the text of each row, each once.

    Null and blank texts are left out. Only ids and hashes leave the scan, never texts."""
    return (
        df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .where(F.col("_id").isNotNull() & F.col("_text").isNotNull())
        .withColumn("_canonical", canonical("_text"))
        .withColumn("_visible", visible("_text"))
        .where("_visible != ''")
        .select(
            "_id", F.xxhash64("_canonical").alias("_c"), F.unhex(F.md5("_visible")).alias("_v"),
            F.unhex(F.md5("_text")).alias("_t"),
        )
        .distinct()
    )


def same_look(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key_a, key_b): pairs of ids, key_a < key_b, whose texts differ but look the same.

    Rows are first gathered by the hash of the canonical form, then held together by the hash of
    the visible form. Null and blank texts are no cases; repeated rows count once; an id
    with several texts takes part with each. Equal texts are one text until the pairs of different texts are
    known: a text under very many ids is never paired with itself."""
    keyed = cut(looks(df, id_col, text_col))  # used three times
    one = keyed.select("_c", "_v", "_t").distinct()
    pairs = one.join(one.withColumnRenamed("_t", "_u"), ["_c", "_v"]).where("_t < _u").select("_t", "_u").distinct()
    a = keyed.select("_t", F.col("_id").alias("_a")).distinct()
    b = keyed.select(F.col("_t").alias("_u"), F.col("_id").alias("_b")).distinct()
    both = pairs.join(a, "_t").join(b, "_u").where("_a != _b")
    return both.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b")).distinct()


def look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, representative, texts): each id with the smallest id whose text looks the same, and the number of different texts of its class.

    An id with several texts has a row for each class. Classes are told by aggregation: no pairs are made."""
    keyed = cut(looks(df, id_col, text_col))
    classes = keyed.groupBy("_c", "_v").agg(F.min("_id").alias("representative"), F.count_distinct("_t").alias("texts"))
    return keyed.select("_id", "_c", "_v").distinct().join(classes, ["_c", "_v"]).select(F.col("_id").alias(id_col), "representative", "texts").distinct()

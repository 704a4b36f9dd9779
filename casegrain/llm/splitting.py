"""P1: splitting oversized texts at natural boundaries.

Each text longer than ``max_chars`` code points is cut by dynamic programming: candidate
positions carry a penalty by kind (paragraph, sentence, line, clause, word, character) and
the path with the smallest sum of penalties plus size imbalance is taken, under the hard
condition that a piece, including the overlap it repeats from its predecessor, stays within
``max_chars``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("fresh", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)

#: Cost of a cut by kind of position.
PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD, CHARACTER = 0.0, 0.6, 1.5, 2.0, 5.0, 25.0

_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*|\f\s*")
_SENTENCE = re.compile(r"[.!?…।॥۔؟][\"')\]”’»]*\s+|[。！？][」』”’\")]*\s*")
_LINE = re.compile(r"\n")
_CLAUSE = re.compile(r"[;:,،؛，；：、]\s+|[，；、]")
_WORD = re.compile(r"\s+")


def _joins(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would separate a mark or joiner from its base."""
    return 0 < at < len(text) and (
        unicodedata.category(text[at])[0] == "M" or text[at] in "\u200c\u200d" or text[at - 1] == "\u200d"
        or unicodedata.combining(text[at - 1]) == 9
    )


def _candidates(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (after the separator) and penalties, dense enough that every stretch of
    ``room`` characters holds one; finer kinds are added only where coarser ones leave gaps."""
    n, best = len(text), {}
    for pattern, cost in ((_CLAUSE, CLAUSE), (_LINE, LINE), (_SENTENCE, SENTENCE), (_PARAGRAPH, PARAGRAPH)):
        for m in pattern.finditer(text):
            best[m.end()] = min(cost, best.get(m.end(), cost))
    best.pop(n, None)
    best.pop(0, None)
    gap = max(1, room // 8)
    at = [0, *sorted(best), n]
    for a, b in zip(at, at[1:]):
        if b - a > gap:
            inside = [m.end() + a for m in _WORD.finditer(text[a:b]) if 0 < m.end() < b - a]
            for x in inside:
                best.setdefault(x, WORD)
            stops = [a, *inside, b]
            for c, d in zip(stops, stops[1:]):
                if d - c > gap:
                    for x in range(c + gap, d, gap):
                        while x > c + 1 and _joins(text, x):
                            x -= 1
                        best.setdefault(x, CHARACTER)
    at = [0, *sorted(best), n]
    for a, b in zip(at, at[1:]):  # a run of marks longer than the room must be cut all the same
        for x in range(a + room, b, room):
            best[x] = CHARACTER
    pos = np.array([0, *sorted(best), n])
    return pos, np.array([0.0, *(best[p] for p in pos[1:-1].tolist()), 0.0])


def cut_points(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(piece_no, start, fresh, end) of each piece: ``start`` is where the piece begins with its
    repeated part, ``fresh`` where the new part begins. The fresh parts tile the text."""
    n = len(text)
    if n <= max_chars:
        return [(0, 0, 0, n)] if n else []
    room = max_chars - overlap
    pos, cost = _candidates(text, room)
    k = len(pos)
    target = n / (1 + -(-(n - max_chars) // room))
    total, back = np.full(k, np.inf), np.zeros(k, dtype=np.int64)
    total[0] = 0.0
    for j in range(1, k):
        i0 = int(np.searchsorted(pos, pos[j] - room))
        if i0 >= j:
            i0 = j - 1
        size = pos[j] - pos[i0:j]
        trial = total[i0:j] + cost[j] + 4.0 * ((size - target) / room) ** 2 + 0.5
        if pos[j] <= max_chars:  # the first piece has no overlap to hold
            first = cost[j] + 4.0 * ((pos[j] - target) / room) ** 2 + 0.5
        else:
            first = np.inf
        b = int(np.argmin(trial))
        if first <= trial[b]:
            total[j], back[j] = first, 0
        else:
            total[j], back[j] = trial[b], i0 + b
    ends, j = [], k - 1
    while j > 0:
        ends.append(int(pos[j]))
        j = int(back[j])
    out, fresh = [], 0
    for no, end in enumerate(reversed(ends)):
        start = fresh
        if no and overlap:
            low = max(0, fresh - overlap)
            start = low
            if low and not text[low - 1].isspace():  # open with a whole word if one begins in time
                m = _WORD.search(text, low, fresh)
                if m and m.end() < fresh:
                    start = m.end()
                else:
                    while start < fresh and _joins(text, start):
                        start += 1
        out.append((no, start, fresh, end))
        fresh = end
    return out


def split_oversized(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 2400, overlap: int = 200
) -> DataFrame:
    """One row per piece: id, piece_no (from 0), start, fresh, end, piece, n_pieces.

    Null and empty texts give no row; a text within the limit is one piece. Repeated rows are
    split alike, once each. Columns other than the two named are neither read nor needed, so
    clashing names can't disturb it. Offsets count code points."""
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and below max_chars")

    @F.pandas_udf(PIECE)
    def cuts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([cut_points(t, max_chars, overlap) if t else [] for t in batch], dtype=object)

    return (
        df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .withColumn("_cuts", cuts("_text"))
        .withColumn("n_pieces", F.size("_cuts"))
        .select("_id", "_text", "n_pieces", F.explode("_cuts").alias("_c"))
        .select(
            F.col("_id").alias(id_col), "_c.piece_no", "_c.start", "_c.fresh", "_c.end",
            F.expr("substring(_text, _c.start + 1, _c.end - _c.start)").alias("piece"), "n_pieces",
        )
    )

"""Column helpers with Unicode white space and line semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and those that end a line.
WS = r"[\s\x1c-\x1f\x85   -     　]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


#: The same white space as single characters, for trimming without a pattern.
WS_LETTERS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_LETTERS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_LETTERS))


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def lines(c: Column) -> Column:
    """The lines of a text; a final line end opens no further line. The text is named once, so that nested uses don't
    multiply the work."""
    ends = LINE_END.removeprefix(r"\r\n|").strip("[]")
    found = F.regexp_extract_all(c, F.lit(rf"[^{ends}]*(?:{LINE_END})|[^{ends}]+"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, rf"(?:{LINE_END})\z", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{WS}+", -1), lambda w: w != "")


def join_lines(c: Column, by: str = "\n") -> Column:
    return F.array_join(c, by)


def any_contains(c: Column, terms: list[str]) -> Column:
    """Whether the text holds one of the terms."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out

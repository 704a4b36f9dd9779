"""Payloads of web searches as case rows: projections, and which source is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.operators.evidence import strip_html

ROW = ["query_id", "doc_id", "title", "headline", "url", "court", "date", "text_excerpt", "acts", "sections", "relevance_score"]
JUDGMENT_SCORE, PAGE_SCORE = 0.55, 0.65
MENTIONED = r"(?i)\bSection\s+(\d+[A-Za-z]?)\b"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _sections(c: Column) -> Column:
    """Sections the text names, else those of the query."""
    found = F.regexp_extract_all(c, F.lit(MENTIONED), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce("suggested_sections", F.array().cast("array<string>")))


def judgment_rows(found: DataFrame, address: str) -> DataFrame:
    """ROW of a judgment search: (query_id, tid, title, headline, court, publishdate) with the query's suggested lists.

    Headlines lose their tags; ``address`` is a format with one %s for the id. Null fields are empty."""
    headline = strip_html(_text("headline"))
    return found.select(
        "query_id", _text("tid").alias("doc_id"), _text("title").alias("title"), headline.alias("headline"), F.format_string(address, _text("tid")).alias("url"), _text("court").alias("court"),
        _text("publishdate").alias("date"), F.substring(headline, 1, 600).alias("text_excerpt"), F.coalesce("suggested_acts", F.array().cast("array<string>")).alias("acts"),
        _sections(headline).alias("sections"), F.lit(JUDGMENT_SCORE).alias("relevance_score"),
    )


def page_rows(found: DataFrame, name: str = "page") -> DataFrame:
    """ROW of a general search: (query_id, position from 1, title, url, content) with the query's suggested lists.

    The court is told by the address or title; ids hold the position and a hash of the address that doesn't change."""
    url, title, content = _text("url"), _text("title"), _text("content")
    high = F.contains(F.lower(url), F.lit("highcourt")) | F.contains(F.lower(url), F.lit("hc")) | F.contains(F.lower(title), F.lit("high court"))
    key = F.substring(F.md5(url.cast("binary")), 1, 6)
    return found.select(
        "query_id", F.concat_ws("_", F.lit(name), F.col("position").cast("string"), key).alias("doc_id"), title.alias("title"), F.substring(content, 1, 400).alias("headline"), url.alias("url"),
        F.when(high, "High Court").otherwise("Supreme Court of India").alias("court"), F.lit("Recent").alias("date"), F.substring(content, 1, 800).alias("text_excerpt"),
        F.coalesce("suggested_acts", F.array().cast("array<string>")).alias("acts"), _sections(content).alias("sections"), F.lit(PAGE_SCORE).alias("relevance_score"),
    )


def by_priority(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first source, and of the second for queries of which the first has none. A source that failed is an empty one."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))

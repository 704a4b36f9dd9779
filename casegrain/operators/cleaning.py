"""Cleaning of extracted and scanned text: columns for single texts, joins for pages.

Null stays null and blank text gives the empty text in every column function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import text as T

# What counts as a page number, a reader's mark, a margin letter.
PAGE_NUMBER = r"^(\p{Nd}+|-\s*\p{Nd}+\s*-|(?i:page)\s+\p{Nd}+(\s+(?i:of)\s+\p{Nd}+)?|\[\s*\p{Nd}+\s*\])$"
READER_MARK = r"(?i)^---\s*page\s+\d+\s+of\s+\d+\s*---$"
MARGIN_LETTER = r"^\s*[A-H]\s*$"
EDGE_LINES, REPEAT_SHARE, LEAST_PAGES, DUPLICATES = 3, 0.4, 2, 3


def strip_reader_marks(c: Column) -> Column:
    return T.join_lines(F.filter(T.lines(c), lambda x: ~T.strip(x).rlike(READER_MARK)))


def collapse_spaces(c: Column) -> Column:
    one = F.regexp_replace(F.regexp_replace(c, "\t", " "), " {2,}", " ")
    return T.join_lines(F.transform(T.lines(one), T.rstrip))


def collapse_blank_lines(c: Column, most: int = 1) -> Column:
    return F.regexp_replace(c, rf"(\n[ \t]*){{{most + 1},}}", "\n" * (most + 1))


def remove_page_numbers(c: Column) -> Column:
    return T.join_lines(F.filter(T.lines(c), lambda x: ~T.strip(x).rlike(PAGE_NUMBER)))


def remove_margin_letters(c: Column) -> Column:
    return T.join_lines(F.filter(T.lines(c), lambda x: ~x.rlike(MARGIN_LETTER) & ~x.rlike(r"^\s*---\s*Page\s+\p{Nd}+")))


def clean_document(c: Column) -> Column:
    """The steps on a text whose pages are already joined; ``clean_documents`` starts from pages."""
    out = collapse_blank_lines(remove_page_numbers(collapse_spaces(strip_reader_marks(c))))
    return F.when(T.strip(c) == "", F.lit("")).otherwise(T.strip(out))


def ocr_whitespace(c: Column) -> Column:
    return T.strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), " {2,}", " "))


def line_key(c: Column) -> Column:
    return F.lower(T.collapse(c))


def is_heading(c: Column) -> Column:
    s = T.strip(c)
    return (s != "") & (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) < 80)


def page_lines(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """(doc, page, pos, line, key) of every line of distinct pages."""
    one = pages.select(F.col(doc).alias("doc_id"), F.col(page).alias("page_num"), F.col(text).alias("text")).distinct()
    return one.select("doc_id", "page_num", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))


def repeated_edges(pages: DataFrame, **names) -> DataFrame:
    """(doc_id, key, pages): lines among the first and last of many of a document's pages.

    Only lines near an edge are shuffled by document; pages without text count as pages."""
    rows = page_lines(pages, **names).where("key != ''")
    top = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("pos"))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_num"))
    edge = rows.withColumn("_t", top).withColumn("_n", size).where(
        (F.col("_t") <= EDGE_LINES) | ((F.col("_n") > EDGE_LINES) & (F.col("_n") - F.col("_t") < EDGE_LINES))
    )
    total = pages.select(F.col(names.get("doc", "doc_id")).alias("doc_id"), F.col(names.get("page", "page_num")).alias("page_num")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("_pages"))
    return (
        edge.select("doc_id", "page_num", "key").distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("pages"))
        .join(total, "doc_id")
        .where(F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("_pages") * F.lit(REPEAT_SHARE))))
        .select("doc_id", "key", "pages")
    )


def remove_repeated_edges(pages: DataFrame, **names) -> DataFrame:
    """(doc_id, page_num, text) without the lines that recur at page edges, wherever they stand."""
    rows = page_lines(pages, **names)
    kept = rows.join(repeated_edges(pages, **names).select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    text = kept.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    all_pages = rows.select("doc_id", "page_num").distinct()
    return all_pages.join(text, ["doc_id", "page_num"], "left").select(
        "doc_id", "page_num", F.coalesce(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("")).alias("text")
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "\f") -> DataFrame:
    """(id, text): texts whose pages are parted by ``by``, without reader's marks, recurring edge lines and page numbers,
    with spaces and blank lines collapsed. A null or blank text gives the empty text."""
    parted = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), by, -1)).alias("page_num", "_t"))
    bare = remove_repeated_edges(parted.select("doc_id", "page_num", strip_reader_marks(F.col("_t")).alias("text")))
    whole = bare.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("_p"))
    joined = F.coalesce(F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n"), F.lit(""))
    whole = docs.select(F.col(id_col).alias("doc_id")).distinct().join(whole, "doc_id", "left")
    return whole.select(F.col("doc_id").alias(id_col), T.strip(collapse_blank_lines(remove_page_numbers(collapse_spaces(joined)))).alias(text_col))


def postprocess_pages(ocr_lines: DataFrame, pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(doc_id, page_num, text): recognised lines as paragraphs, corrected, spaces collapsed, marked where confidence is low.

    ``pages`` (doc_id, page_num, confidence, is_low_confidence), one row a page; a page without a line is empty."""
    text = ocr_whitespace(apply_corrections(F.coalesce("text", F.lit("")), rules))
    joined = pages.join(paragraphs(ocr_lines), ["doc_id", "page_num"], "left")
    return joined.select("doc_id", "page_num", annotate_low_confidence(text, F.coalesce("confidence", F.lit(0.0)), F.col("page_num"), F.coalesce("is_low_confidence", F.lit(False))).alias("text"))


def postprocess_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages (doc_id, page_num, text) that aren't blank, joined, without lines that stand too often."""
    some = pages.where(T.strip(F.coalesce("text", F.lit(""))) != "").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("_p"))
    joined = some.select("doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n").alias("text"))
    return remove_duplicate_lines(joined).select("doc_id", ocr_whitespace(F.col("text")).alias("text"))


def remove_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DUPLICATES) -> DataFrame:
    """(id, text) without every line that stands more than ``most`` times in its document; blank lines stay."""
    rows = docs.select(F.col(id_col).alias("_id"), F.posexplode(T.lines(F.col(text_col))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    n = F.count(F.lit(1)).over(Window.partitionBy("_id", "key"))
    kept = rows.withColumn("_n", n).withColumn("_keep", (F.col("key") == "") | (F.col("_n") <= most))
    out = kept.groupBy("_id").agg(F.sort_array(F.collect_list(F.when(F.col("_keep"), F.struct("pos", "line")))).alias("_l"))
    return out.select(F.col("_id").alias(id_col), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def apply_corrections(c: Column, rules: dict[str, str]) -> Column:
    """Ordered whole-word corrections, given as pattern to replacement. The chain runs only on texts that hold
    one of the patterns' literals, as it is far dearer than the test."""
    import re

    literal = lambda p: re.sub(r"\\(.)", r"\1", p)
    chain = reduce(
        lambda out, kv: F.regexp_replace(out, rf"(?U)\b{kv[0]}\b", kv[1].replace("\\", "\\\\").replace("$", "\\$")),
        [(k, v) for k, v in rules.items() if not k.startswith("_")], c,
    )
    return F.when(T.any_contains(c, [literal(k) for k in rules if not k.startswith("_")]), chain).otherwise(c)


def paragraphs(ocr_lines: DataFrame, factor: float = 0.8, height: float = 20.0) -> DataFrame:
    """(doc_id, page_num, text): recognised lines (doc_id, page_num, line_no, text, y1, y2) as paragraphs.

    A new paragraph opens after a gap above ``factor`` of the page's mean line height, and at a heading."""
    page = Window.partitionBy("doc_id", "page_num")
    order = page.orderBy("line_no")
    real = ocr_lines.where(T.strip(F.col("text")) != "")
    mean = F.coalesce(F.avg(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))).over(page), F.lit(height))
    marked = real.withColumn("_h", mean).withColumn("_gap", F.col("y1") - F.lag("y2").over(order)).withColumn(
        "_new", F.coalesce((F.col("_gap") > F.col("_h") * factor), F.lit(True)) | is_heading(F.col("text"))
    )
    numbered = marked.withColumn("_p", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = numbered.groupBy("doc_id", "page_num", "_p").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", T.strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("_t")
    )
    return each.groupBy("doc_id", "page_num").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "\n\n").alias("text")
    )


def annotate_low_confidence(text: Column, confidence: Column, page: Column, low: Column) -> Column:
    mark = F.format_string("[LOW_CONFIDENCE: %d%% — Page %d — verify manually]\n", F.floor(confidence * 100).cast("int"), page)
    return F.when(low, F.concat(mark, text)).otherwise(text)

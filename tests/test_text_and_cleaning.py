import pytest
from pyspark.sql import functions as F

from casegrain.functions import text as T
from casegrain.operators import cleaning


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize("value,expected", [("  a   b\t", "a b"), ("", ""), (None, None), (" ", "")])
def test_collapse(spark, value, expected):
    assert one(spark, value, T.collapse) == expected


@pytest.mark.parametrize("value", ["a\nb", "a\r\nb\n", "a\x0cb", "a b", "", "\n\n", "a\n\n"])
def test_lines_as_python(spark, value):
    assert one(spark, value, T.lines) == value.splitlines()


@pytest.mark.parametrize(
    "column,value,expected",
    [
        (cleaning.remove_page_numbers, "a\n42\n- 42 -\nPage 4 of 9\n[42]\nb 42", "a\nb 42"),
        (cleaning.strip_reader_marks, "--- Page 1 of 3 ---\nx", "x"),
        (cleaning.collapse_spaces, "a \t b   \nc", "a b\nc"),
        (cleaning.collapse_blank_lines, "a\n\n \n\nb", "a\n\nb"),
        (cleaning.remove_margin_letters, "A\ntext\n H \nI", "text\nI"),
        (cleaning.ocr_whitespace, "\n a  b\n\n\n\nc ", "a b\n\nc"),
        (cleaning.clean_document, "--- Page 1 of 1 ---\n\n\nA  b\n12\n", "A b"),
        (cleaning.clean_document, "  \n", ""),
        (cleaning.clean_document, None, None),
    ],
)
def test_columns(spark, column, value, expected):
    assert one(spark, value, column) == expected


def test_repeated_edges(spark):
    pages = spark.createDataFrame([("d", i, f"RUNNING TITLE\ntext {i}\nmore {i}\nand {i}\n{i}") for i in range(1, 6)] + [("e", 1, None), ("f", 1, "only")], "doc_id string, page_num int, text string")
    assert [tuple(r) for r in cleaning.repeated_edges(pages.union(pages)).collect()] == [("d", "running title", 5)]
    out = {(r.doc_id, r.page_num): r.text for r in cleaning.remove_repeated_edges(pages).collect()}
    assert out[("d", 1)] == "text 1\nmore 1\nand 1\n1" and out[("f", 1)] == "only" and ("e", 1) not in out
    assert cleaning.repeated_edges(pages.limit(0)).count() == 0


def test_duplicate_lines(spark):
    docs = spark.createDataFrame([(1, "a\nA \na\n a\nb\n\n"), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.text for r in cleaning.remove_duplicate_lines(docs).collect()} == {1: "b\n"}


def test_corrections_in_order(spark):
    rules = {"teh": "the", "the cat": "a $cat", "_comment": "x"}
    assert one(spark, "teh cat sat", lambda c: cleaning.apply_corrections(c, rules)) == "a $cat sat"
    assert one(spark, "nothing", lambda c: cleaning.apply_corrections(c, rules)) == "nothing"


def test_paragraphs(spark):
    rows = [("d", 1, 1, "ORDER", 0, 18), ("d", 1, 2, "one", 20, 38), ("d", 1, 3, "two", 40, 58), ("d", 1, 4, " ", 60, 78), ("d", 1, 5, "three", 90, 108)]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, line_no int, text string, y1 int, y2 int")
    assert cleaning.paragraphs(df).first().text == "ORDER one two\n\nthree"

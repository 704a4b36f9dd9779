"""Overlapping word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions import text as T

SIZE, OVERLAP, LEAST = 400, 50, 30


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, chunk_index, text, word_count): windows of ``size`` words, the last ends with the text.

    Windows below ``least`` words are dropped but keep their number; null and blank texts give none.
    The words stay in one row, and each window is cut from them: no shuffle."""
    step = max(1, size - overlap)
    w = docs.select(F.col(id_col).alias("_id"), T.words(F.col(text_col)).alias("_w")).withColumn("_n", F.size("_w")).where("_n > 0")
    count = F.greatest(F.lit(1), F.ceil((F.col("_n") - size) / step).cast("int") + 1)
    return (
        w.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("_c", F.slice("_w", F.col("chunk_index") * step + 1, F.lit(size)))
        .withColumn("word_count", F.size("_c")).where(F.col("word_count") >= least)
        .select(F.col("_id").alias(id_col), "chunk_index", F.array_join("_c", " ").alias("text"), "word_count")
    )


def first_chunks(chunks: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    """The first n chunks of a case by position."""
    from pyspark.sql import Window

    return chunks.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy("chunk_index"))).where(F.col("_r") <= n).drop("_r")


def case_chunks(chunks: DataFrame, case: str = "case_id", source: str = "source_file", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """(case, texts): the texts of each case that aren't empty, in order; without a case id the source stands for it, else "unknown"."""
    key = F.coalesce(F.nullif(F.col(case), F.lit("")), F.nullif(F.col(source), F.lit("")), F.lit("unknown"))
    some = chunks.where(F.coalesce(text, F.lit("")) != "").groupBy(key.alias(case)).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("_c"))
    return some.select(case, F.transform("_c", lambda x: x["t"]).alias("texts"))


def chunks_at(chunks: DataFrame, wanted: DataFrame, row: str = "row") -> DataFrame:
    """Chunks at the asked rows (place, row), in the order of ``place``; a row that isn't there is an error."""
    found = wanted.join(chunks.withColumn("_there", F.lit(True)), row, "left")
    return found.withColumn(row, F.when(F.col("_there"), F.col(row)).otherwise(F.raise_error(F.lit("no chunk at this row")))).drop("_there")


def index_gaps(vectors: DataFrame, metadata: DataFrame, row: str = "row") -> DataFrame:
    """(row, missing): rows that only the vectors or only the metadata have; none if the two agree."""
    a, b = vectors.select(row).distinct(), metadata.select(row).distinct()
    return a.join(b, row, "left_anti").withColumn("missing", F.lit("metadata")).unionByName(b.join(a, row, "left_anti").withColumn("missing", F.lit("vectors")))

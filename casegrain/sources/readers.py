"""Readers and writers of documents, chunks, vectors and feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SELECTABLE = 50
FEEDBACK = "query string, case_id string, rating int, timestamp string, session_id string"
IMAGES = ("pdf", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp")


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, source_path, text) of the .txt files of a folder; the id is the file's stem."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return raw.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("case_id"), F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def binary_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source_path, content, format) of files that a page reader takes, whatever the case of their ending."""
    raw = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    form = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return raw.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("doc_id"), F.col("path").alias("source_path"), "content", form.alias("format")).where(F.col("format").isin(*IMAGES))


def read_pages(files: DataFrame, reader: Callable[[bytes, str], list[str]]) -> DataFrame:
    """(doc_id, page_num, mode, text, error): pages by a pluggable reader; a file that fails gives a row with its error.

    A page counts as text if it holds at least SELECTABLE characters, else as image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content, form in zip(b["doc_id"], b["content"], b["format"]):
                try:
                    rows += [(doc, i + 1, "text" if len((t or "").strip()) >= SELECTABLE else "image", t, None) for i, t in enumerate(reader(bytes(content), form))]
                except Exception as error:  # one file's failure must not end the job
                    rows.append((doc, None, None, None, f"{type(error).__name__}: {error}"))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "page_num", "mode", "text", "error"])

    return files.select("doc_id", "content", "format").mapInPandas(run, "doc_id string, page_num int, mode string, text string, error string")


def join_pages(pages: DataFrame, by: str = "\f") -> DataFrame:
    """(doc_id, text): a document's pages in order."""
    one = pages.where("text IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("_p"))
    return one.select("doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), by).alias("text"))


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """Feedback from JSON lines; malformed lines are left out."""
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path).where("case_id IS NOT NULL")


def append_feedback(df: DataFrame, path: str) -> None:
    df.select("query", "case_id", "rating", "timestamp", "session_id").write.mode("append").json(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_vectors(df: DataFrame, path: str, dim: int, mode: str = "append") -> None:
    """Appends vectors of one dimension; any other dimension fails before a row is written into the table."""
    checked = df.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"vector is not of dimension {dim}"))))
    checked.write.mode(mode).parquet(path)


def not_yet_there(new: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key the output doesn't hold yet."""
    return new.join(there.select(key).distinct(), key, "left_anti")


def embed(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], letters: int = 1000, batch: int = 1000) -> DataFrame:
    """Adds ``embedding`` by a pluggable encoder over batches of texts cut to ``letters``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "")[:letters] for t in b["text"]]
            vectors = [v for k in range(0, len(texts), batch) for v in encode(texts[k : k + batch])]
            yield b.assign(embedding=vectors)

    return chunks.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in chunks.dtypes) + ", embedding array<float>")


TEXTS = ("txt", "md", "json")


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source_path, content, format, kind, error) of every file of a folder: kind text, pages or, for endings no
    reader takes, null with an error, so that one odd file doesn't end a job."""
    raw = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    form = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(form == "txt", "text").when(form.isin(*IMAGES), "pages")
    return raw.select(
        F.regexp_replace(name, r"\.[^.]+$", "").alias("doc_id"), F.col("path").alias("source_path"), "content", form.alias("format"), kind.alias("kind"),
        F.when(kind.isNull(), F.concat(F.lit("unsupported ending: "), form)).alias("error"),
    )


def decode_uploads(files: DataFrame) -> DataFrame:
    """(name, text, error) of uploads (name, content): texts without the bytes that are no UTF-8; blank ones and other
    endings, which go to a page reader, carry an error."""
    form = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    held = F.when(form.isin(*TEXTS), text)
    error = F.when(~form.isin(*TEXTS), "not a text file").when(F.trim(F.coalesce(text, F.lit(""))) == "", "no text")
    return files.select("name", F.when(error.isNull(), held).alias("text"), error.alias("error"))


def marked_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages in order, each under the mark "--- Page i of n ---", parted by form feeds."""
    one = pages.where("page_num IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("t")))).alias("_p"), F.max("page_num").alias("_n"))
    page = F.transform("_p", lambda p: F.concat(F.format_string("--- Page %d of %d ---\n", p["page_num"], F.col("_n")), p["t"]))
    return one.select("doc_id", F.trim(F.array_join(page, "\f")).alias("text"))


def save_texts(df: DataFrame, path: str, mode: str = "append") -> None:
    """(doc_id, text) as a table."""
    df.select("doc_id", "text").write.mode(mode).parquet(path)


def read_chunks_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks kept as one JSON array; a missing file is an error."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def save_chunks_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def corrections(path: str | None) -> dict[str, str]:
    """Ordered corrections, pattern to replacement, from a JSON file; none where there is no file."""
    import json
    from pathlib import Path

    if path is None or not Path(path).exists():
        return {}
    return {k: v for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items() if not k.startswith("_")}


def case_files(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(case_id, path): the file of each wanted case from (path, stem, folder_rank).

    The stem itself first, in the order of the folders, else a stem that holds the id or stands in it, without regard to
    case. Ids lose their ending. Containment is looked up by pieces of three letters, not by comparing all with all."""
    from casegrain.operators.graph import containing

    ids = wanted.select("case_id").distinct().withColumn("_id", F.regexp_replace("case_id", r"(?i)\.(pdf|txt)$", "")).where("trim(_id) != ''")
    stems = catalogue.where("trim(coalesce(stem, '')) != ''")
    exact = ids.join(stems.withColumnRenamed("stem", "_id"), "_id").select("case_id", "path", "folder_rank", F.lit(0).alias("far"))
    names, ask = stems.select(F.col("stem").alias("name")), ids.select(F.col("_id").alias("term"))
    holds = containing(names, ask).select(F.col("term").alias("_id"), F.col("name").alias("stem"))
    inside = containing(ask.withColumnRenamed("term", "name"), names.withColumnRenamed("name", "term")).select(F.col("name").alias("_id"), F.col("term").alias("stem"))
    near = holds.unionByName(inside).distinct().join(ids, "_id").join(stems, "stem").select("case_id", "path", "folder_rank", F.lit(1).alias("far"))
    return exact.unionByName(near).groupBy("case_id").agg(F.min_by("path", F.struct("far", "folder_rank", "path")).alias("path"))


LINES = "array<struct<line_no int, text string, confidence double, x1 int, y1 int, x2 int, y2 int>>"


def fixed_engine(text: str, confidence: float = 0.95) -> Callable[[bytes], list[tuple]]:
    """A page engine that always reads one line over the whole page; for tests."""
    return lambda page: [(text, confidence, 0, 0, 1000, 1000)]


def engine_of(engines: dict[str, Callable[[bytes], list[tuple]]], preferred: list[str]) -> tuple[str, Callable[[bytes], list[tuple]]]:
    """The first of the preferred engines that is there."""
    for name in preferred:
        if name in engines:
            return name, engines[name]
    raise ValueError(f"none of the page engines {preferred} is there")


def recognise(pages: DataFrame, engine: Callable[[bytes], list[tuple]], attempt: int = 1) -> DataFrame:
    """(doc_id, page_num, attempt, lines, confidence): lines (text, confidence, x1, y1, x2, y2) of page images (doc_id, page_num,
    image), from the top and the left; a page's confidence is the mean of its lines', 0 without any. A page that fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, num, image in zip(b["doc_id"], b["page_num"], b["image"]):
                try:
                    found = sorted(engine(bytes(image)), key=lambda x: (x[3], x[2]))
                except Exception:  # one page's failure must not end the job
                    found = []
                lines = [(k, t, float(min(1.0, max(0.0, c))), *box) for k, (t, c, *box) in enumerate(found)]
                rows.append((doc, num, attempt, lines, sum(x[2] for x in lines) / len(lines) if lines else 0.0))
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "attempt", "lines", "confidence"])

    return pages.select("doc_id", "page_num", "image").mapInPandas(run, f"doc_id string, page_num int, attempt int, lines {LINES}, confidence double")


def recognised_documents(attempts: DataFrame, text_pages: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(pages, documents): of each page the best attempt as corrected paragraphs, beside the pages with a text of their own;
    documents with an image page lose lines that stand too often."""
    from casegrain.operators import cleaning, evidence

    best = evidence.best_attempt(attempts)
    lines = best.select("doc_id", "page_num", F.explode("lines").alias("_l")).select("doc_id", "page_num", "_l.*")
    marked = best.select("doc_id", "page_num", "confidence", F.col("is_low").alias("is_low_confidence"))
    read = cleaning.postprocess_pages(lines, marked, rules).join(marked, ["doc_id", "page_num"]).withColumn("mode", F.lit("ocr"))
    plain = text_pages.select("doc_id", "page_num", "text", F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("is_low_confidence"), F.lit("text").alias("mode"))
    pages = read.unionByName(plain)
    scanned = pages.where("mode = 'ocr'").select("doc_id").distinct()
    whole = cleaning.postprocess_documents(pages.join(scanned, "doc_id", "left_semi"))
    some = pages.join(scanned, "doc_id", "left_anti").where("trim(coalesce(text, '')) != ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("_p"))
    return pages, whole.unionByName(some.select("doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n").alias("text")))


def answer_with(prompts: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """(query_id, raw): a pluggable model's answer to each prompt, null where it has none or fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = []
            for p in b["prompt"]:
                try:
                    told.append(model(p))
                except Exception:  # no answer is an answer: the fallback takes its place
                    told.append(None)
            yield pd.DataFrame({"query_id": b["query_id"], "raw": told})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {dict(prompts.dtypes)['query_id']}, raw string")

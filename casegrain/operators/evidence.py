"""Evidence rows, staged rows, page statistics, conversation state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import text as T

PASSAGES, PASSAGE_LETTERS = 3, 400


def aggregate_evidence(ranked: DataFrame, meta: DataFrame, chunks: DataFrame, n: int = 5, case: str = "case_id") -> DataFrame:
    """The n best cases of each query with their metadata and first passages; a case without either has empty lists.

    Chunks are cut to the first ones per case before the join."""
    from casegrain.operators.chunking import first_chunks
    from casegrain.operators.ranking import top_n

    best = top_n(ranked, n, "query_id", "final_score", case)
    passages = first_chunks(chunks, case, PASSAGES).groupBy(case).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("relevant_chunks"))
    none = F.array().cast("array<string>")
    j = best.join(meta, case, "left").join(passages, case, "left")
    lists = ["judges", "acts", "sections", "petitioners", "respondents", "relevant_chunks"]
    return j.withColumn("court", F.coalesce(F.get("courts", F.lit(0)), F.lit(""))).withColumns({c: F.coalesce(F.col(c), none) for c in lists}).drop("courts")


def format_passages(chunks: Column) -> Column:
    """Up to three passages as bullets, cut to length; a line of its own where there is none."""
    few = F.slice(F.coalesce(chunks, F.array().cast("array<string>")), 1, PASSAGES)
    cut = F.transform(few, lambda c: F.concat(F.lit("    • "), T.strip(F.substring(c, 1, PASSAGE_LETTERS)), F.when(F.length(c) > PASSAGE_LETTERS, "...").otherwise("")))
    return F.when(F.size(few) == 0, F.lit("    (No text passages available)")).otherwise(F.array_join(cut, "\n"))


def strip_html(c: Column, by: str = "") -> Column:
    return T.strip(F.regexp_replace(c, "<[^>]+>", by))


def stage_hash(doc_id: Column, title: Column) -> Column:
    """Twelve hexadecimal digits of the hash of id and title, without case and outer space."""
    return F.substring(F.md5(F.lower(T.strip(F.concat(doc_id, F.lit(":"), title))).cast("binary")), 1, 12)


def case_key(title: Column) -> Column:
    """A key of the first six words of a title."""
    words = T.words(F.lower(F.regexp_replace(title, r"(?U)[^\w\s]", "")))
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 6), "_"), F.lit("")), F.lit("web_case"))


def latest_staged(staged: DataFrame) -> DataFrame:
    """One row for each hash: the last by staging time, with the number of times it was staged."""
    rest = [c for c in staged.columns if c != "_staging_hash"]
    return staged.groupBy("_staging_hash").agg(F.max_by(F.struct(*rest), F.struct("_staged_at", "doc_id")).alias("_v"), F.count(F.lit(1)).alias("times")).select("_staging_hash", "times", "_v.*")


def page_statistics(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, mode, avg_ocr_confidence, low_confidence_pages) over distinct pages."""
    one = pages.groupBy("doc_id", "page_num").agg(F.min("mode").alias("mode"), F.max("confidence").alias("confidence"), F.max("is_low_confidence").alias("low"))
    agg = one.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("mode") == "ocr").alias("_ocr"), F.round(F.avg(F.when(F.col("mode") == "ocr", F.col("confidence"))) + 1e-9, 4).alias("avg_ocr_confidence"),
        F.array_sort(F.collect_list(F.when(F.col("low"), F.col("page_num")))).alias("low_confidence_pages"),
    )
    mode = F.when(F.col("_ocr") == 0, "selectable").when(F.col("_ocr") == F.col("pages"), "ocr").otherwise("mixed")
    return agg.select("doc_id", "pages", mode.alias("mode"), "avg_ocr_confidence", "low_confidence_pages")


def quality_strategy(blurry: Column, low_contrast: Column, noisy: Column) -> Column:
    """gentle without a problem, aggressive with two or more, else standard; skew doesn't count."""
    problems = blurry.cast("int") + low_contrast.cast("int") + noisy.cast("int")
    return F.when(problems >= 2, "aggressive").when(problems == 0, "gentle").otherwise("standard")


def page_quality(q: Column, blur: float = 100.0, skew: float = 0.5, contrast: float = 40.0, noise: float = 0.35) -> Column:
    """struct(is_blurry, has_significant_skew, has_low_contrast, is_noisy, strategy) by a page's measures."""
    blurry, crooked, pale, noisy = q["blur_score"] < blur, F.abs(q["skew_angle"]) > skew, q["contrast_score"] < contrast, q["noise_level"] > noise
    return F.struct(
        blurry.alias("is_blurry"), crooked.alias("has_significant_skew"), pale.alias("has_low_contrast"), noisy.alias("is_noisy"), quality_strategy(blurry, pale, noisy).alias("strategy")
    )


def best_attempt(attempts: DataFrame, accept: float = 0.85) -> DataFrame:
    """Of each page the first attempt that reaches ``accept``, else the best, earliest among equals, marked low."""
    ok = F.coalesce(F.col("confidence"), F.lit(0.0)) >= accept
    w = Window.partitionBy("doc_id", "page_num").orderBy(ok.desc(), F.when(ok, F.col("attempt")), F.desc("confidence"), "attempt")
    return attempts.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("is_low", ~ok).drop("_r")


def fold_turns(turns: DataFrame, by: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """State after each turn: scalars keep the last value told, lists grow by what is new, turns are counted.

    Nulls and empty strings tell nothing. For the state after the last turn only, use ``final_state``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = {c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w) for c in scalars}
    out |= {c: F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")).over(w))) for c in lists}
    return turns.select(by, order, *[v.alias(c) for c, v in out.items()], F.count(F.lit(1)).over(w).alias("turn_count"))


def final_state(turns: DataFrame, by: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """State after the last turn of each conversation, by aggregation instead of a window."""
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    out = [F.max_by(F.when(told(c).isNotNull(), told(c)), F.when(told(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    out += [
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "").alias("v")))), lambda x: x["v"]))).alias(c)
        for c in lists
    ]
    return turns.groupBy(by).agg(*out, F.count(F.lit(1)).alias("turn_count"))


def parse_answer(c: Column, schema: str) -> Column:
    """A model's answer as a struct: code fences dropped, the whole text as JSON, else its outermost braces, else null."""
    bare = F.regexp_replace(T.strip(c), r"^```[a-z]*\n?|\n?```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(inner), schema)

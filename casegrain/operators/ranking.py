"""Ranking of cases: chunk hits to cases, fusion with graph hits, feedback, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scores.
SEMANTIC, GRAPH = 0.70, 0.30
UP, UP_CAP, DOWN, DOWN_CAP = 0.03, 0.12, 0.025, 0.10
STRONG, GRAPH_STRONG, CONFIDENT = 0.35, 0.15, 0.35
WEIGHTS = {"section": 3, "concept": 3, "act": 2, "keyword": 1}


def rank_cases(hits: DataFrame, how: str = "sum", by: str = "query_id", case: str = "case_id", score: str = "score", text: str | None = None, pos: str = "rank") -> DataFrame:
    """(by, case, score, matched_chunks, top_score[, top_chunk_text]) by sum, max or mean of a case's chunk scores.

    With ``sum`` the best score starts at 0, so a case of negative scores only has top score 0 and no text."""
    total = {"sum": F.sum(score), "max": F.max(score), "mean": F.avg(score)}[how]
    top = F.greatest(F.max(score), F.lit(0.0)) if how == "sum" else F.max(score)
    out = [F.round(total, 6).alias("score"), F.count(F.lit(1)).alias("matched_chunks"), F.round(top, 6).alias("top_score")]
    if text:
        best = F.max_by(text, F.struct(F.col(score), -F.col(pos)))
        out.append((F.when(F.max(score) > 0, best).otherwise("") if how == "sum" else best).alias("top_chunk_text"))
    return hits.groupBy(by, case).agg(*out)


def top_n(df: DataFrame, n: int, by: str = "query_id", score: str = "score", tie: str = "case_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def settled(c: Column, digits: int) -> Column:
    """Rounded, with ties of the decimal form settled upwards whatever the last bit of the double."""
    return F.round(c + 1e-9, digits)


def clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def fused(semantic: Column, graph: Column) -> Column:
    """Weighted sum where there is a graph score, else the semantic score."""
    s, g = clip(F.coalesce(semantic, F.lit(0.0))), clip(F.coalesce(graph, F.lit(0.0)))
    return settled(F.when(g > 0, SEMANTIC * s + GRAPH * g).otherwise(s), 6)


def hybrid_rank(semantic: DataFrame, graph: DataFrame, k: int = 10, by: str = "query_id", case: str = "case_id") -> DataFrame:
    """Full outer join of both hit lists on query and case, fused, the k best of each query, ties by case."""
    joined = semantic.join(graph, [by, case], "full_outer")
    scored = joined.withColumn("final_score", fused(F.coalesce("top_score", "score"), F.col("graph_score")))
    return top_n(scored, k, by, "final_score", case)


def merge_graph_hits(hits: DataFrame, by: str = "query_id", case: str = "case_id") -> DataFrame:
    """Hits (by, case, hits, match_type) to one row per case: weighted sum, parts, share of the query's best."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("match_type")), F.lit(1))
    part = lambda t: F.coalesce(F.sum(F.when(F.col("match_type").isin(t), F.col("hits"))), F.lit(0))
    merged = hits.groupBy(by, case).agg(
        F.sum(weight * F.col("hits")).alias("raw_score"), part(["act"]).alias("matched_acts"), part(["section"]).alias("matched_sections"),
        part(["keyword", "concept"]).alias("matched_keywords"),
    )
    best = F.greatest(F.max("raw_score").over(Window.partitionBy(by)), F.lit(1))
    return merged.withColumn("graph_score", F.round(F.col("raw_score") / best, 6))


def ratings(feedback: DataFrame) -> DataFrame:
    """(case_id, net): sum of ratings over all rows; null ratings and cases count not at all.

    The sum is partial before the shuffle, so a case with a tenth of all votes sends one row from each task. A log that
    may hold a vote twice is made distinct by the reader, or by ``streams.votes``."""
    return feedback.where("case_id IS NOT NULL AND rating IS NOT NULL").groupBy("case_id").agg(F.sum("rating").cast("long").alias("net"))


def boost(net: Column) -> Column:
    n = F.coalesce(net, F.lit(0))
    return F.when(n > 0, F.least(n * UP, F.lit(UP_CAP))).when(n < 0, F.greatest(n * DOWN, F.lit(-DOWN_CAP))).otherwise(0.0)


def apply_feedback(ranked: DataFrame, votes: DataFrame) -> DataFrame:
    """Adds feedback_boost, feedback_votes and lifts final_score, at most to 1."""
    j = ranked.join(votes, "case_id", "left")
    return j.withColumn("feedback_votes", F.coalesce("net", F.lit(0))).withColumn("feedback_boost", F.round(boost(F.col("net")), 4)).withColumn(
        "final_score", settled(F.least(F.col("final_score") + boost(F.col("net")), F.lit(1.0)), 6)
    ).drop("net")


def confidence(ranked: DataFrame, by: str = "query_id", final: str = "final_score", graph: str = "graph_score", tie: str = "case_id") -> DataFrame:
    """(by, confidence, confident): from the best score, its lead, the number of strong cases and the best's graph score."""
    w = Window.partitionBy(by).orderBy(F.desc(final), tie)
    top = ranked.withColumn("_r", F.row_number().over(w)).groupBy(by).agg(
        F.max(F.when(F.col("_r") == 1, F.col(final))).alias("t"), F.max(F.when(F.col("_r") == 2, F.col(final))).alias("s"),
        F.max(F.when(F.col("_r") == 1, F.col(graph))).alias("g"), F.count_if(F.col(final) > STRONG).alias("n"),
    )
    f1 = F.when(F.col("t") > STRONG, F.col("t")).otherwise(F.col("t") * 0.5)
    f2 = F.when(F.col("s").isNull(), 0.5).when(F.col("t") > STRONG, F.least((F.col("t") - F.col("s")) * 2, F.lit(1.0))).otherwise(0.2)
    f3, f4 = F.least(F.col("n") / 3, F.lit(1.0)), F.when(F.col("g") > GRAPH_STRONG, 1.0).otherwise(0.5)
    c = settled(F.least(0.5 * f1 + 0.2 * f2 + 0.2 * f3 + 0.1 * f4, F.lit(1.0)), 4)
    return top.select(by, c.alias("confidence")).withColumn("confident", F.col("confidence") >= CONFIDENT)

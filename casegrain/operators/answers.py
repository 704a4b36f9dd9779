"""From ranked cases to an answer: the gate between own and web evidence, the prompt, the answer and its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.operators.evidence import format_passages, parse_answer
from casegrain.operators.ranking import CONFIDENT

OWN, WEB = "permanent_kg", "web_retrieved"
OWN_ROWS, OWN_BESIDE_WEB = 5, 2
LANGUAGES = {
    "ta": "Tamil", "ta_roman": "Tanglish (Tamil in Roman script)", "hi": "Hindi", "hi_roman": "Hinglish (Hindi in Roman script)", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam",
}
ANSWER = "summary string, what_to_do string, applicable_acts array<string>, applicable_sections array<string>, disclaimer string, precedents array<struct<case: string, case_id: string, url: string, held: string>>"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def web_evidence(web: DataFrame) -> DataFrame:
    """Web rows as evidence: one passage, the row's own score, no graph score; missing fields have defaults."""
    none = F.array().cast("array<string>")
    text = F.coalesce("text_excerpt", F.lit(""))
    return web.select(
        "query_id", F.coalesce("doc_id", F.lit("web_case")).alias("case_id"), F.coalesce("title", F.lit("")).alias("case_name"), F.coalesce("date", F.lit("")).alias("decision_date"),
        F.coalesce("court", F.lit("")).alias("court"), none.alias("judges"), _list("acts").alias("acts"), _list("sections").alias("sections"), none.alias("petitioners"), none.alias("respondents"),
        F.coalesce("relevance_score", F.lit(0.5)).alias("semantic_score"), F.lit(0.0).alias("graph_score"), F.coalesce("relevance_score", F.lit(0.5)).alias("final_score"),
        F.array(text).alias("relevant_chunks"), text.alias("top_chunk_text"), F.lit(WEB).alias("source"), F.coalesce("url", F.lit("")).alias("source_url"),
    )


def gated(evidence: DataFrame, confidence: DataFrame, web: DataFrame) -> DataFrame:
    """Evidence of each query of ``confidence``, numbered: the five best own rows where confidence reaches the threshold,
    else the two best and then the web rows. ``knowledge_source`` says which it is.

    ``evidence`` has ``rank`` within its query, ``web`` the columns of ``web_evidence`` and ``place``."""
    sure = F.col("confidence") >= CONFIDENT
    own = evidence.join(confidence.select("query_id", "confidence"), "query_id").where(F.col("rank") <= F.when(sure, OWN_ROWS).otherwise(OWN_BESIDE_WEB))
    beside = web.withColumnRenamed("place", "rank").join(confidence.where(~sure).select("query_id", "confidence"), "query_id")
    cols = [c for c in own.columns if c in beside.columns]
    both = own.select(*cols, F.lit(0).alias("_s")).unionByName(beside.select(*cols, F.lit(1).alias("_s")))
    w = Window.partitionBy("query_id")
    has_own = F.max(F.when(F.col("_s") == 0, 1).otherwise(0)).over(w) == 1
    source = F.when(sure, OWN).when(has_own, "hybrid").otherwise("temporary_pool")
    return both.withColumn("knowledge_source", source).withColumn("rank", F.row_number().over(w.orderBy("_s", "rank", "case_id"))).drop("_s")


def sources(evidence: DataFrame) -> DataFrame:
    """(query_id, source, acts, sections): where a query's evidence comes from, and the sorted union of its acts and sections."""
    own, web = F.bool_or(F.col("source") == OWN), F.bool_or(F.col("source") == WEB)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(_list(c))))))
    return evidence.groupBy("query_id").agg(F.when(own & web, "hybrid").when(web, "temporary_pool").otherwise(OWN).alias("source"), union("acts").alias("acts"), union("sections").alias("sections"))


def prompts(queries: DataFrame, evidence: DataFrame, header: str = "", footer: str = "", context: Column | None = None) -> DataFrame:
    """(query_id, prompt): header, note on the language, conversation, the query, its numbered cases, footer.

    ``context`` is a column of ``queries`` with the conversation's summary. A query without evidence says so."""
    or_else = lambda c, n, other: F.coalesce(F.nullif(F.array_join(F.slice(F.array_compact(_list(c)), 1, n), ", "), F.lit("")), F.lit(other))
    some = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other if isinstance(other, Column) else F.lit(other))
    block = F.concat_ws(
        "\n", F.concat(F.lit("Case "), F.col("rank").cast("string"), F.lit(": "), some("case_name", F.col("case_id"))), F.concat(F.lit("Court: "), some("court", "Supreme Court of India")),
        F.concat(F.lit("Date: "), some("decision_date", "Unknown")), F.concat(F.lit("Acts: "), or_else("acts", 1000, "Not specified")), F.concat(F.lit("Sections: "), or_else("sections", 1000, "Not specified")),
        F.concat(F.lit("Judges: "), or_else("judges", 3, "Not specified")), F.concat(F.lit("Petitioners: "), or_else("petitioners", 2, "Not specified")),
        F.concat(F.lit("Respondents: "), or_else("respondents", 2, "Not specified")), F.concat(F.lit("Passages:\n"), format_passages(F.col("relevant_chunks"))),
    )
    cases = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("_cases"))
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.coalesce("detected_language", F.lit("en")))
    asked = F.concat_ws(
        "\n", F.concat(F.lit("Query: "), F.coalesce("original_query", F.lit(""))), F.concat(F.lit("Domain: "), F.coalesce("legal_domain", F.lit(""))),
        F.concat(F.lit("Incident: "), F.coalesce("incident_type", F.lit(""))), F.concat(F.lit("Acts: "), or_else("suggested_acts", 1000, "Not identified")),
        F.concat(F.lit("Sections: "), or_else("suggested_sections", 1000, "Not identified")), F.concat(F.lit("Concepts: "), or_else("expanded_concepts", 5, "Not identified")),
    )
    found = F.when(F.col("_n").isNull(), F.lit("No evidence found.")).otherwise(F.concat(F.lit("Evidence ("), F.col("_n").cast("string"), F.lit("):\n"), F.col("_cases")))
    parts = [F.nullif(F.lit(header), F.lit("")), F.when(name.isNotNull(), F.concat(F.lit("Answer in "), name))]
    parts += [F.concat(F.lit("Conversation: "), context)] if context is not None else []
    return queries.join(cases, "query_id", "left").select("query_id", F.concat_ws("\n", *parts, asked, found, F.nullif(F.lit(footer), F.lit(""))).alias("prompt"))


def fallback(cases: Column, incident: Column, acts: Column, sections: Column) -> Column:
    """The JSON answer where no model gives one; texts are escaped."""
    told = F.concat(F.coalesce(cases, F.lit(0)).cast("string"), F.lit(" relevant case(s) found for "), F.coalesce(incident, F.lit("the query")))
    return F.to_json(F.struct(told.alias("summary"), acts.alias("applicable_acts"), sections.alias("applicable_sections"), F.array().cast("array<string>").alias("precedents")))


def assemble(answers: DataFrame, evidence: DataFrame, disclaimer: str = "") -> DataFrame:
    """Answers (query_id, raw), raw a model's text or null, with what they leave out taken from the evidence.

    Precedents are linked to evidence by case id, else by case name, else by their place; without any the evidence
    itself gives them. ``precedents`` has (place, case_id, case, linked); a precedent that fits nothing keeps its own id."""
    base = answers.join(sources(evidence), "query_id", "left").withColumn("_a", parse_answer(F.col("raw"), ANSWER))
    given = base.where(F.size("_a.precedents") > 0).select("query_id", F.posexplode("_a.precedents").alias("place", "_p")).select(
        "query_id", (F.col("place") + 1).alias("place"), F.col("_p.case_id").alias("told_id"), F.col("_p.case").alias("told_name"))
    e = evidence.select("query_id", "rank", "case_id", "case_name")
    once = lambda key: e.where(F.coalesce(key, F.lit("")) != "").groupBy("query_id", key).agg(F.min(F.struct("rank", F.col("case_id").alias("id"))).alias(f"_by_{key}"))
    linked = (
        given.join(once("case_id").withColumnRenamed("case_id", "told_id"), ["query_id", "told_id"], "left").join(once("case_name").withColumnRenamed("case_name", "told_name"), ["query_id", "told_name"], "left")
        .join(e.select("query_id", F.col("rank").alias("place"), F.col("case_id").alias("_by_place")), ["query_id", "place"], "left")
        .select("query_id", "place", F.coalesce("_by_case_id.id", "_by_case_name.id", "_by_place", "told_id").alias("case_id"), "told_name", F.coalesce("_by_case_id.id", "_by_case_name.id", "_by_place").isNotNull().alias("linked"))
        .groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "case_id", F.col("told_name").alias("case"), "linked"))).alias("_linked"))
    )
    own = e.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("place"), "case_id", F.coalesce(F.nullif("case_name", F.lit("")), "case_id").alias("case"), F.lit(True).alias("linked")))).alias("_own"))
    told = lambda field, other: F.when(F.size(F.col("_a")[field]) > 0, F.col("_a")[field]).otherwise(_list(other))
    return base.join(linked, "query_id", "left").join(own, "query_id", "left").select(
        "query_id", F.coalesce("_a.summary", F.lit("Insufficient evidence found.")).alias("summary"), F.coalesce("_a.what_to_do", F.lit("")).alias("what_to_do"),
        told("applicable_acts", "acts").alias("applicable_acts"), told("applicable_sections", "sections").alias("applicable_sections"), F.coalesce("_linked", "_own").alias("precedents"),
        F.coalesce("source", F.lit(OWN)).alias("knowledge_source"), F.coalesce("_a.disclaimer", F.lit(disclaimer)).alias("disclaimer"),
    )

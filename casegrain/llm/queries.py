"""The queries of the nine problems, over whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions.text import WS
from casegrain.llm import canonical, charforms, entities, languages, packing, scans, sentences, splitting, tokens
from casegrain.sources.tables import table


#: White space in the syntax of the other engine.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(table(spark, root, "document_results"))


def p1_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the pieces: without what they repeat they give the text again, and none is over its limits."""
    fresh = F.expr("substring(piece, fresh - start + 1)")
    return p1_pieces(spark, root).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("piece_no", fresh.alias("t")))).alias("_p"), F.bool_and(F.expr("end - start <= 2400 AND fresh - start <= 200")).alias("within"),
        (F.count(F.lit(1)) > 1).alias("parted"),
    ).select("doc_id", F.md5(F.array_join(F.transform("_p", lambda x: x["t"]), "").cast("binary")).alias("digest"), "within", "parted")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_pieces(spark, root).where("piece_no = 1").select("doc_id").distinct()


def _typed(spark: SparkSession, root: str) -> DataFrame:
    evidence, queries = table(spark, root, "case_evidence"), table(spark, root, "legal_queries")
    none = F.lit(False)
    return (
        evidence.select(F.lit("evidence_acts").alias("field"), F.col("evidence_id").alias("row_id"), F.posexplode("acts").alias("pos", "typed"), none.alias("is_court"))
        .unionByName(evidence.select(F.lit("evidence_court").alias("field"), F.col("evidence_id").alias("row_id"), F.lit(0).alias("pos"), F.col("court").alias("typed"), F.lit(True).alias("is_court")))
        .unionByName(queries.select(F.lit("query_acts").alias("field"), F.col("query_id").alias("row_id"), F.posexplode("suggested_acts").alias("pos", "typed"), none.alias("is_court")))
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    acts, courts = table(spark, root, "ref_acts"), table(spark, root, "ref_courts")
    names = acts.select(F.col("canonical_name").alias("typed"), F.lit(False).alias("is_court")).unionByName(
        courts.select(F.col("canonical_name").alias("typed"), F.lit(True).alias("is_court"))
    )
    typed = _typed(spark, root).join(F.broadcast(names), ["typed", "is_court"], "left_anti")
    return canonical.map_values(typed, acts, courts).select("field", "row_id", "pos", "ref_id").distinct()


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return entities.variant_pairs(entities.resolve(entities.names_of(table(spark, root, "case_evidence"))))


def p3_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Membership instead of pairs: each string with the smallest string of its cluster."""
    r = entities.resolve(entities.names_of(table(spark, root, "case_evidence")))
    return r.join(r.groupBy("kind", "cluster").agg(F.min("name").alias("representative")), ["kind", "cluster"]).select("kind", "name", "representative")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "legal_queries")
    content = languages.learn(languages.dictionaries(table(spark, root, "documents")), asked, "original_query")
    told = languages.classify_texts(asked.select("query_id", "original_query", "detected_language"), "query_id", "original_query", content)
    wrong = told.join(asked.select("query_id", "detected_language"), "query_id").where(
        "accepted AND NOT (detected_language <=> lang)"
    )
    mixed = languages.mixed_texts(languages.text_languages(table(spark, root, "document_results"), "doc_id", "text", content), "doc_id")
    return (
        wrong.select(F.lit("query").alias("src"), F.col("query_id").cast("string").alias("row_key"), "lang")
        .unionByName(mixed.select(F.lit("result").alias("src"), F.col("doc_id").alias("row_key"), "lang"))
        .distinct()
    )


def p4_stretches(spark: SparkSession, root: str) -> DataFrame:
    content = languages.dictionaries(table(spark, root, "documents"))
    return languages.text_languages(table(spark, root, "document_results"), "doc_id", "text", content)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.find(table(spark, root, "page_details"), table(spark, root, "documents").select(F.col("text").alias("_text")))


def p5_texts(spark: SparkSession, root: str) -> DataFrame:
    return scans.repair(table(spark, root, "page_details"), table(spark, root, "documents").select(F.col("text").alias("_text")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    staged = charforms.same_look(table(spark, root, "staged_cases"), "doc_id", "text_excerpt")
    results = charforms.same_look(table(spark, root, "document_results"), "doc_id", "text")
    return staged.select(F.lit("staged").alias("src"), "*").unionByName(results.select(F.lit("result").alias("src"), "*"))


def p6_classes(spark: SparkSession, root: str) -> DataFrame:
    """Membership instead of pairs: each document with the representative of its class."""
    staged = charforms.look_classes(table(spark, root, "staged_cases"), "doc_id", "text_excerpt")
    results = charforms.look_classes(table(spark, root, "document_results"), "doc_id", "text")
    return staged.select(F.lit("staged").alias("src"), "*").unionByName(results.select(F.lit("result").alias("src"), "*"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, root, "documents"))


def p7_decoded(spark: SparkSession, root: str) -> DataFrame:
    return tokens.decode_corpus(p7_ids(spark, root))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents"))


def p8_placed(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the containers: each document is in one, unless it exceeds the capacity alone, and none is overfull."""
    placed = p8_containers(spark, root)
    full = placed.groupBy("container").agg((F.sum("piece_size") <= packing.CAPACITY).alias("_fits"))
    return placed.join(full, "container").groupBy("doc_id").agg(
        ((F.count(F.lit(1)) == 1) | (F.sum("piece_size") > packing.CAPACITY)).alias("whole"), F.bool_and("_fits").alias("fits"))


def p9_covered(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the sentences: together they hold all of a text but white space, in order."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    parts = p9_found(spark, root).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_start", "sent_end"))).alias("_s"))
    whole = F.array_join(F.transform("_s", lambda x: F.substring("text", x["sent_start"] + 1, x["sent_end"] - x["sent_start"])), "")
    return parts.join(docs, "doc_id").select("doc_id", F.md5(F.regexp_replace(whole, WS, "").cast("binary")).alias("digest"), F.size("_s").alias("_n")).drop("_n")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(table(spark, root, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rebuilt": p1_rebuilt, "p2_found": p2_found, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p4_stretches": p4_stretches, "p5_found": p5_found, "p5_texts": p5_texts, "p6_found": p6_found, "p6_classes": p6_classes, "p7_ids": p7_ids,
        "p7_decoded": p7_decoded, "p8_containers": p8_containers, "p8_placed": p8_placed, "p9_found": p9_found, "p9_covered": p9_covered,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT doc_id FROM document_results WHERE length(text) > 2400",
        "p1_rebuilt": "SELECT doc_id, md5(text) AS digest, true AS within, length(text) > 2400 AS parted FROM document_results WHERE coalesce(text, '') <> ''",
        "p8_placed": f"SELECT doc_id, true AS whole, true AS fits FROM documents WHERE regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g') <> ''",
        "p9_covered": f"SELECT doc_id, md5(regexp_replace(text, '{_WHITE}', '', 'g')) AS digest FROM documents WHERE regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g') <> ''",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }

"""All queries over the dataset tables, each with its SQL counterpart for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.functions import text as T
from casegrain.operators import chunking, cleaning, evidence, extraction, graph, ranking, understanding, vectors
from casegrain.sources.tables import table
from casegrain.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The class of white space and the line ends, in the syntax of the other engine.
WS2 = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE2 = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _lines2(c: str) -> str:
    return f"(CASE WHEN string_split_regex({c}, '{{LINE}}')[-1] = '' THEN string_split_regex({c}, '{{LINE}}')[:-2] ELSE string_split_regex({c}, '{{LINE}}') END)"


def _strip2(c: str) -> str:
    return f"regexp_replace({c}, '^{{WS}}+|{{WS}}+$', '', 'g')"


def _collapse2(c: str) -> str:
    return _strip2(f"regexp_replace({c}, '{{WS}}+', ' ', 'g')")


_RESULTS = "(SELECT doc_id, text FROM document_results)"
_EVIDENCE = "(SELECT DISTINCT evidence_id, query_id, rank, case_id, case_name, decision_date, court, judges, acts, sections, petitioners, respondents, semantic_score, graph_score, final_score, relevant_chunks, top_chunk_text, source, source_url FROM case_evidence)"


def _evidence(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "case_evidence").distinct()


def _one(column: Callable, name: str = "text") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: table(spark, root, "document_results").select("doc_id", column(F.col("text")).alias(name))


# ------------------------------------------------------------------ cleaning

QUERIES["clean_reader_marks"] = _one(cleaning.strip_reader_marks)
SQL["clean_reader_marks"] = f"SELECT doc_id, array_to_string(list_filter({_lines2('text')}, lambda x: NOT regexp_matches({_strip2('x')}, '(?i)^---\\s*page\\s+\\d+\\s+of\\s+\\d+\\s*---$')), chr(10)) AS text FROM document_results"
QUERIES["clean_spaces"] = _one(cleaning.collapse_spaces)
SQL["clean_spaces"] = f"SELECT doc_id, array_to_string(list_transform({_lines2("regexp_replace(replace(text, chr(9), ' '), ' {2,}', ' ', 'g')")}, lambda x: regexp_replace(x, '{{WS}}+$', '')), chr(10)) AS text FROM document_results"
QUERIES["clean_blank_lines"] = _one(cleaning.collapse_blank_lines)
SQL["clean_blank_lines"] = "SELECT doc_id, regexp_replace(text, '(\\n[ \\t]*){2,}', chr(10) || chr(10), 'g') AS text FROM document_results"
QUERIES["clean_page_numbers"] = _one(cleaning.remove_page_numbers)
SQL["clean_page_numbers"] = f"SELECT doc_id, array_to_string(list_filter({_lines2('text')}, lambda x: NOT regexp_matches({_strip2('x')}, '^(\\p{{Nd}}+|-\\s*\\p{{Nd}}+\\s*-|(?i:page)\\s+\\p{{Nd}}+(\\s+(?i:of)\\s+\\p{{Nd}}+)?|\\[\\s*\\p{{Nd}}+\\s*\\])$')), chr(10)) AS text FROM document_results"
QUERIES["clean_margin_letters"] = _one(cleaning.remove_margin_letters)
SQL["clean_margin_letters"] = f"SELECT doc_id, array_to_string(list_filter({_lines2('text')}, lambda x: NOT regexp_matches(x, '^\\s*[A-H]\\s*$') AND NOT regexp_matches(x, '^\\s*---\\s*Page\\s+\\p{{Nd}}+')), chr(10)) AS text FROM document_results"
QUERIES["clean_ocr_whitespace"] = _one(cleaning.ocr_whitespace)
SQL["clean_ocr_whitespace"] = f"SELECT doc_id, {_strip2("regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')")} AS text FROM document_results"
QUERIES["clean_document"] = _one(cleaning.clean_document)

_PAGE_LINES = (
    "one AS (SELECT DISTINCT doc_id, page_num, text FROM page_details), l AS (SELECT doc_id, page_num, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM "
    f"(SELECT doc_id, page_num, {_lines2('text')} AS ls FROM one)), k AS (SELECT *, lower({_collapse2('line')}) AS key FROM l)"
)
_EDGES = (
    _PAGE_LINES + ", e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY pos) AS t, count(*) OVER (PARTITION BY doc_id, page_num) AS n FROM k WHERE key <> ''), "
    "d AS (SELECT DISTINCT doc_id, page_num, key FROM e WHERE t <= 3 OR (n > 3 AND n - t < 3)), p AS (SELECT doc_id, count(DISTINCT page_num) AS np FROM page_details GROUP BY 1), "
    "r AS (SELECT d.doc_id, key, count(*) AS pages FROM d JOIN p USING (doc_id) GROUP BY d.doc_id, key, np HAVING count(*) >= greatest(2, floor(np * 0.4)))"
)


@query(f"WITH {_EDGES} SELECT doc_id, key, pages FROM r")
def repeated_headers(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.repeated_edges(table(spark, root, "page_details"))


@query(
    f"WITH {_EDGES}, kept AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = k.doc_id AND r.key = k.key)) "
    "SELECT a.doc_id, a.page_num, coalesce(string_agg(kept.line, chr(10) ORDER BY kept.pos), '') AS text FROM (SELECT DISTINCT doc_id, page_num FROM k) a "
    "LEFT JOIN kept USING (doc_id, page_num) GROUP BY 1, 2"
)
def pages_without_headers(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.remove_repeated_edges(table(spark, root, "page_details"))


@query(
    f"WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, {_lines2('text')} AS ls FROM document_results)), "
    f"k AS (SELECT *, lower({_collapse2('line')}) AS key FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM k) "
    "SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key = '' OR c <= 3), '') AS text FROM n GROUP BY doc_id"
)
def without_duplicate_lines(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.remove_duplicate_lines(table(spark, root, "document_results"))


def _ocr_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines with boxes: 18 high, 20 apart, so that a blank line leaves a gap."""
    rows = cleaning.page_lines(table(spark, root, "page_details").where("mode = 'ocr'"))
    return rows.where("key != ''").select("doc_id", "page_num", F.col("pos").alias("line_no"), F.col("line").alias("text"), (F.col("pos") * 20).alias("y1"), (F.col("pos") * 20 + 18).alias("y2"))


@query()
def ocr_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.paragraphs(_ocr_lines(spark, root))


@query(
    "WITH one AS (SELECT DISTINCT doc_id, page_num, text, confidence, is_low_confidence FROM page_details) SELECT doc_id, page_num, CASE WHEN is_low_confidence THEN "
    "'[LOW_CONFIDENCE: ' || CAST(CAST(floor(confidence * 100) AS INT) AS VARCHAR) || '% — Page ' || page_num || ' — verify manually]' || chr(10) || text ELSE text END AS text FROM one"
)
def annotated_pages(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "page_details").select("doc_id", "page_num", "text", "confidence", "is_low_confidence").distinct()
    return one.select("doc_id", "page_num", cleaning.annotate_low_confidence(F.col("text"), F.col("confidence"), F.col("page_num"), F.coalesce("is_low_confidence", F.lit(False))).alias("text"))


@query(
    "WITH one AS (SELECT doc_id, page_num, min(mode) AS mode, max(confidence) AS confidence, bool_or(is_low_confidence) AS low FROM page_details GROUP BY 1, 2) "
    "SELECT doc_id, count(*) AS pages, CASE WHEN count(*) FILTER (mode = 'ocr') = 0 THEN 'selectable' WHEN count(*) FILTER (mode = 'ocr') = count(*) THEN 'ocr' ELSE 'mixed' END AS mode, "
    "round(avg(confidence) FILTER (mode = 'ocr') + 1e-9, 4) AS avg_ocr_confidence, coalesce(string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) FILTER (low), '') AS low_pages FROM one GROUP BY doc_id"
)
def ocr_document_statistics(spark: SparkSession, root: str) -> DataFrame:
    s = evidence.page_statistics(table(spark, root, "page_details"))
    return s.select("doc_id", "pages", "mode", "avg_ocr_confidence", F.array_join(F.transform("low_confidence_pages", lambda x: x.cast("string")), ",").alias("low_pages"))


@query(
    "SELECT DISTINCT doc_id, page_num, CASE WHEN p >= 2 THEN 'aggressive' WHEN p = 0 THEN 'gentle' ELSE 'standard' END AS strategy FROM (SELECT doc_id, page_num, "
    "CAST(quality_report.is_blurry AS INT) + CAST(quality_report.has_low_contrast AS INT) + CAST(quality_report.is_noisy AS INT) AS p FROM page_details WHERE quality_report IS NOT NULL)"
)
def preprocessing_strategy(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("quality_report")
    return table(spark, root, "page_details").where(q.isNotNull()).select(
        "doc_id", "page_num", evidence.quality_strategy(q["is_blurry"], q["has_low_contrast"], q["is_noisy"]).alias("strategy")
    ).distinct()


@query(
    "WITH a AS (SELECT DISTINCT doc_id, page_num, unnest([1, 2, 3]) AS attempt, unnest([confidence, confidence * 1.1, confidence * 1.05]) AS confidence FROM page_details WHERE mode = 'ocr'), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY (coalesce(confidence, 0) >= 0.85) DESC, CASE WHEN coalesce(confidence, 0) >= 0.85 THEN attempt END ASC NULLS FIRST, confidence DESC NULLS LAST, attempt) AS k FROM a) "
    "SELECT doc_id, page_num, CAST(attempt AS INT) AS attempt, NOT coalesce(confidence, 0) >= 0.85 AS is_low FROM r WHERE k = 1"
)
def ocr_best_attempt(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "page_details").where("mode = 'ocr'").select("doc_id", "page_num", "confidence").distinct()
    c = F.col("confidence")
    rows = pages.select("doc_id", "page_num", F.posexplode(F.array(c, c * 1.1, c * 1.05)).alias("attempt", "confidence")).withColumn("attempt", F.col("attempt") + 1)
    return evidence.best_attempt(rows).select("doc_id", "page_num", "attempt", "is_low")


# ------------------------------------------------------------------ extraction

_HEAD = "substr(text, 1, 3000)"


@query(
    "WITH f AS (SELECT doc_id, unnest(regexp_extract_all(" + _HEAD + ", '\\b(?:s\\.\\s*[0-9]+[A-Za-z0-9_().,/]*|[Ss]ections?\\s+[0-9]+[A-Za-z0-9_().,/]*|[Aa]rts?\\.?\\s+[0-9]+[A-Za-z0-9_().,/]*|[Cc]lauses?\\s+[0-9]+[A-Za-z0-9_().,/]*|[Rr]ules?\\s+[0-9]+[A-Za-z0-9_().,/]*)')) AS m FROM document_results), "
    "g AS (SELECT doc_id, CASE WHEN regexp_matches(m, '^[Aa]rt') THEN 'Article' WHEN regexp_matches(m, '^[Cc]l') THEN 'Clause' WHEN regexp_matches(m, '^[Rr]') THEN 'Rule' ELSE 'Section' END AS type, regexp_extract(m, '([0-9]+[A-Za-z0-9_().,/]*)$', 1) AS number FROM f) "
    "SELECT DISTINCT doc_id, type, number FROM g UNION SELECT doc_id, 'Section', unnest(regexp_extract_all(" + _HEAD + ", '(?:பிரிவு|சட்டம்)\\s+([0-9]+[A-Za-z]?)', 1)) FROM document_results"
)
def extracted_sections(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "document_results")
    return d.select("doc_id", F.explode(extraction.sections(extraction.headnote(F.col("text")))).alias("s")).select("doc_id", "s.type", "s.number")


@query(
    "WITH f AS (SELECT doc_id, unnest(regexp_extract_all(" + _HEAD + ", '[A-Z][A-Za-z\\s&,()]+?(?:Act|Code|Rules|Regulations?|Constitution|Ordinance|Order|Statute)(?:[,\\s]+(?:of\\s+)?[0-9]{4})?')) AS m FROM document_results), "
    f"g AS (SELECT doc_id, {_collapse2('m')} AS m FROM f), h AS (SELECT doc_id, regexp_replace(regexp_replace(m, ',?\\s*(?:of\\s+)?[0-9]{{4}}$', ''), '[ ,]+$', '') AS name, regexp_extract(m, '([0-9]{{4}})$', 1) AS y FROM g) "
    "SELECT DISTINCT doc_id, name, CAST(y AS INT) AS year FROM h WHERE y <> '' AND length(name) >= 5 UNION "
    + " UNION ".join(f"SELECT doc_id, '{n}', {y} FROM document_results WHERE contains({_HEAD}, '{w}')" for w, n, y in extraction.TAMIL_STATUTES)
)
def extracted_acts(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "document_results")
    return d.select("doc_id", F.explode(extraction.acts(extraction.headnote(F.col("text")))).alias("a")).select("doc_id", "a.name", "a.year")


@query(
    "SELECT DISTINCT doc_id, " + _collapse2("m") + " AS citation FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:\\[[0-9]{4}\\]\\s+[0-9]+\\s+S\\.?C\\.?R\\.?\\s+[0-9]+|\\([0-9]{4}\\)\\s+[0-9]+\\s+SCC\\s+[0-9]+|[0-9]{4}\\s+AIR\\s+[0-9]+|AIR\\s+[0-9]{4}\\s+SC\\s+[0-9]+|\\([0-9]{4}\\)\\s+[0-9]+\\s+SCR\\s+[0-9]+|\\[[0-9]{4}\\]\\s+[0-9]+\\s+SCR\\s+[0-9]+)')) AS m FROM "
    "(SELECT doc_id, text || ' [2014] 14 SCR ' || length(text) || ' and AIR 2001 SC 12' AS text FROM document_results))"
)
def extracted_citations(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "document_results").where("text IS NOT NULL")
    cited = F.concat(F.col("text"), F.lit(" [2014] 14 SCR "), F.length("text").cast("string"), F.lit(" and AIR 2001 SC 12"))
    return d.select("doc_id", F.explode(extraction.citations(cited)).alias("citation")).distinct()


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 6000), '\\[?[0-9]{4}\\]?\\s+[0-9]+\\s+S\\.C\\.R\\.') OR regexp_matches(substr(text, 1, 6000), '(?i)SUPREME COURT REPORTS') OR regexp_matches(substr(text, 1, 6000), 'உச்ச\\s*நீதிமன்றம்|உ&ச\\s*ntம|ePjpkd;wk;') THEN 'Supreme Court of India' "
    + " ".join(f"WHEN contains(lower({_HEAD}), '{c.lower()}') THEN '{c}'" for c in extraction.COURTS) + " ELSE '' END AS court FROM document_results"
)
def extracted_court(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_results").select("doc_id", extraction.court(F.col("text")).alias("court"))


@query(
    "SELECT doc_id, c AS concept FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, '{cid}' AS c FROM document_results WHERE " + " OR ".join(f"contains(lower(substr(text, 1, 3000) || ' ' || substr(text, 1, 4000)), '{w}')" for w in words)
        for cid, _, _, words, _ in extraction.CONCEPTS) + ")"
)
def extracted_concepts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_results").select("doc_id", F.explode(extraction.concepts(F.col("text"))).alias("concept"))


def _headnotes(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "case_evidence").select("evidence_id", "petitioners", "respondents").distinct().where("get(petitioners, 0) IS NOT NULL AND get(respondents, 0) IS NOT NULL")
    line = lambda c: T.collapse(F.get(c, F.lit(0)))
    text = F.concat(
        F.lit("[2022] 1 S.C.R. "), F.col("evidence_id").cast("string"), F.lit("\n"), line("petitioners"), F.lit("\nv.\n"), line("respondents"),
        F.lit("\n(Civil Appeal No. 42 of 2020)\nJANUARY 07, 2022\n[A. B. GAMMA, CJI AND C. D. DELTA, JJ.]"),
    )
    return e.select("evidence_id", text.alias("text"))


@query(
    "WITH e AS (SELECT DISTINCT evidence_id, petitioners, respondents FROM case_evidence WHERE len(petitioners) > 0 AND len(respondents) > 0 AND petitioners[1] IS NOT NULL AND respondents[1] IS NOT NULL), "
    f"n AS (SELECT evidence_id, {_collapse2('petitioners[1]')} AS p, {_collapse2('respondents[1]')} AS r FROM e) "
    "SELECT evidence_id, CASE WHEN p <> '' AND NOT regexp_matches(p, '^[0-9]+$') THEN p ELSE '' END AS petitioner, CASE WHEN starts_with(r, '(') THEN '' WHEN r = '' THEN '' ELSE r END AS respondent, '2022-01-07' AS decision_date, 'A. B. GAMMA|C. D. DELTA' AS judges FROM n"
)
def extracted_headnotes(spark: SparkSession, root: str) -> DataFrame:
    h = F.col("text")
    p = extraction.parties(h)
    return _headnotes(spark, root).select(
        "evidence_id", p["petitioner"].alias("petitioner"), p["respondent"].alias("respondent"), extraction.decision_date(h).alias("decision_date"),
        F.array_join(extraction.judges(h), "|").alias("judges"),
    )


# ------------------------------------------------------------------ chunks and vectors


@query(
    "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(0, len(w), 350)) AS st FROM w WHERE len(w) > 0), "
    "c AS (SELECT doc_id, st // 350 AS chunk_index, w[st + 1 : st + 400] AS c FROM s JOIN (SELECT 1) ON st = 0 OR st + 50 < len(w)) "
    "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, md5(array_to_string(c, ' ')) AS digest, CAST(len(c) AS INT) AS word_count FROM c WHERE len(c) >= 30"
)
def chunked_documents(spark: SparkSession, root: str) -> DataFrame:
    c = chunking.chunk(table(spark, root, "documents"))
    return c.select("doc_id", "chunk_index", F.md5("text").alias("digest"), "word_count")


_TOPK = (
    "WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, label, round(list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20)"
)


def _hits(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    hits = vectors.top_k(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20)
    return hits.join(e.select("vec_id", "label"), "vec_id").withColumnRenamed("label", "case_id")


@query(_TOPK + " SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM t")
def vector_top_k(spark: SparkSession, root: str) -> DataFrame:
    return _hits(spark, root).select("query_id", "vec_id", "score", "rank")


def _ranked(how: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        hits = _hits(spark, root).withColumn("text", F.col("vec_id").cast("string"))
        return ranking.rank_cases(hits, how, text="text").select("query_id", "case_id", "score", "matched_chunks", "top_score", "top_chunk_text")

    return run


for _how, _fn in (("sum", "sum"), ("max", "max"), ("mean", "avg")):
    QUERIES[f"rank_cases_by_{_how}"] = _ranked(_how)
    _top = "greatest(max(score), 0.0)" if _how == "sum" else "max(score)"
    _text = "arg_max(vec_id, {'a': score, 'b': -rank})"
    SQL[f"rank_cases_by_{_how}"] = _TOPK + (
        f" SELECT query_id, label AS case_id, round({_fn}(score), 6) AS score, count(*) AS matched_chunks, round({_top}, 6) AS top_score, "
        + (f"CASE WHEN max(score) > 0 THEN CAST({_text} AS VARCHAR) ELSE '' END" if _how == "sum" else f"CAST({_text} AS VARCHAR)") + " AS top_chunk_text FROM t GROUP BY query_id, label"
    )


@query("SELECT vec_id, round(list_dot_product(v, v), 6) AS norm FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))")
def normalised_vectors(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings").select("vec_id", vectors.l2_normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


# ------------------------------------------------------------------ graph


def _edge_sql() -> str:
    parts = [f"SELECT case_id, 'HEARD_IN' AS rel, {_collapse2('court')} AS dst FROM case_evidence"]
    parts += [f"SELECT case_id, '{rel}' AS rel, {_collapse2('x')} AS dst FROM (SELECT case_id, unnest({c}) AS x FROM case_evidence)" for c, rel in graph.RELATIONS.items()]
    return "e AS (SELECT DISTINCT case_id, rel, dst FROM (" + " UNION ALL ".join(parts) + ") WHERE dst <> '' AND case_id IS NOT NULL)"


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.edges(table(spark, root, "case_evidence"))


def _asked(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "legal_queries").where("query_id % 100 = 0")


@query(f"WITH {_edge_sql()} SELECT case_id, rel, dst FROM e")
def graph_edges(spark: SparkSession, root: str) -> DataFrame:
    return _edges(spark, root)


@query(
    f"WITH {_edge_sql()}, l AS (SELECT DISTINCT CASE rel WHEN 'HEARD_IN' THEN 'Court' WHEN 'DECIDED_BY' THEN 'Judge' WHEN 'UNDER_ACT' THEN 'Act' WHEN 'INVOLVES_SECTION' THEN 'Section' ELSE 'Party' END AS label, dst AS name, case_id FROM e) "
    "SELECT label, name, count(*) AS cases FROM l GROUP BY 1, 2"
)
def graph_nodes(spark: SparkSession, root: str) -> DataFrame:
    return graph.nodes(_edges(spark, root))


@query(
    f"WITH {_edge_sql()} SELECT case_id, " + ", ".join(
        f"coalesce(string_agg(dst, '|' ORDER BY dst) FILTER (rel = '{rel}'), '') AS {c}" for c, rel in [("courts", "HEARD_IN"), *graph.RELATIONS.items()]) + " FROM e GROUP BY case_id"
)
def case_metadata(spark: SparkSession, root: str) -> DataFrame:
    m = graph.metadata(_edges(spark, root))
    return m.select("case_id", *[F.array_join(c, "|").alias(c) for c in ("courts", *graph.RELATIONS)])


_ACT_HITS = (
    "qa AS (SELECT DISTINCT query_id, unnest(suggested_acts) AS term FROM legal_queries WHERE query_id % 100 = 0), qt AS (SELECT * FROM qa WHERE " + _strip2("coalesce(term, '')") + " <> ''), "
    "ah AS (SELECT query_id, case_id, count(*) AS hits, 'act' AS match_type FROM (SELECT DISTINCT query_id, case_id, dst FROM e JOIN qt ON contains(lower(dst), lower(term)) WHERE rel = 'UNDER_ACT') GROUP BY 1, 2)"
)
_SECTION_HITS = "sh AS (SELECT query_id, case_id, count(*) AS hits, 'section' AS match_type FROM e JOIN (SELECT DISTINCT query_id, unnest(suggested_sections) AS s FROM legal_queries WHERE query_id % 100 = 0) q ON e.dst = q.s WHERE rel = 'INVOLVES_SECTION' GROUP BY 1, 2)"
_KEYWORD_HITS = (
    "kh AS (SELECT DISTINCT query_id, case_id, 1 AS hits, 'keyword' AS match_type FROM (SELECT DISTINCT case_id, case_name FROM case_evidence WHERE case_name IS NOT NULL) c JOIN "
    "(SELECT * FROM (SELECT DISTINCT query_id, unnest(keywords[1:10]) AS k FROM legal_queries WHERE query_id % 100 = 0) WHERE " + _strip2("coalesce(k, '')") + " <> '') q ON contains(lower(c.case_name), lower(q.k)))"
)


@query(f"WITH {_edge_sql()}, {_ACT_HITS} SELECT * FROM ah")
def graph_act_hits(spark: SparkSession, root: str) -> DataFrame:
    return graph.act_hits(_edges(spark, root), _asked(spark, root))


@query(f"WITH {_edge_sql()}, {_SECTION_HITS} SELECT * FROM sh")
def graph_section_hits(spark: SparkSession, root: str) -> DataFrame:
    return graph.section_hits(_edges(spark, root), _asked(spark, root))


@query(f"WITH {_KEYWORD_HITS} SELECT * FROM kh")
def graph_keyword_hits(spark: SparkSession, root: str) -> DataFrame:
    return graph.keyword_hits(table(spark, root, "case_evidence"), _asked(spark, root))


@query("SELECT DISTINCT s.doc_id FROM staged_cases s JOIN (SELECT DISTINCT lower(case_name) AS n FROM case_evidence WHERE case_name IS NOT NULL) c ON contains(c.n, lower(substr(" + _strip2("s.title") + ", 1, 60))) WHERE " + _strip2("coalesce(s.title, '')") + " <> ''")
def staged_known_titles(spark: SparkSession, root: str) -> DataFrame:
    return graph.known_titles(table(spark, root, "staged_cases"), table(spark, root, "case_evidence")).select("doc_id").distinct()


# ------------------------------------------------------------------ ranking

_FUSED = "round(CASE WHEN g > 0 THEN CAST(0.7 AS DOUBLE) * s + CAST(0.3 AS DOUBLE) * g ELSE s END + 1e-9, 6)"
_BASE = (
    "b AS (SELECT query_id, case_id, max(semantic_score) AS s0, max(graph_score) AS g0 FROM (SELECT DISTINCT evidence_id, query_id, case_id, semantic_score, graph_score FROM case_evidence WHERE case_id IS NOT NULL) GROUP BY 1, 2), "
    "c AS (SELECT *, least(greatest(coalesce(s0, 0), 0), 1) AS s, least(greatest(coalesce(g0, 0), 0), 1) AS g FROM b), f AS (SELECT query_id, case_id, g0 AS graph_score, " + _FUSED + " AS final_score FROM c)"
)


def _fused(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "case_evidence").where("case_id IS NOT NULL").groupBy("query_id", "case_id").agg(F.max("semantic_score").alias("score"), F.max("graph_score").alias("graph_score"))
    return e.select("query_id", "case_id", "graph_score", ranking.fused(F.col("score"), F.col("graph_score")).alias("final_score"))


@query(f"WITH {_BASE} SELECT query_id, case_id, final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, case_id) AS INT) AS rank FROM f QUALIFY rank <= 10")
def hybrid_rank(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "case_evidence").where("case_id IS NOT NULL")
    semantic = e.where("semantic_score IS NOT NULL").groupBy("query_id", "case_id").agg(F.max("semantic_score").alias("score"), F.max("semantic_score").alias("top_score"))
    linked = e.groupBy("query_id", "case_id").agg(F.max("graph_score").alias("graph_score"))
    return ranking.hybrid_rank(semantic, linked).select("query_id", "case_id", "final_score", "rank")


_RATINGS = "v AS (SELECT case_id, CAST(sum(rating) AS BIGINT) AS net FROM feedback WHERE case_id IS NOT NULL AND rating IS NOT NULL GROUP BY 1)"


@query(f"WITH {_RATINGS} SELECT case_id, net FROM v")
def feedback_ratings(spark: SparkSession, root: str) -> DataFrame:
    return ranking.ratings(table(spark, root, "feedback"))


_BOOST = "CASE WHEN coalesce(net, 0) > 0 THEN least(net * 0.03, 0.12) WHEN coalesce(net, 0) < 0 THEN greatest(net * 0.025, -0.10) ELSE 0 END"
_BOOSTED = f"w AS (SELECT query_id, f.case_id, graph_score, coalesce(net, 0) AS feedback_votes, CAST({_BOOST} AS DOUBLE) AS bo, final_score AS fs FROM f LEFT JOIN v USING (case_id)), x AS (SELECT *, round(least(fs + bo, 1.0) + 1e-9, 6) AS final_score FROM w)"


@query(f"WITH {_BASE}, {_RATINGS}, {_BOOSTED} SELECT query_id, case_id, final_score, round(bo, 4) AS feedback_boost, feedback_votes FROM x")
def feedback_boosted(spark: SparkSession, root: str) -> DataFrame:
    out = ranking.apply_feedback(_fused(spark, root), ranking.ratings(table(spark, root, "feedback")))
    return out.select("query_id", "case_id", "final_score", "feedback_boost", "feedback_votes")


@query(
    f"WITH {_BASE}, {_RATINGS}, {_BOOSTED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, case_id) AS k FROM x), "
    "a AS (SELECT query_id, max(final_score) FILTER (k = 1) AS t, max(final_score) FILTER (k = 2) AS s, max(graph_score) FILTER (k = 1) AS g, count(*) FILTER (final_score > 0.35) AS n FROM r GROUP BY 1) "
    "SELECT query_id, round(1e-9 + least(0.5 * CASE WHEN t > 0.35 THEN t ELSE t * 0.5 END + 0.2 * CASE WHEN s IS NULL THEN 0.5 WHEN t > 0.35 THEN least((t - s) * 2, 1.0) ELSE 0.2 END + 0.2 * least(n / 3.0, 1.0) + 0.1 * CASE WHEN g > 0.15 THEN 1.0 ELSE 0.5 END, 1.0), 4) AS confidence FROM a"
)
def query_confidence(spark: SparkSession, root: str) -> DataFrame:
    out = ranking.apply_feedback(_fused(spark, root), ranking.ratings(table(spark, root, "feedback")))
    return ranking.confidence(out).select("query_id", "confidence")


# ------------------------------------------------------------------ queries and evidence


@query(
    "SELECT query_id, CASE WHEN regexp_matches(original_query, '[\\x{0B80}-\\x{0BFF}]') THEN 'ta' WHEN regexp_matches(original_query, '[\\x{0900}-\\x{097F}]') THEN 'hi' WHEN list_has_any(regexp_extract_all(lower(original_query), '[a-z]+'), ["
    + ", ".join(f"'{w}'" for w in understanding.TANGLISH) + "]) THEN 'ta_roman' ELSE 'en' END AS language FROM legal_queries"
)
def query_script_language(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "legal_queries").select("query_id", understanding.script_language(F.col("original_query")).alias("language"))


@query(
    "WITH w AS (SELECT query_id, range AS pos, ws[CAST(range AS INT)] AS w FROM (SELECT query_id, regexp_extract_all(lower(original_query), '[a-z]+') AS ws FROM legal_queries), range(1, 2000) WHERE range <= len(ws)), "
    "d AS (SELECT query_id, w, min(pos) AS pos FROM w WHERE length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in understanding.STOP) + ") GROUP BY 1, 2) "
    "SELECT q.query_id, coalesce(string_agg(w, ' ' ORDER BY pos), '') AS keywords FROM legal_queries q LEFT JOIN d USING (query_id) WHERE original_query IS NOT NULL GROUP BY 1"
)
def query_keywords(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "legal_queries").where("original_query IS NOT NULL")
    return q.select("query_id", F.array_join(understanding.keywords(F.col("original_query")), " ").alias("keywords"))


def _list2(c: str) -> str:
    return f"coalesce({c}, CAST([] AS VARCHAR[]))"


@query(
    "SELECT query_id, array_to_string(list_filter(list_concat([query_in_english, query_in_tamil_script, CASE WHEN NOT (coalesce(original_query = nullif(query_in_english, ''), false) OR coalesce(original_query = nullif(query_in_tamil_script, ''), false)) THEN original_query END, incident_type], "
    f"{_list2('keywords')}, {_list2('suggested_acts')}, list_transform({_list2('suggested_sections')}, lambda s: 'Section ' || s), {_list2('expanded_concepts')}), lambda p: p IS NOT NULL AND p <> ''), ' ') AS search_text FROM legal_queries"
)
def query_search_text(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "legal_queries").select("query_id", understanding.search_text().alias("search_text"))


def _rules2(field: int) -> str:
    """The field of the first rule that holds a word of the query; lists parted by a bar."""
    shown = lambda v: v if isinstance(v, str) else "|".join(v)
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in r[0]) + f" THEN '{shown(r[field])}'" for r in understanding.RULES)


_MENTIONED = "regexp_extract_all({}, '(?i)\\bsection\\s+([0-9]+[a-z]?)\\b', 1)"


@query(
    "WITH q AS (SELECT query_id, original_query, lower(original_query) AS low FROM legal_queries WHERE original_query IS NOT NULL), "
    f"r AS (SELECT *, {_rules2(1)} ELSE 'General' END AS legal_domain, {_rules2(2)} ELSE 'Legal Dispute' END AS incident_type, {_rules2(3)} ELSE '' END AS acts, {_rules2(4)} ELSE NULL END AS own, {_rules2(5)} ELSE 'legal rights|judicial remedy' END AS concepts FROM q), "
    f"s AS (SELECT *, CASE WHEN own IS NULL THEN {_MENTIONED.format('original_query')} ELSE list_concat(string_split(own, '|'), {_MENTIONED.format('low')}) END AS raw FROM r), "
    "d AS (SELECT query_id, x, min(i) AS i FROM (SELECT query_id, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM s) GROUP BY 1, 2), n AS (SELECT query_id, string_agg(x, '|' ORDER BY i) AS sections FROM d GROUP BY 1) "
    "SELECT query_id, legal_domain, incident_type, acts, coalesce(sections, '') AS sections, concepts FROM s LEFT JOIN n USING (query_id)"
)
def query_concepts(spark: SparkSession, root: str) -> DataFrame:
    m = understanding.apply_rules(F.col("original_query"), understanding.RULES)
    q = table(spark, root, "legal_queries").where("original_query IS NOT NULL").select("query_id", m.alias("m"))
    return q.select("query_id", "m.legal_domain", "m.incident_type", *[F.array_join(f"m.{c}", "|").alias(c) for c in ("acts", "sections", "concepts")])


@query(
    f"SELECT query_id, array_to_string(list_concat(list_transform({_list2('suggested_sections')}[1:3], lambda s: 'section ' || s), list_transform({_list2('suggested_acts')}[1:2], lambda a: trim(replace(a, ' Act', ''))), [coalesce(incident_type, '')], {_list2('keywords')}[1:4]), ' ') AS web_query FROM legal_queries"
)
def query_web_string(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "legal_queries").select("query_id", understanding.web_query().alias("web_query"))


@query("WITH d AS (SELECT DISTINCT evidence_id, relevant_chunks FROM case_evidence) SELECT evidence_id, CASE WHEN len(coalesce(relevant_chunks, CAST([] AS VARCHAR[]))) = 0 THEN '    (No text passages available)' ELSE array_to_string(list_transform(relevant_chunks[1:3], lambda c: '    • ' || " + _strip2("substr(c, 1, 400)") + " || CASE WHEN length(c) > 400 THEN '...' ELSE '' END), chr(10)) END AS passages FROM d")
def evidence_passages(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "case_evidence").select("evidence_id", "relevant_chunks").distinct()
    return e.select("evidence_id", evidence.format_passages(F.col("relevant_chunks")).alias("passages"))


@query(
    f"WITH {_BASE}, {_edge_sql()}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, case_id) AS INT) AS rank FROM f QUALIFY rank <= 5), "
    "m AS (SELECT case_id, min(dst) FILTER (rel = 'HEARD_IN') AS court, count(*) FILTER (rel = 'DECIDED_BY') AS judges, count(*) FILTER (rel = 'UNDER_ACT') AS acts FROM e GROUP BY 1) "
    "SELECT query_id, case_id, rank, coalesce(court, '') AS court, coalesce(judges, 0) AS judges, coalesce(acts, 0) AS acts FROM t LEFT JOIN m USING (case_id)"
)
def evidence_rows(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "document_results").select(F.col("doc_id").alias("case_id"), "text")
    rows = evidence.aggregate_evidence(_fused(spark, root), graph.metadata(_edges(spark, root)), chunking.chunk(docs, "case_id"))
    return rows.select("query_id", "case_id", "rank", "court", F.size("judges").cast("long").alias("judges"), F.size("acts").cast("long").alias("acts"))


@query("SELECT DISTINCT doc_id, title, substr(md5(lower(" + _strip2("doc_id || ':' || title") + ")), 1, 12) AS hash FROM staged_cases")
def staging_hashes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "staged_cases").select("doc_id", "title", evidence.stage_hash(F.col("doc_id"), F.col("title")).alias("hash")).distinct()


@query("SELECT _staging_hash AS hash, count(*) AS times, max(_staged_at) AS staged_at FROM staged_cases GROUP BY 1")
def staging_latest(spark: SparkSession, root: str) -> DataFrame:
    s = evidence.latest_staged(table(spark, root, "staged_cases"))
    return s.select(F.col("_staging_hash").alias("hash"), "times", F.col("_staged_at").alias("staged_at"))


@query("SELECT DISTINCT doc_id, " + _strip2("regexp_replace('<p>' || text_excerpt || '</p>', '<[^>]+>', '', 'g')") + " AS text FROM staged_cases WHERE text_excerpt IS NOT NULL")
def stripped_excerpts(spark: SparkSession, root: str) -> DataFrame:
    t = F.concat(F.lit("<p>"), F.col("text_excerpt"), F.lit("</p>"))
    return table(spark, root, "staged_cases").where("text_excerpt IS NOT NULL").select("doc_id", evidence.strip_html(t).alias("text")).distinct()


@query()
def staging_case_keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "staged_cases").select("doc_id", evidence.case_key(F.col("title")).alias("key")).distinct()


_TURNS = "t AS (SELECT query_id // 8 AS conv_id, query_id, nullif(legal_domain, '') AS legal_domain, nullif(incident_type, '') AS incident_type FROM legal_queries)"


def _turns(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "legal_queries").select(F.expr("query_id div 8").alias("conv_id"), "query_id", "legal_domain", "incident_type", "suggested_sections")


@query(
    f"WITH {_TURNS} SELECT conv_id, query_id, last_value(legal_domain IGNORE NULLS) OVER w AS legal_domain, last_value(incident_type IGNORE NULLS) OVER w AS incident_type, count(*) OVER w AS turn_count FROM t "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def conversation_turns(spark: SparkSession, root: str) -> DataFrame:
    return evidence.fold_turns(_turns(spark, root), "conv_id", "query_id", ["legal_domain", "incident_type"], [])


@query(
    f"WITH {_TURNS}, u AS (SELECT query_id, unnest(suggested_sections) AS x, generate_subscripts(suggested_sections, 1) AS i FROM legal_queries), "
    "s AS (SELECT query_id // 8 AS conv_id, x, min(query_id * 1000 + i) AS place FROM u WHERE coalesce(x, '') <> '' GROUP BY 1, 2), "
    "l AS (SELECT conv_id, string_agg(x, '|' ORDER BY place) AS sections FROM s GROUP BY 1), "
    "m AS (SELECT conv_id, max_by(legal_domain, CASE WHEN legal_domain IS NOT NULL THEN query_id END) AS legal_domain, count(*) AS turn_count FROM t GROUP BY 1) "
    "SELECT conv_id, legal_domain, turn_count, coalesce(sections, '') AS sections FROM m LEFT JOIN l USING (conv_id)"
)
def conversation_states(spark: SparkSession, root: str) -> DataFrame:
    s = evidence.final_state(_turns(spark, root), "conv_id", "query_id", ["legal_domain"], ["suggested_sections"])
    return s.select("conv_id", "legal_domain", "turn_count", F.array_join("suggested_sections", "|").alias("sections"))


@query("SELECT query_id, incident_type AS summary, CAST(len(coalesce(keywords, CAST([] AS VARCHAR[]))) AS BIGINT) AS n FROM legal_queries")
def parsed_answers(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "legal_queries")
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("incident_type").alias("summary"), F.coalesce("keywords", F.array().cast("array<string>")).alias("words"))), F.lit("\n```"))
    a = evidence.parse_answer(raw, "summary string, words array<string>")
    return q.select("query_id", a["summary"].alias("summary"), F.size(a["words"]).cast("long").alias("n"))


# ------------------------------------------------------------------ streams


@query(f"WITH {_RATINGS.replace('FROM feedback WHERE', 'FROM (SELECT DISTINCT * FROM feedback) WHERE')} SELECT case_id, net FROM v")
def stream_votes(spark: SparkSession, root: str) -> DataFrame:
    found = streams.votes(streams.table_stream(spark, root, "feedback"))
    return streams.run_once(found, "update").groupBy("case_id").agg(F.max_by("net", "_batch").alias("net"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, root: str) -> DataFrame:
    found = streams.event_windows(streams.table_stream(spark, root, "events"))
    return streams.run_once(found, "complete").select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Cases ranked by fused score, lifted by feedback, the ten best of each query."""
    out = ranking.apply_feedback(_fused(spark, root), ranking.ratings(table(spark, root, "feedback")))
    return ranking.top_n(out, 10, "query_id", "final_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from casegrain.plans import answers, conversations  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql.replace("{WS}", WS2).replace("{LINE}", LINE2) for name, sql in SQL.items()}

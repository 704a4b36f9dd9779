"""Queries over graphs, web rows, gates, prompts, answers and page composition, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrain.operators import answers as A
from casegrain.operators import chunking, cleaning, evidence, extraction, graph, ranking, understanding, web
from casegrain.plans import catalogue as K
from casegrain.plans.catalogue import SQL, query
from casegrain.sources.tables import table

_EMPTY = "CAST([] AS VARCHAR[])"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ------------------------------------------------------------------ concepts, built and loaded graphs

_ZONE = "lower(substr(text, 1, 3000) || ' ' || substr(text, 1, 4000))"
_CONCEPT_EDGES = "ce AS (SELECT DISTINCT doc_id AS case_id, concept FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{cid}' AS concept FROM document_results WHERE " + " OR ".join(f"contains({_ZONE}, '{w}')" for w in words) for cid, _, _, words, _ in extraction.CONCEPTS) + "))"
_CONCEPT_HITS = (
    _CONCEPT_EDGES + ", ct AS (" + " UNION ALL ".join(f"SELECT '{cid}' AS concept, {_quoted(n.lower())} AS name, [{', '.join(_quoted(a.lower()) for a in aliases)}] AS aliases" for cid, n, _, _, aliases in extraction.CONCEPTS)
    + f"), qk AS (SELECT query_id, lower(coalesce(incident_type, '')) AS incident, list_filter(list_transform(list_append(list_filter(coalesce(regexp_extract_all(lower(original_query), '[a-z]+'), {_EMPTY}), lambda w: length(w) > 2 AND w NOT IN ({', '.join(_quoted(w) for w in understanding.STOP)})), original_query), lambda x: lower(x)), lambda x: trim(coalesce(x, '')) <> '') AS terms FROM legal_queries WHERE query_id % 100 = 0), "
    "qc AS (SELECT DISTINCT query_id, concept FROM qk, ct WHERE (trim(incident) <> '' AND contains(name, incident)) OR len(list_filter(terms, lambda t: len(list_filter(aliases, lambda a: contains(a, t))) > 0)) > 0), "
    "ch AS (SELECT query_id, case_id, count(*) AS hits, 'concept' AS match_type FROM qc JOIN ce USING (concept) GROUP BY 1, 2)"
)


def _worded(spark: SparkSession, root: str) -> DataFrame:
    """The asked queries with the keywords read from their own text."""
    return K._asked(spark, root).withColumn("keywords", understanding.keywords(F.col("original_query")))


def _concepts(spark: SparkSession, root: str) -> DataFrame:
    return graph.concept_edges(table(spark, root, "document_results"))


@query(f"WITH {_CONCEPT_HITS.replace('query_id % 100 = 0', 'query_id IN (SELECT min(query_id) FROM legal_queries GROUP BY incident_type)')} SELECT * FROM ch")
def graph_concept_hits(spark: SparkSession, root: str) -> DataFrame:
    """The first query of each kind of incident against all documents."""
    q = table(spark, root, "legal_queries")
    first = q.groupBy("incident_type").agg(F.min("query_id").alias("query_id")).select("query_id")
    return graph.concept_hits(_concepts(spark, root), q.join(first, "query_id", "left_semi").withColumn("keywords", understanding.keywords(F.col("original_query"))))


_WORDS = f"list_filter(coalesce(regexp_extract_all(lower(original_query), '[a-z]+'), {_EMPTY}), lambda w: length(w) > 2 AND w NOT IN ({', '.join(_quoted(w) for w in understanding.STOP)}))"
_WORD_HITS = K._KEYWORD_HITS.replace(
    "unnest(keywords[1:10]) AS k FROM legal_queries WHERE query_id % 100 = 0", f"unnest(list_filter(l, lambda w, i: list_position(l, w) = i)[1:10]) AS k FROM (SELECT query_id, {_WORDS} AS l FROM legal_queries WHERE query_id % 100 = 0)")


@query(
    f"WITH {K._edge_sql()}, {K._ACT_HITS}, {K._SECTION_HITS}, {_WORD_HITS}, {_CONCEPT_HITS}, h AS (SELECT * FROM ah UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM kh UNION ALL SELECT * FROM ch), "
    "m AS (SELECT query_id, case_id, CAST(sum(hits * CASE match_type WHEN 'section' THEN 3 WHEN 'concept' THEN 3 WHEN 'act' THEN 2 ELSE 1 END) AS BIGINT) AS raw_score, coalesce(CAST(sum(hits) FILTER (match_type = 'act') AS BIGINT), 0) AS matched_acts, "
    "coalesce(CAST(sum(hits) FILTER (match_type = 'section') AS BIGINT), 0) AS matched_sections, coalesce(CAST(sum(hits) FILTER (match_type IN ('keyword', 'concept')) AS BIGINT), 0) AS matched_keywords FROM h GROUP BY 1, 2), "
    "n AS (SELECT *, round(raw_score / CAST(greatest(max(raw_score) OVER (PARTITION BY query_id), 1) AS DOUBLE), 6) AS graph_score FROM m), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, case_id) AS INT) AS rank FROM n) SELECT * FROM r WHERE rank <= 20"
)
def graph_search(spark: SparkSession, root: str) -> DataFrame:
    return graph.search(K._edges(spark, root), table(spark, root, "case_evidence"), _worded(spark, root), concepts=_concepts(spark, root))


@query("WITH n AS (SELECT DISTINCT case_id, case_name FROM case_evidence WHERE case_name IS NOT NULL), t AS (SELECT DISTINCT query_id, string_split(trim(case_name), ' ')[-1] AS term FROM case_evidence WHERE query_id % 100 = 0 AND trim(coalesce(case_name, '')) <> '') SELECT DISTINCT query_id, case_id, 1 AS hits, 'keyword' AS match_type FROM n JOIN t ON contains(lower(case_name), lower(term))")
def graph_name_hits(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "case_evidence")
    last = F.element_at(F.split(F.trim("case_name"), " "), -1)
    asked = e.where("query_id % 100 = 0 AND trim(coalesce(case_name, '')) != ''").groupBy("query_id").agg(F.collect_set(last).alias("keywords"))
    return graph.keyword_hits(e, asked, most=1000)


@query("SELECT DISTINCT case_id AS doc_id FROM case_evidence a WHERE rank = 1 AND trim(coalesce(case_name, '')) <> '' AND EXISTS (SELECT 1 FROM case_evidence b WHERE b.rank = 2 AND contains(lower(b.case_name), lower(substr(trim(a.case_name), 1, 60))))")
def known_case_titles(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "case_evidence")
    titled = e.where("rank = 1 AND trim(coalesce(case_name, '')) != ''").select(F.col("case_id").alias("doc_id"), F.trim("case_name").alias("title"))
    return graph.known_titles(titled, e.where("rank = 2")).select("doc_id").distinct()


def _graphs(spark: SparkSession, root: str) -> DataFrame:
    """Evidence rows as raw graphs: statutes and provisions read, every third row with a relation that isn't permitted."""
    e = table(spark, root, "case_evidence").select("evidence_id", "case_name", "decision_date", "court", "judges", "acts", "sections", "petitioners", "respondents").distinct()
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), none)
    party = lambda c, role: F.transform(some(c), lambda p: F.struct(p.alias("name"), F.lit(role).alias("role")))
    rels = [F.struct(F.lit("Case").alias("subject"), F.lit(r).alias("relation"), F.lit(o).alias("object")) for r, o in extraction.ENDS.items()]
    odd = F.when(F.col("evidence_id") % 3 == 0, F.array(F.struct(F.lit("Court").alias("subject"), F.lit("HEARD_IN").alias("relation"), F.lit("Case").alias("object"))))
    return e.select(
        "evidence_id", "case_name", "decision_date", F.lit(None).cast("string").alias("language"), "court", some("judges").alias("judges"),
        F.transform(some("acts"), extraction.parse_act).alias("acts"), F.transform(some("sections"), extraction.normalize_section).alias("sections"),
        F.concat(party("petitioners", "Petitioner"), party("respondents", "Respondent"), F.array(F.struct(F.lit("x").alias("name"), F.lit("Witness").alias("role")))).alias("parties"),
        F.concat(F.array(*rels), F.coalesce(odd, F.array().cast("array<struct<subject: string, relation: string, object: string>>"))).alias("relationships"),
    )


_NAMES = lambda c: f"list_filter(list_transform(coalesce({c}, {_EMPTY}), lambda x: {K._collapse2('x')}), lambda x: x <> '')"
_GRAPHS = (
    "g0 AS (SELECT DISTINCT evidence_id, case_name, decision_date, court, judges, acts, sections, petitioners, respondents FROM case_evidence), "
    f"g1 AS (SELECT evidence_id, {K._collapse2("coalesce(case_name, '')")} AS case_name, {K._collapse2("coalesce(decision_date, '')")} AS decision_date, {K._collapse2("coalesce(court, '')")} AS court, {_NAMES('judges')} AS judges, {_NAMES('acts')} AS acts, {_NAMES('sections')} AS sections, {_NAMES('petitioners')} AS pets, {_NAMES('respondents')} AS resps FROM g0), "
    "ga AS (SELECT evidence_id, regexp_replace(regexp_replace(a, ',?\\s*(?:of\\s+)?[0-9]{{4}}$', ''), '[ ,]+$', '') AS name, CAST(nullif(regexp_extract(a, ',?\\s*(?:of\\s+)?([0-9]{{4}})$', 1), '') AS INT) AS year FROM (SELECT evidence_id, unnest(acts) AS a FROM g1)), "
    f"gv AS (SELECT evidence_id, {K._collapse2('name')} AS name, year FROM ga WHERE year BETWEEN 1800 AND 2100 AND length(name) >= 5), "
    "gs AS (SELECT evidence_id, CASE WHEN regexp_matches(s, '^[Aa]rts?\\.?\\s*[0-9]') THEN 'Article' WHEN regexp_matches(s, '^[Cc]lauses?\\s+[0-9]') THEN 'Clause' WHEN regexp_matches(s, '^[Rr]ules?\\s+[0-9]') THEN 'Rule' ELSE 'Section' END AS type, "
    "coalesce(nullif(regexp_extract(s, '^(?:[Aa]rts?\\.?\\s*|[Cc]lauses?\\s+|[Rr]ules?\\s+|[Ss]ections?\\s+|[Ss]\\.\\s*)([0-9]+[A-Za-z0-9_().,/]*)', 1), ''), s) AS number FROM (SELECT evidence_id, unnest(sections) AS s FROM g1))"
)


@query(
    f"WITH {_GRAPHS} SELECT evidence_id, case_name, court, 'English' AS language, CAST(len(judges) AS INT) AS judges, coalesce((SELECT CAST(count(*) AS INT) FROM gv WHERE gv.evidence_id = g1.evidence_id), 0) AS acts, CAST(len(sections) AS INT) AS sections, "
    "CAST(len(pets) + len(resps) AS INT) AS parties, 7 AS relationships FROM g1"
)
def built_graphs(spark: SparkSession, root: str) -> DataFrame:
    g = graph.build_graph(_graphs(spark, root))
    return g.select("evidence_id", "case_name", "court", "language", *[F.size(c).alias(c) for c in ("judges", "acts", "sections", "parties", "relationships")])


_NODES = (
    _GRAPHS + ", rows AS (SELECT 'Case' AS label, case_name AS key, decision_date || '|English' AS value, evidence_id AS o FROM g1 UNION ALL SELECT 'Court', court, '', evidence_id FROM g1 UNION ALL SELECT 'Judge', unnest(judges), '', evidence_id FROM g1 "
    "UNION ALL SELECT 'Act', name, CAST(year AS VARCHAR), evidence_id FROM gv UNION ALL SELECT 'Section', type || ' ' || number, '', evidence_id FROM gs UNION ALL SELECT 'Party', unnest(list_concat(pets, resps)), '', evidence_id FROM g1), "
    "nodes AS (SELECT label, key, max_by(value, {{'o': o, 'v': value}}) AS value FROM rows WHERE key <> '' GROUP BY 1, 2)"
)


@query(f"WITH {_NODES} SELECT * FROM nodes".replace("{{", "{").replace("}}", "}"))
def loaded_nodes(spark: SparkSession, root: str) -> DataFrame:
    return graph.load_graph(_graphs(spark, root), "evidence_id")[0]


@query(
    (f"WITH {_GRAPHS}, r AS (SELECT evidence_id, 'HEARD_IN' AS rel, court AS key FROM g1 UNION ALL SELECT evidence_id, 'DECIDED_BY', unnest(judges) FROM g1 UNION ALL SELECT evidence_id, 'UNDER_ACT', name FROM gv "
    "UNION ALL SELECT evidence_id, 'INVOLVES_SECTION', type || ' ' || number FROM gs UNION ALL SELECT evidence_id, 'HAS_PETITIONER', unnest(pets) FROM g1 UNION ALL SELECT evidence_id, 'HAS_RESPONDENT', unnest(resps) FROM g1) "
    "SELECT DISTINCT case_name, rel, key FROM r JOIN g1 USING (evidence_id) WHERE key <> '' AND case_name <> ''").replace("{{", "{").replace("}}", "}")
)
def loaded_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.load_graph(_graphs(spark, root), "evidence_id")[1]


SQL["built_graphs"] = SQL["built_graphs"].replace("{{", "{").replace("}}", "}")

# ------------------------------------------------------------------ web rows, gate, answers

_PAYLOAD = (
    "p AS (SELECT DISTINCT 1 + length(text_excerpt) % (SELECT count(*) FROM legal_queries) AS query_id, doc_id, title, headline, url, court, date, text_excerpt, relevance_score FROM staged_cases WHERE text_excerpt IS NOT NULL), "
    f"q AS (SELECT query_id, coalesce(suggested_acts, {_EMPTY}) AS qa, coalesce(suggested_sections, {_EMPTY}) AS qs FROM legal_queries), "
    "ja AS (SELECT query_id, coalesce(doc_id, '') AS doc_id, coalesce(title, '') AS title, " + K._strip2("regexp_replace(coalesce(headline, ''), '<[^>]+>', '', 'g')") + " AS headline, coalesce(court, '') AS court, coalesce(date, '') AS date, qa, qs FROM p JOIN q USING (query_id) WHERE relevance_score < 0.6), "
    "a AS (SELECT query_id, doc_id, title, headline, 'https://judgments.example/doc/' || doc_id || '/' AS url, court, date, substr(headline, 1, 600) AS text_excerpt, qa AS acts, regexp_extract_all(headline, '(?i)\\bSection\\s+([0-9]+[A-Za-z]?)\\b', 1) AS found, qs, 0.55 AS relevance_score FROM ja), "
    "jb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, title, url, text_excerpt) AS place, coalesce(url, '') AS u, coalesce(title, '') AS t FROM p JOIN q USING (query_id) WHERE relevance_score >= 0.6), "
    "b AS (SELECT query_id, 'page_' || place || '_' || substr(md5(u), 1, 6) AS doc_id, t AS title, substr(text_excerpt, 1, 400) AS headline, u AS url, CASE WHEN contains(lower(u), 'highcourt') OR contains(lower(u), 'hc') OR contains(lower(t), 'high court') THEN 'High Court' ELSE 'Supreme Court of India' END AS court, "
    "'Recent' AS date, substr(text_excerpt, 1, 800) AS text_excerpt, qa AS acts, regexp_extract_all(text_excerpt, '(?i)\\bSection\\s+([0-9]+[A-Za-z]?)\\b', 1) AS found, qs, 0.65 AS relevance_score FROM jb), "
    "w AS (SELECT * EXCLUDE (found, qs), CASE WHEN len(found) > 0 THEN found ELSE qs END AS sections FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE query_id NOT IN (SELECT query_id FROM b)))"
)


def _web(spark: SparkSession, root: str) -> DataFrame:
    """Staged rows as the payloads of two searches, spread over the queries by the length of their text."""
    asked = table(spark, root, "legal_queries").select("query_id", "suggested_acts", "suggested_sections")
    staged = table(spark, root, "staged_cases").where("text_excerpt IS NOT NULL")
    spread = (F.lit(1) + F.length("text_excerpt") % F.lit(asked.count())).cast("long")
    p = staged.select(spread.alias("query_id"), "doc_id", "title", "headline", "url", "court", "date", "text_excerpt", "relevance_score").distinct().join(asked, "query_id")
    judgments = web.judgment_rows(p.where("relevance_score < 0.6").withColumn("tid", F.col("doc_id")).withColumn("publishdate", F.col("date")), "https://judgments.example/doc/%s/")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "title", "url", "text_excerpt"))
    pages = web.page_rows(p.where("relevance_score >= 0.6").withColumn("position", place).withColumn("content", F.col("text_excerpt")))
    return web.by_priority(pages, judgments)


@query(f"WITH {_PAYLOAD} SELECT * REPLACE (array_to_string(acts, '|') AS acts, array_to_string(sections, '|') AS sections) FROM w")
def web_rows(spark: SparkSession, root: str) -> DataFrame:
    return _web(spark, root).withColumns({c: F.array_join(c, "|") for c in ("acts", "sections")})


_OWN = "o AS (SELECT query_id, rank, case_id, case_name, decision_date, court, judges, acts, sections, petitioners, respondents, final_score, relevant_chunks, 'permanent_kg' AS source FROM (SELECT DISTINCT * FROM case_evidence))"
_GATED = (
    _PAYLOAD + f", {_OWN}, cf AS ({SQL['query_confidence']}), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM w), "
    f"gt AS (SELECT o.*, 0 AS s, confidence FROM o JOIN cf USING (query_id) WHERE rank <= CASE WHEN confidence >= 0.35 THEN 5 ELSE 2 END UNION ALL SELECT query_id, place, doc_id, title, date, court, {_EMPTY}, acts, sections, {_EMPTY}, {_EMPTY}, relevance_score, [text_excerpt], 'web_retrieved', 1, confidence FROM x JOIN cf USING (query_id) WHERE confidence < 0.35), "
    "gg AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY s, rank, case_id) AS rank), CASE WHEN confidence >= 0.35 THEN 'permanent_kg' WHEN min(s) OVER (PARTITION BY query_id) = 0 THEN 'hybrid' ELSE 'temporary_pool' END AS knowledge_source FROM gt)"
)


def _own(spark: SparkSession, root: str) -> DataFrame:
    return K._evidence(spark, root).withColumn("source", F.lit(A.OWN))


def _gated(spark: SparkSession, root: str) -> DataFrame:
    ranked = ranking.apply_feedback(K._fused(spark, root), ranking.ratings(table(spark, root, "feedback")))
    beside = _web(spark, root).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    place = beside.select("query_id", F.col("doc_id").alias("case_id"), "place")
    return A.gated(_own(spark, root), ranking.confidence(ranked), A.web_evidence(beside).join(place, ["query_id", "case_id"]))


@query(f"WITH {_GATED} SELECT query_id, CAST(rank AS INT) AS rank, case_id, case_name, court, source, knowledge_source FROM gg")
def gated_evidence(spark: SparkSession, root: str) -> DataFrame:
    return _gated(spark, root).select("query_id", "rank", "case_id", "case_name", "court", "source", "knowledge_source")


@query(
    f"WITH {_GATED}, u AS (SELECT query_id, bool_or(source = 'permanent_kg') AS own, bool_or(source = 'web_retrieved') AS web FROM gg GROUP BY 1), "
    "ua AS (SELECT query_id, string_agg(x, '|' ORDER BY x) AS acts FROM (SELECT DISTINCT query_id, unnest(acts) AS x FROM gg) GROUP BY 1), us AS (SELECT query_id, string_agg(x, '|' ORDER BY x) AS sections FROM (SELECT DISTINCT query_id, unnest(sections) AS x FROM gg) GROUP BY 1) "
    "SELECT query_id, CASE WHEN own AND web THEN 'hybrid' WHEN web THEN 'temporary_pool' ELSE 'permanent_kg' END AS source, coalesce(acts, '') AS acts, coalesce(sections, '') AS sections FROM u LEFT JOIN ua USING (query_id) LEFT JOIN us USING (query_id)"
)
def answer_sources(spark: SparkSession, root: str) -> DataFrame:
    return A.sources(_gated(spark, root)).withColumns({c: F.array_join(c, "|") for c in ("acts", "sections")})


def _or_else(c: str, n: int, other: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter(coalesce({c}, {_EMPTY}), lambda x: x IS NOT NULL)[1:{n}], ', '), ''), '{other}')"


_PASSAGES = "CASE WHEN len(coalesce(relevant_chunks, CAST([] AS VARCHAR[]))) = 0 THEN '    (No text passages available)' ELSE array_to_string(list_transform(relevant_chunks[1:3], lambda c: '    • ' || " + K._strip2("substr(c, 1, 400)") + " || CASE WHEN length(c) > 400 THEN '...' ELSE '' END), chr(10)) END"


@query(
    f"WITH {_GATED}, bl AS (SELECT query_id, rank, 'Case ' || rank || ': ' || coalesce(nullif(case_name, ''), case_id) || chr(10) || 'Court: ' || coalesce(nullif(court, ''), 'Supreme Court of India') || chr(10) || 'Date: ' || coalesce(nullif(decision_date, ''), 'Unknown') || chr(10) || "
    f"'Acts: ' || {_or_else('acts', 1000, 'Not specified')} || chr(10) || 'Sections: ' || {_or_else('sections', 1000, 'Not specified')} || chr(10) || 'Judges: ' || {_or_else('judges', 3, 'Not specified')} || chr(10) || 'Petitioners: ' || {_or_else('petitioners', 2, 'Not specified')} || chr(10) || "
    f"'Respondents: ' || {_or_else('respondents', 2, 'Not specified')} || chr(10) || 'Passages:' || chr(10) || {_PASSAGES} AS b FROM gg), cs AS (SELECT query_id, count(*) AS n, string_agg(b, chr(10) ORDER BY rank) AS cases FROM bl GROUP BY 1) "
    "SELECT query_id, concat_ws(chr(10), 'Answer as JSON.', 'Answer in ' || CASE detected_language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.LANGUAGES.items()) + " END, 'Query: ' || coalesce(original_query, ''), 'Domain: ' || coalesce(legal_domain, ''), 'Incident: ' || coalesce(incident_type, ''), "
    f"'Acts: ' || {_or_else('suggested_acts', 1000, 'Not identified')}, 'Sections: ' || {_or_else('suggested_sections', 1000, 'Not identified')}, 'Concepts: ' || {_or_else('expanded_concepts', 5, 'Not identified')}, CASE WHEN n IS NULL THEN 'No evidence found.' ELSE 'Evidence (' || n || '):' || chr(10) || cases END) AS prompt FROM legal_queries LEFT JOIN cs USING (query_id)"
)
def answer_prompts(spark: SparkSession, root: str) -> DataFrame:
    return A.prompts(table(spark, root, "legal_queries"), _gated(spark, root), header="Answer as JSON.")


@query(
    f"WITH {_OWN}, ab AS (SELECT query_id, max(case_id) FILTER (rank = 1) AS c1, max(case_name) FILTER (rank = 1) AS n1, max(case_id) FILTER (rank = 2) AS c2, max(case_id) FILTER (rank = 3) AS c3 FROM o GROUP BY 1), "
    "fn AS (SELECT o.query_id, min_by(o.case_id, o.rank) AS byname FROM o JOIN ab ON ab.query_id = o.query_id AND o.case_name = ab.n1 AND ab.n1 <> '' GROUP BY 1), "
    "ow AS (SELECT query_id, string_agg(case_id || ':true', '|' ORDER BY rank) AS own FROM o GROUP BY 1), "
    "ua AS (SELECT query_id, string_agg(x, '|' ORDER BY x) AS acts FROM (SELECT DISTINCT query_id, unnest(acts) AS x FROM o) GROUP BY 1) "
    "SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'Insufficient evidence found.' ELSE 'answer ' || query_id END AS summary, CASE WHEN query_id % 3 = 2 THEN 'Told Act, 1950' ELSE coalesce(acts, '') END AS acts, "
    "CASE WHEN query_id % 3 < 2 THEN own ELSE coalesce(c2, c1, 'none') || ':true|' || coalesce(byname, c2, 'other') || ':' || CASE WHEN coalesce(byname, c2) IS NULL THEN 'false' ELSE 'true' END || '|' || coalesce(c3, 'zz') || ':' || CASE WHEN c3 IS NULL THEN 'false' ELSE 'true' END END AS precedents "
    "FROM ab LEFT JOIN fn USING (query_id) LEFT JOIN ow USING (query_id) LEFT JOIN ua USING (query_id)"
)
def answers_assembled(spark: SparkSession, root: str) -> DataFrame:
    """Answers of three kinds: none, one without precedents, one whose precedents are linked by id, by name and by place."""
    own = _own(spark, root)
    pick = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    at = own.groupBy("query_id").agg(pick("case_id", 1).alias("c1"), pick("case_name", 1).alias("n1"), pick("case_id", 2).alias("c2"))
    precedent = lambda cid, name: F.struct(cid.alias("case_id"), name.alias("case"))
    told = F.array(precedent(F.coalesce("c2", "c1", F.lit("none")), F.lit("-")), precedent(F.lit("other"), F.col("n1")), precedent(F.lit("zz"), F.lit("--")))
    summary = F.concat(F.lit("answer "), F.col("query_id").cast("string"))
    raw = F.when(F.col("query_id") % 3 == 1, F.to_json(F.struct(summary.alias("summary")))).when(
        F.col("query_id") % 3 == 2, F.concat(F.lit("```json\n"), F.to_json(F.struct(summary.alias("summary"), F.array(F.lit("Told Act, 1950")).alias("applicable_acts"), told.alias("precedents"))), F.lit("\n```")))
    a = A.assemble(at.select("query_id", raw.alias("raw")), own)
    shown = F.array_join(F.transform("precedents", lambda p: F.concat(p["case_id"], F.lit(":"), p["linked"].cast("string"))), "|")
    return a.select("query_id", "summary", F.array_join("applicable_acts", "|").alias("acts"), shown.alias("precedents"))


@query("SELECT query_id, CAST(len(coalesce(suggested_acts, CAST([] AS VARCHAR[]))) AS VARCHAR) || ' relevant case(s) found for ' || coalesce(incident_type, 'the query') AS summary, array_to_string(coalesce(suggested_acts, CAST([] AS VARCHAR[])), '|') AS acts FROM legal_queries")
def fallback_answers(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "legal_queries")
    acts = F.coalesce("suggested_acts", F.array().cast("array<string>"))
    raw = A.fallback(F.size(acts), F.col("incident_type"), acts, F.array().cast("array<string>"))
    return q.select("query_id", evidence.parse_answer(raw, A.ANSWER).alias("a")).select("query_id", "a.summary", F.array_join("a.applicable_acts", "|").alias("acts"))


# ------------------------------------------------------------------ chunks, pages, staging


@query("SELECT coalesce(nullif(case_id, ''), nullif(source, ''), 'unknown') AS case_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY doc_id, text)) AS digest FROM documents WHERE coalesce(text, '') <> '' GROUP BY 1")
def case_chunk_groups(spark: SparkSession, root: str) -> DataFrame:
    g = chunking.case_chunks(table(spark, root, "documents"), source="source", index="doc_id")
    return g.select("case_id", F.size("texts").cast("long").alias("n"), F.md5(F.array_join("texts", "|").cast("binary")).alias("digest"))


@query("SELECT query_id AS place, doc_id AS row, source FROM legal_queries q JOIN documents d ON d.doc_id = (SELECT min(doc_id) FROM documents) + q.query_id % 50")
def chunks_by_row(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select(F.col("doc_id").alias("row"), "source")
    low = d.agg(F.min("row")).first()[0] or 0
    wanted = table(spark, root, "legal_queries").select(F.col("query_id").alias("place"), (F.lit(low) + F.col("query_id") % 50).alias("row"))
    there = wanted.join(d.select("row"), "row", "left_semi")
    return chunking.chunks_at(d, there).select("place", "row", "source")


@query("SELECT coalesce(v, m) AS row, CASE WHEN m IS NULL THEN 'metadata' ELSE 'vectors' END AS missing FROM (SELECT DISTINCT vec_id AS v FROM embeddings) FULL JOIN (SELECT DISTINCT doc_id AS m FROM documents) ON v = m WHERE v IS NULL OR m IS NULL")
def index_consistency(spark: SparkSession, root: str) -> DataFrame:
    return chunking.index_gaps(table(spark, root, "embeddings").select(F.col("vec_id").alias("row")), table(spark, root, "documents").select(F.col("doc_id").alias("row")))


@query(
    "SELECT DISTINCT doc_id, page_num, q.blur_score < 100 AS is_blurry, abs(q.skew_angle) > 0.5 AS has_significant_skew, q.contrast_score < 40 AS has_low_contrast, q.noise_level > 0.35 AS is_noisy, "
    "CASE CAST(q.blur_score < 100 AS INT) + CAST(q.contrast_score < 40 AS INT) + CAST(q.noise_level > 0.35 AS INT) WHEN 0 THEN 'gentle' WHEN 1 THEN 'standard' ELSE 'aggressive' END AS strategy FROM (SELECT doc_id, page_num, quality_report AS q FROM page_details WHERE quality_report IS NOT NULL)"
)
def page_quality(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "page_details").where("quality_report IS NOT NULL")
    return p.select("doc_id", "page_num", evidence.page_quality(F.col("quality_report")).alias("_q")).select("doc_id", "page_num", "_q.*").distinct()


RULES = {"tbe": "the", "arid": "and", "Hon'b1e": "Hon'ble"}
_FIXED = "regexp_replace(regexp_replace(regexp_replace(t, '\\btbe\\b', 'the', 'g'), '\\barid\\b', 'and', 'g'), '\\bHon''b1e\\b', 'Hon''ble', 'g')"
_HEADING = lambda c: f"(upper({c}) = {c} AND lower({c}) <> {c} AND length({c}) < 80)"
_PARAGRAPHS = (
    K._PAGE_LINES.replace("SELECT DISTINCT doc_id, page_num, text FROM page_details", "SELECT DISTINCT doc_id, page_num, text FROM page_details WHERE mode = 'ocr'")
    + f", li AS (SELECT doc_id, page_num, pos, {K._strip2('line')} AS t, lag(pos) OVER (PARTITION BY doc_id, page_num ORDER BY pos) AS prev FROM k WHERE key <> ''), "
    f"fl AS (SELECT *, CASE WHEN prev IS NULL OR (pos - prev) * 20 - 18 > 14.4 OR {_HEADING('t')} THEN 1 ELSE 0 END AS new FROM li), "
    "nu AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_num ORDER BY pos) AS p FROM fl), pg AS (SELECT doc_id, page_num, p, string_agg(t, ' ' ORDER BY pos) AS t FROM nu GROUP BY 1, 2, 3), "
    "pt AS (SELECT doc_id, page_num, string_agg(t, chr(10) || chr(10) ORDER BY p) AS t FROM pg GROUP BY 1, 2)"
)
SQL["ocr_paragraphs"] = f"WITH {_PARAGRAPHS} SELECT doc_id, page_num, t AS text FROM pt"
_POST = (
    _PARAGRAPHS + ", pa AS (SELECT doc_id, page_num, max(confidence) AS c, bool_or(is_low_confidence) AS low FROM page_details WHERE mode = 'ocr' GROUP BY 1, 2), "
    f"pp AS (SELECT doc_id, page_num, CASE WHEN coalesce(low, false) THEN '[LOW_CONFIDENCE: ' || CAST(floor(coalesce(c, 0) * 100) AS INT) || '% — Page ' || page_num || ' — verify manually]' || chr(10) ELSE '' END || "
    + K._strip2(f"regexp_replace(regexp_replace(coalesce({_FIXED}, ''), '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), ' {{{{2,}}}}', ' ', 'g')") + " AS text FROM pa LEFT JOIN pt USING (doc_id, page_num))"
).replace("{{", "{").replace("}}", "}")


def _pages(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "page_details").where("mode = 'ocr'").groupBy("doc_id", "page_num").agg(F.max("confidence").alias("confidence"), F.max("is_low_confidence").alias("is_low_confidence"))
    return cleaning.postprocess_pages(K._ocr_lines(spark, root), p, RULES)


@query(f"WITH {_POST} SELECT * FROM pp")
def ocr_pages(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root)


def _without_repeated(source: str) -> str:
    """SQL that leaves out of ``source`` (doc_id, text) the lines that stand more than three times, white space collapsed."""
    return (
        f"dl AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, {K._lines2('text')} AS ls FROM {source})), dk AS (SELECT *, lower({K._collapse2('line')}) AS key FROM dl), "
        "dn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM dk), du AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key = '' OR c <= 3), '') AS t FROM dn GROUP BY 1)"
    )


@query(
    f"WITH {_POST}, dj AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM pp WHERE {K._strip2('text')} <> '' GROUP BY 1), {_without_repeated('dj')} "
    "SELECT doc_id, " + K._strip2("regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')") + " AS text FROM du"
)
def ocr_documents(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.postprocess_documents(_pages(spark, root))


_NUMBERS = "'^(\\p{Nd}+|-\\s*\\p{Nd}+\\s*-|(?i:page)\\s+\\p{Nd}+(\\s+(?i:of)\\s+\\p{Nd}+)?|\\[\\s*\\p{Nd}+\\s*\\])$'"


def _tidy(source: str) -> str:
    """SQL of the last steps of cleaning: spaces, page numbers, blank lines."""
    lines = K._lines2("regexp_replace(replace(t, chr(9), ' '), ' {2,}', ' ', 'g')")
    return (
        f"s1 AS (SELECT doc_id, array_to_string(list_transform({lines}, lambda x: regexp_replace(x, '{{WS}}+$', '')), chr(10)) AS t FROM {source}), s2 AS (SELECT doc_id, array_to_string(list_filter({K._lines2('t')}, lambda x: NOT regexp_matches({K._strip2('x')}, {_NUMBERS})), chr(10)) AS t FROM s1), "
        "s3 AS (SELECT doc_id, " + K._strip2("regexp_replace(t, '(\\n[ \\t]*){2,}', chr(10) || chr(10), 'g')") + " AS text FROM s2)"
    )


_MARKS = f"array_to_string(list_filter({K._lines2('text')}, lambda x: NOT regexp_matches({K._strip2('x')}, '(?i)^---\\s*page\\s+\\p{{Nd}}+\\s+of\\s+\\p{{Nd}}+\\s*---$')), chr(10))".replace("{{", "{").replace("}}", "}")
SQL["clean_document"] = f"WITH s0 AS (SELECT doc_id, {_MARKS} AS t FROM document_results WHERE text IS NOT NULL), {_tidy('s0')} SELECT doc_id, text FROM document_results r LEFT JOIN s3 USING (doc_id)".replace("SELECT doc_id, text FROM document_results r LEFT JOIN s3 USING (doc_id)", "SELECT r.doc_id, s3.text FROM document_results r LEFT JOIN s3 ON s3.doc_id = r.doc_id")


@query(
    f"WITH c0 AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS text, generate_subscripts(string_split(text, chr(12)), 1) AS page_num FROM (SELECT doc_id, coalesce(text, '') AS text FROM document_results)), page AS (SELECT doc_id, page_num, {_MARKS} AS text FROM c0), "
    + K._EDGES.replace("SELECT DISTINCT doc_id, page_num, text FROM page_details", "SELECT doc_id, page_num, text FROM page").replace("FROM page_details GROUP BY 1", "FROM page GROUP BY 1")
    + ", ke AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = k.doc_id AND r.key = k.key)), pgs AS (SELECT a.doc_id, a.page_num, coalesce(string_agg(ke.line, chr(10) ORDER BY ke.pos), '') AS t FROM page a LEFT JOIN ke ON ke.doc_id = a.doc_id AND ke.page_num = a.page_num GROUP BY 1, 2), "
    f"dd AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_num) AS t FROM pgs GROUP BY 1), {_tidy('dd')} SELECT * FROM s3"
)
def clean_documents(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.clean_documents(table(spark, root, "document_results"))


@query("SELECT DISTINCT doc_id, " + K._collapse2("regexp_replace(headline, '<[^>]+>', ' ', 'g')") + " AS text FROM staged_cases WHERE headline IS NOT NULL")
def full_document_texts(spark: SparkSession, root: str) -> DataFrame:
    from casegrain.functions import text as T

    return table(spark, root, "staged_cases").where("headline IS NOT NULL").select("doc_id", T.collapse(evidence.strip_html(F.col("headline"), " ")).alias("text")).distinct()


@query("SELECT _status AS status, count(DISTINCT _staging_hash) AS cases, max(_staged_at) AS last FROM staged_cases GROUP BY 1")
def staging_tallies(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "staged_cases").groupBy(F.col("_status").alias("status")).agg(F.count_distinct("_staging_hash").alias("cases"), F.max("_staged_at").alias("last"))


SQL["staging_case_keys"] = (
    "SELECT DISTINCT doc_id, coalesce(nullif(array_to_string(list_filter(string_split_regex(lower(regexp_replace(title, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\x{200c}\\x{200d}\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')), '{WS}+'), lambda w: w <> '')[1:6], '_'), ''), 'web_case') AS key FROM staged_cases"
)

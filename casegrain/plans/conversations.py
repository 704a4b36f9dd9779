"""Queries over conversations and their SQL, written from the meaning of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.operators import conversation as C
from casegrain.operators import understanding
from casegrain.plans.catalogue import query
from casegrain.sources.tables import table


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _case(rows: list[tuple[str, object]]) -> str:
    shown = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return "CASE " + " ".join(f"WHEN {hit} THEN {shown(v)}" for hit, v in rows) + " END"


_FACTS = (
    "m AS (SELECT query_id // 8 AS conv_id, query_id AS turn, original_query AS content, lower(original_query) AS low FROM legal_queries WHERE regexp_replace(coalesce(original_query, ''), '{WS}', '', 'g') <> ''), f AS (SELECT *, "
    "list_transform(regexp_extract_all(low, '\\bsection\\s+([0-9]+[a-z]?)\\b', 1), lambda x: upper(x)) AS sections, "
    + _case([(_any("low", w.split()), i) for i, _, w in C.INCIDENTS]) + " AS incident, " + _case([(_any("low", w.split()), d) for _, d, w in C.INCIDENTS]) + " AS legal_domain, "
    + _case([(f"regexp_matches(low, '\\b{w}\\b')", v) for v, ws in C.VEHICLES for w in ws.split()]) + " AS vehicle, "
    + "coalesce(" + _case([(_any("low", [c]), s) for c, s in C.CITIES]) + ", " + _case([(_any("low", [s]), s.title()) for s in C.STATES]) + ") AS state, "
    + _case([(_any("low", [c]), c.title()) for c, _ in C.CITIES]) + " AS city, " + _case([(_any("low", w), v) for v, w in C.INJURIES]) + " AS injury, "
    + _case([(_any("low", w), v) for v, w in C.FIR]) + " AS fir_filed, nullif(replace(regexp_extract(low, '(?:rs\\.?|inr|rupees?)\\s*([0-9][0-9,]*)', 1), ',', ''), '') AS cheque_amount, "
    + _case([("contains(low, 'notice') AND " + _any("low", w), v) for v, w in C.NOTICE]) + " AS notice_sent FROM m)"
)
_STATES = (
    _FACTS + ", l AS (SELECT conv_id, string_agg(x, '|' ORDER BY place) AS sections FROM (SELECT conv_id, x, min(turn * 1000 + i) AS place FROM (SELECT conv_id, turn, unnest(sections) AS x, generate_subscripts(sections, 1) AS i FROM f) GROUP BY 1, 2) GROUP BY 1), "
    "s AS (SELECT conv_id, " + ", ".join(f"arg_min({c}, turn) FILTER ({c} IS NOT NULL) AS {c}" for c in C.SCALARS)
    + ", count(*) AS turn_count, list(content ORDER BY turn)[-3:] AS said, string_agg(content, ' ' ORDER BY turn) AS all_said FROM f GROUP BY 1), "
    "t AS (SELECT s.*, coalesce(l.sections, '') AS sections FROM s LEFT JOIN l USING (conv_id))"
)


_PLAIN = [f"CAST({c} AS VARCHAR) AS {c}" if c in ("fir_filed", "notice_sent") else c for c in C.SCALARS]


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "legal_queries").select(F.expr("query_id div 8").alias("conv_id"), F.col("query_id").alias("turn"), F.col("original_query").alias("content"))


def _states(spark: SparkSession, root: str) -> DataFrame:
    return C.states(_messages(spark, root))


@query(f"WITH {_FACTS} SELECT turn, array_to_string(sections, '|') AS sections, {', '.join(_PLAIN)} FROM f")
def message_facts(spark: SparkSession, root: str) -> DataFrame:
    told = _messages(spark, root).where("trim(coalesce(content, '')) != ''").withColumn("_f", C.facts(F.col("content")))
    return told.select("turn", F.array_join("_f.sections", "|").alias("sections"), *[F.col(f"_f.{s}").cast("string").alias(s) for s in C.SCALARS])


@query(f"WITH {_STATES} SELECT conv_id, sections, turn_count, array_to_string(said, ' | ') AS said, {', '.join(_PLAIN)} FROM t")
def conversation_facts(spark: SparkSession, root: str) -> DataFrame:
    return _states(spark, root).select("conv_id", F.array_join("sections", "|").alias("sections"), "turn_count", F.array_join("said", " | ").alias("said"), *[F.col(s).cast("string").alias(s) for s in C.SCALARS])


_SHOWN = {"fir_filed": "CASE WHEN fir_filed THEN 'Yes' ELSE 'No' END", "notice_sent": "CASE WHEN notice_sent THEN 'Yes' ELSE 'No' END", "sections": "replace(nullif(sections, ''), '|', ', ')"}
_TOLD = [s for s in C.DECLARED if s in (*C.SCALARS, "sections")]
_THERE = "list_filter([" + ", ".join(f"CASE WHEN {'nullif(sections, {q})'.replace('{q}', chr(39) * 2) if s == 'sections' else s} IS NOT NULL THEN '{s}' END" for s in _TOLD) + "], lambda x: x IS NOT NULL)"


@query(
    f"WITH {_STATES} SELECT conv_id, array_to_string({_THERE}, ',') AS filled, coalesce(nullif(array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {'nullif(sections, {q})'.replace('{q}', chr(39) * 2) if s == 'sections' else s} IS NOT NULL THEN '{s.replace('_', ' ').title()}: ' || {_SHOWN.get(s, s)} END" for s in _TOLD)
    + "], lambda x: x IS NOT NULL), '; '), ''), 'No facts collected yet.') AS summary FROM t"
)
def conversation_summaries(spark: SparkSession, root: str) -> DataFrame:
    s = _states(spark, root)
    return s.select("conv_id", F.array_join(C.filled(s), ",").alias("filled"), C.summary(s).alias("summary"))


def _list(xs: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"


_REGISTRY = " UNION ALL ".join(f"SELECT '{i}' AS incident, {_list(n)} AS need, {_list(h)} AS helps, {k} AS n" for i, n, h, k in C.SLOTS)


@query(
    f"WITH {_STATES}, r AS ({_REGISTRY}), a AS (SELECT t.conv_id, t.incident, turn_count, {_THERE.replace('incident IS NOT', 't.incident IS NOT')} AS there, coalesce(need, {_list(C.OTHERWISE[0])}) AS need, coalesce(helps, {_list(C.OTHERWISE[1])}) AS helps, coalesce(n, 1) AS n FROM t LEFT JOIN r ON r.incident = t.incident), "
    "b AS (SELECT *, list_filter(need, lambda x: NOT list_contains(there, x)) AS mr, list_filter(helps, lambda x: NOT list_contains(there, x)) AS mh, incident IS NULL AS none FROM a), "
    "c AS (SELECT *, NOT none AND (len(need) - len(mr) >= n OR turn_count >= 4) AS ready FROM b) "
    "SELECT conv_id, ready AS is_ready, CASE WHEN none THEN 'incident' ELSE array_to_string(mr, ',') END AS missing_required, CASE WHEN none THEN '' ELSE array_to_string(mh, ',') END AS missing_helpful, "
    "CASE WHEN ready THEN NULL WHEN none THEN 'incident' ELSE list_concat(mr, mh[1:1])[1] END AS next_slot, CASE WHEN none THEN 0 ELSE len(need) - len(mr) END AS filled_count, CASE WHEN none THEN 1 ELSE n END AS required_count FROM c"
)
def conversation_slots(spark: SparkSession, root: str) -> DataFrame:
    s = C.check_slots(_states(spark, root))
    return s.withColumn("missing_required", F.array_join("missing_required", ",")).withColumn("missing_helpful", F.array_join("missing_helpful", ","))


_HITS = [_any("lower(coalesce(incident, ''))", w) + (f" OR contains(lower(array_to_string(said, ' | ')), '{x}')" if x else "") for w, x, _, _ in C.DEFAULTS]
_DOCTRINE = "CASE legal_domain " + " ".join(f"WHEN '{d}' THEN {_list(c)}" for d, c in C.DOCTRINES.items()) + " ELSE CAST([] AS VARCHAR[]) END"


@query(
    f"WITH {_STATES} SELECT conv_id, array_to_string(said, ' | ') AS original_query, CASE WHEN regexp_matches(all_said, '[\\x{{0B80}}-\\x{{0BFF}}]') THEN 'ta' WHEN list_has_any(regexp_extract_all(lower(all_said), '\\b[a-z]+\\b'), {_list(C.ROMAN)}) THEN 'ta_roman' ELSE 'en' END AS detected_language, "
    "coalesce(legal_domain, 'General') AS legal_domain, coalesce(incident, 'Legal Dispute') AS incident_type, "
    "array_to_string(list_filter([lower(incident), lower(vehicle), lower(injury), CASE WHEN fir_filed THEN 'FIR' WHEN NOT fir_filed THEN 'no FIR' END], lambda x: x IS NOT NULL), '|') AS keywords, "
    "CASE " + " ".join(f"WHEN {h} THEN '{'|'.join(a)}'" for h, (_, _, a, _) in zip(_HITS, C.DEFAULTS)) + " ELSE '' END AS suggested_acts, "
    "CASE WHEN sections <> '' THEN sections " + " ".join(f"WHEN {h} THEN '{'|'.join(n)}'" for h, (_, _, _, n) in zip(_HITS, C.DEFAULTS)) + " ELSE '' END AS suggested_sections, "
    f"array_to_string(list_concat({_DOCTRINE}, CASE WHEN incident IS NULL THEN CAST([] AS VARCHAR[]) ELSE [lower(incident)] END)[1:8], '|') AS expanded_concepts, "
    "coalesce(nullif(array_to_string(list_filter(list_concat([incident, vehicle || ' accident'], list_transform(string_split(nullif(sections, ''), '|'), lambda x: 'Section ' || x), [injury || ' injury', state]), lambda x: x IS NOT NULL), ' '), ''), 'legal dispute India') AS search FROM t"
)
def conversation_rewrites(spark: SparkSession, root: str) -> DataFrame:
    r = C.rewrite(_states(spark, root))
    return r.withColumns({c: F.array_join(c, "|") for c in ("keywords", "suggested_acts", "suggested_sections", "expanded_concepts")}).drop("key_entities")

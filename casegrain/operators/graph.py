"""The graph of cases as node and edge tables, and search over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions import text as T

RELATIONS = {"judges": "DECIDED_BY", "acts": "UNDER_ACT", "sections": "INVOLVES_SECTION", "petitioners": "HAS_PETITIONER", "respondents": "HAS_RESPONDENT"}

SLOTS = 1 << 16


def clean_name(c: Column) -> Column:
    return F.coalesce(T.collapse(c), F.lit(""))


def edges(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, rel, dst): one edge for each distinct name in a case's lists, and one for its court.

    Null and blank names make no edge. All lists are read in one pass; the distinct is partial before the shuffle."""
    def entry(c: str, rel: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(rel).alias("rel"), clean_name(x).alias("dst")))

    entries = [entry(c, rel) for c, rel in RELATIONS.items()]
    court = F.array(F.struct(F.lit("HEARD_IN").alias("rel"), clean_name(F.col("court")).alias("dst")))
    return (
        cases.where(F.col(case).isNotNull()).select(F.col(case), F.explode(F.concat(court, *entries)).alias("_e"))
        .select(case, "_e.rel", "_e.dst").where("dst != ''").distinct()
    )


def nodes(edge_table: DataFrame, case: str = "case_id") -> DataFrame:
    """(label, name, cases): every node once, with the number of cases at it."""
    label = F.create_map(*[F.lit(x) for kv in {
        "HEARD_IN": "Court", "DECIDED_BY": "Judge", "UNDER_ACT": "Act", "INVOLVES_SECTION": "Section", "HAS_PETITIONER": "Party", "HAS_RESPONDENT": "Party"}.items() for x in kv])
    return edge_table.select(F.try_element_at(label, F.col("rel")).alias("label"), F.col("dst").alias("name"), case).distinct().groupBy("label", "name").agg(F.count(F.lit(1)).alias("cases"))


def upsert(table: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last writer wins: of each key the row of the greatest order, attributes taken whole."""
    rest = [c for c in table.columns if c not in (*key, order)]
    return table.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*key, "_v.*")


def metadata(edge_table: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, courts, judges, acts, sections, petitioners, respondents): each a sorted list of distinct names.

    One aggregation over all relations, in place of a product of optional matches."""
    pick = lambda rel: F.array_sort(F.collect_set(F.when(F.col("rel") == rel, F.col("dst"))))
    return edge_table.groupBy(case).agg(pick("HEARD_IN").alias("courts"), *[pick(rel).alias(c) for c, rel in RELATIONS.items()])


def containing(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, term): names that hold a term, without regard to case.

    Of a term's pieces of three letters the one that the fewest names hold is looked up, so that a frequent beginning is
    no hot key; terms of one or two letters are looked up whole. Blank and null terms match nothing. Names in pieces are a
    hundred times what the planner takes them for, so no join here is left to its estimates: what is broadcast are the
    numbers, below ``SLOTS``, of the pieces looked up, which drop most other pieces before the shuffle; all else is merged."""
    n = names.select("name").distinct().where("name IS NOT NULL")
    t = terms.select("term").distinct().where(T.strip(F.coalesce("term", F.lit(""))) != "").withColumn("_t", F.lower("term"))
    pieces = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))
    low = F.lower("name")
    keyed = n.withColumn("_key", F.explode(F.array_distinct(F.concat(pieces(low, 1), pieces(low, 2), pieces(low, 3)))))
    frequency = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_names"))
    asked = t.withColumn("_key", F.explode(F.array_distinct(F.when(F.length("_t") >= 3, pieces(F.col("_t"), 3)).otherwise(F.array("_t")))))
    # A piece no name holds ends the search for its term: no name holds the term either.
    rarest = asked.hint("merge").join(frequency, "_key", "left").groupBy("term", "_t").agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_key")).alias("_k")).where("_k.n > 0").select("term", "_t", F.col("_k._key").alias("_key"))
    slot = F.pmod(F.hash("_key"), F.lit(SLOTS))
    wanted = keyed.withColumn("_slot", slot).join(F.broadcast(rarest.select(slot.alias("_slot")).distinct()), "_slot", "left_semi").drop("_slot")
    return wanted.hint("merge").join(rarest, "_key").where(F.contains(low, F.col("_t"))).select("name", "term").distinct()


def act_hits(edge_table: DataFrame, queries: DataFrame, case: str = "case_id") -> DataFrame:
    """(query_id, case, hits, match_type): for each case the acts that hold one of the query's act names."""
    asked = queries.select("query_id", F.explode("suggested_acts").alias("term")).distinct()
    acts = edge_table.where("rel = 'UNDER_ACT'").select(case, F.col("dst").alias("name"))
    matched = asked.join(containing(acts, asked), "term").select("query_id", "name").distinct()
    return matched.join(acts, "name").groupBy("query_id", case).agg(F.count(F.lit(1)).alias("hits")).withColumn("match_type", F.lit("act"))


def section_hits(edge_table: DataFrame, queries: DataFrame, case: str = "case_id") -> DataFrame:
    """Equality of section numbers, whatever their kind."""
    asked = queries.select("query_id", F.explode("suggested_sections").alias("dst")).where("dst IS NOT NULL").distinct()
    found = edge_table.where("rel = 'INVOLVES_SECTION'").join(asked, "dst")
    return found.groupBy("query_id", case).agg(F.count(F.lit(1)).alias("hits")).withColumn("match_type", F.lit("section"))


def keyword_hits(cases: DataFrame, queries: DataFrame, case: str = "case_id", most: int = 10) -> DataFrame:
    """One hit for each case whose name holds one of the query's first keywords."""
    asked = queries.select("query_id", F.explode(F.slice("keywords", 1, most)).alias("term")).distinct()
    names = cases.select(F.col(case), F.col("case_name").alias("name")).where("name IS NOT NULL").distinct()
    found = asked.join(containing(names, asked), "term").join(names, "name")
    return found.select("query_id", case).distinct().withColumn("hits", F.lit(1).cast("long")).withColumn("match_type", F.lit("keyword"))


def concept_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", case: str = "case_id") -> DataFrame:
    """(case, concept): the concepts of each document."""
    from casegrain.operators.extraction import concepts

    return docs.select(F.col(id_col).alias(case), F.explode(concepts(F.col(text_col))).alias("concept")).distinct()


def concept_hits(edge_table: DataFrame, queries: DataFrame, case: str = "case_id") -> DataFrame:
    """Hits by concepts of which another name holds a keyword or the whole query, or whose name holds the incident.

    The concepts are few and fixed, so each query is compared with them in its own row; blank terms match nothing."""
    from casegrain.operators.extraction import CONCEPTS

    terms = F.filter(F.transform(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.array("original_query")), F.lower), lambda x: T.strip(F.coalesce(x, F.lit(""))) != "")
    incident = F.lower(F.coalesce("incident_type", F.lit("")))

    def hit(name: str, aliases: list[str]) -> Column:
        by_alias = F.exists("_terms", lambda t: F.exists(F.array(*[F.lit(a.lower()) for a in aliases]), lambda a: F.contains(a, t)))
        return by_alias | ((T.strip(incident) != "") & F.contains(F.lit(name.lower()), incident))

    asked = queries.withColumn("_terms", terms)
    found = F.array_compact(F.array(*[F.when(hit(name, aliases), F.lit(cid)) for cid, name, _, _, aliases in CONCEPTS]))
    matched = asked.select("query_id", F.explode(found).alias("concept")).distinct().join(edge_table, "concept")
    return matched.groupBy("query_id", case).agg(F.count(F.lit(1)).alias("hits")).withColumn("match_type", F.lit("concept"))


def build_graph(graphs: DataFrame) -> DataFrame:
    """Nested graphs with what is invalid left out.

    ``graphs``: case_name, decision_date, language, court, judges array<string>, acts array<struct<name, year>>, sections
    array<struct<type, number>>, parties array<struct<name, role>>, relationships array<struct<subject, relation, object>>
    (other columns pass through). Names lose outer and double spaces; a statute needs a year from 1800 to 2100, a section
    its kind and number, a party one of two roles; of the relationships those of a case to the label at their end stay."""
    from casegrain.operators.extraction import ENDS

    rows = lambda c, keep, make: F.filter(F.transform(F.filter(F.col(c), lambda x: x.isNotNull()), make), keep)
    permitted = F.array(*[F.lit(f"Case|{r}|{o}") for r, o in ENDS.items()])
    return graphs.withColumns({
        "case_name": clean_name(F.col("case_name")), "decision_date": clean_name(F.col("decision_date")), "language": F.coalesce(F.nullif(clean_name(F.col("language")), F.lit("")), F.lit("English")),
        "court": clean_name(F.col("court")), "judges": rows("judges", lambda x: x != "", clean_name),
        "acts": rows("acts", lambda a: (a["name"] != "") & a["year"].between(1800, 2100), lambda a: F.struct(clean_name(a["name"]).alias("name"), a["year"].alias("year"))),
        "sections": rows("sections", lambda s: (s["type"] != "") & (s["number"] != ""), lambda s: F.struct(clean_name(s["type"]).alias("type"), clean_name(s["number"]).alias("number"))),
        "parties": rows("parties", lambda p: (p["name"] != "") & p["role"].isin("Petitioner", "Respondent"), lambda p: F.struct(clean_name(p["name"]).alias("name"), clean_name(p["role"]).alias("role"))),
        "relationships": F.filter("relationships", lambda r: F.array_contains(permitted, F.concat_ws("|", r["subject"], r["relation"], r["object"]))),
    })


def graph_tables(graphs: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of built graphs: what loading them would merge.

    Nodes (label, key, value): one for each key; the value (a case's date and language, a statute's year) is that of the
    greatest ``order``. Edges (case_name, rel, key) of declared relations, each once, and only between nodes that are there."""
    entry = lambda label, key, value=None: F.struct(F.lit(label).alias("label"), key.alias("key"), (value if value is not None else F.lit("")).cast("string").alias("value"))
    section = lambda s: F.concat_ws(" ", s["type"], s["number"])
    listed = F.concat(
        F.array(entry("Case", F.col("case_name"), F.concat_ws("|", "decision_date", "language")), entry("Court", F.col("court"))), F.transform("judges", lambda j: entry("Judge", j)),
        F.transform("acts", lambda a: entry("Act", a["name"], a["year"])), F.transform("sections", lambda s: entry("Section", section(s))), F.transform("parties", lambda p: entry("Party", p["name"])),
    )
    nodes_ = graphs.select(F.explode(listed).alias("_n"), order).select("_n.*", order).where("key != ''").groupBy("label", "key").agg(F.max_by("value", F.struct(order, "value")).alias("value"))
    party = lambda role: F.transform(F.filter("parties", lambda p: p["role"] == role), lambda p: p["name"])
    ends = {
        "HEARD_IN": ("Court", F.array("court")), "DECIDED_BY": ("Judge", F.col("judges")), "UNDER_ACT": ("Act", F.transform("acts", lambda a: a["name"])),
        "INVOLVES_SECTION": ("Section", F.transform("sections", section)), "HAS_PETITIONER": ("Party", party("Petitioner")), "HAS_RESPONDENT": ("Party", party("Respondent")),
    }
    declared = F.transform("relationships", lambda r: r["relation"])
    made = F.flatten(F.array(*[
        F.when(F.array_contains(declared, rel), F.transform(keys, lambda k: F.struct(F.lit(rel).alias("rel"), F.lit(label).alias("label"), k.alias("key")))).otherwise(
            F.array().cast("array<struct<rel: string, label: string, key: string>>")) for rel, (label, keys) in ends.items()
    ]))
    raw = graphs.select("case_name", F.explode(made).alias("_e")).select("case_name", "_e.*").where("key != '' AND case_name != ''").distinct()
    cases = nodes_.where("label = 'Case'").select(F.col("key").alias("case_name"))
    return nodes_, raw.join(nodes_.select("label", "key"), ["label", "key"], "left_semi").join(cases, "case_name", "left_semi").select("case_name", "rel", "key")


def load_graph(graphs: DataFrame, order: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables of ``graph_tables``; with a path they are also written there, in place of what was, else nothing is."""
    nodes_, edges_ = graph_tables(build_graph(graphs), order)
    if path is not None:
        nodes_.write.mode("overwrite").parquet(f"{path}/nodes")
        edges_.write.mode("overwrite").parquet(f"{path}/edges")
    return nodes_, edges_


def search(edge_table: DataFrame, cases: DataFrame, queries: DataFrame, k: int = 20, case: str = "case_id", concepts: DataFrame | None = None) -> DataFrame:
    """(query_id, case, raw_score, matched parts, graph_score, rank): the k best cases of each query; ``concepts`` has (case, concept)."""
    from casegrain.operators.ranking import merge_graph_hits, top_n

    hits = reduce(DataFrame.unionByName, [act_hits(edge_table, queries, case), section_hits(edge_table, queries, case), keyword_hits(cases, queries, case)])
    if concepts is not None:
        hits = hits.unionByName(concept_hits(concepts, queries, case))
    return top_n(merge_graph_hits(hits, case=case), k, "query_id", "graph_score", case)


def known_titles(staged: DataFrame, cases: DataFrame, letters: int = 60) -> DataFrame:
    """Staged rows whose title, cut to ``letters``, stands in the name of a known case."""
    t = staged.withColumn("term", F.substring(T.strip(F.col("title")), 1, letters))
    hits = containing(cases.select(F.col("case_name").alias("name")), t.select("term"))
    return t.join(hits.select("term").distinct(), "term", "left_semi").drop("term")


def windowed_best(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")

import numpy as np
from pyspark.sql import functions as F

from casegrain.operators import evidence, graph, ranking, understanding, vectors


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(200, 8)), 2)
    v[50] = v[51]
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "vec_id long, embedding array<float>").repartition(3)
    got = vectors.top_k(df, df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 7).collect()
    v32 = v.astype(np.float32).astype(float)
    for q in (0, 50, 100, 150):
        s = np.round(v32 @ v32[q], 6)
        want = sorted(range(200), key=lambda i: (-s[i], i))[:7]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert vectors.top_k(df.limit(0), df.limit(0).select(F.col("vec_id").alias("query_id"), "embedding"), 7).count() == 0


def test_rank_cases(spark):
    hits = spark.createDataFrame([(1, "a", 0.5, 1, "x"), (1, "a", 0.25, 2, "y"), (1, "b", -0.5, 3, "z")], "query_id int, case_id string, score double, rank int, text string")
    got = {r.case_id: r for r in ranking.rank_cases(hits, "sum", text="text").collect()}
    assert got["a"].score == 0.75 and got["a"].top_chunk_text == "x" and got["b"].top_score == 0.0 and got["b"].top_chunk_text == ""
    assert {r.case_id: r.score for r in ranking.rank_cases(hits, "mean").collect()} == {"a": 0.375, "b": -0.5}


def test_hybrid_feedback_confidence(spark):
    sem = spark.createDataFrame([(1, "a", 0.9, 0.9), (1, "b", 0.4, 0.4)], "query_id int, case_id string, score double, top_score double")
    gph = spark.createDataFrame([(1, "b", 1.0), (1, "c", 0.5)], "query_id int, case_id string, graph_score double")
    ranked = ranking.hybrid_rank(sem, gph)
    assert {r.case_id: r.final_score for r in ranked.collect()} == {"a": 0.9, "b": 0.58, "c": 0.15}
    log = spark.createDataFrame([("a", -1), ("b", 1), ("b", 1), ("c", None), (None, 1)], "case_id string, rating int")
    votes = ranking.ratings(log.withColumn("n", F.monotonically_increasing_id()))
    assert {r.case_id: r.net for r in votes.collect()} == {"a": -1, "b": 2}
    out = {r.case_id: r.final_score for r in ranking.apply_feedback(ranked, votes).collect()}
    assert out == {"a": 0.875, "b": 0.64, "c": 0.15}
    c = ranking.confidence(ranking.apply_feedback(ranked, votes)).first()
    assert c.confidence == round(0.5 * 0.875 + 0.2 * 0.47 + 0.2 * 2 / 3 + 0.1 * 0.5, 4) and c.confident
    only = spark.createDataFrame([(2, "x", 0.35, None)], "query_id int, case_id string, final_score double, graph_score double")
    assert ranking.confidence(only).first().confidence == round(0.5 * 0.175 + 0.1 + 0 + 0.05, 4)


def test_graph(spark):
    cases = spark.createDataFrame(
        [("c1", "A v. B", "High Court", ["J  One", None], ["Food Act, 1957", " "], ["34"], ["A"], []), ("c1", "A v. B", "High Court", ["J One"], None, None, None, None), ("c2", None, None, None, ["food act, 1957"], ["12"], None, None)],
        "case_id string, case_name string, court string, judges array<string>, acts array<string>, sections array<string>, petitioners array<string>, respondents array<string>",
    )
    e = graph.edges(cases)
    assert {tuple(r) for r in e.collect()} == {
        ("c1", "HEARD_IN", "High Court"), ("c1", "DECIDED_BY", "J One"), ("c1", "UNDER_ACT", "Food Act, 1957"), ("c1", "INVOLVES_SECTION", "34"), ("c1", "HAS_PETITIONER", "A"),
        ("c2", "UNDER_ACT", "food act, 1957"), ("c2", "INVOLVES_SECTION", "12")}
    q = spark.createDataFrame([(1, ["FOOD act", None, ""], ["12", None], ["v. b"]), (2, None, None, None)], "query_id int, suggested_acts array<string>, suggested_sections array<string>, keywords array<string>")
    found = {(r.query_id, r.case_id): (r.raw_score, r["rank"]) for r in graph.search(e, cases, q).collect()}
    assert found == {(1, "c2"): (5, 1), (1, "c1"): (3, 2)}
    assert graph.metadata(e).where("case_id = 'c1'").first().judges == ["J One"]
    last = graph.upsert(spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "name string, seq int, v string"), ["name"], "seq")
    assert last.first().v == "new"


def test_understanding(spark):
    df = spark.createDataFrame([("en veettu owner",), ("வீடு",), ("मकान",), ("My landlord took the house, section 304A",)], "q string")
    assert [r[0] for r in df.select(understanding.script_language(F.col("q"))).collect()] == ["en", "ta", "hi", "en"]
    k = df.select(understanding.keywords(F.col("q")).alias("k")).collect()[3].k
    assert k == ["landlord", "took", "house", "section"]
    rules = [(["landlord"], "Property", "Tenancy", ["X Act"], ["106"], ["eviction"])]
    r = df.select(understanding.apply_rules(F.col("q"), rules).alias("m")).collect()[3].m
    assert r.sections == ["106", "304a"] and r.legal_domain == "Property"


def test_evidence_helpers(spark):
    row = spark.createDataFrame([("Doc", " Title ", "<p>a <b>c</b></p>", "The Case of: A, B!")], "d string, t string, h string, k string")
    r = row.select(evidence.stage_hash(F.col("d"), F.col("t")).alias("a"), evidence.strip_html(F.col("h")).alias("b"), evidence.case_key(F.col("k")).alias("c"), evidence.case_key(F.lit("!")).alias("e")).first()
    import hashlib

    assert r.a == hashlib.md5(b"doc: title").hexdigest()[:12] and r.b == "a c" and r.c == "the_case_of_a_b" and r.e == "web_case"
    turns = spark.createDataFrame([(1, 1, "x", ["a"]), (1, 2, "", ["b", "a"]), (1, 3, "y", None)], "c int, o int, s string, l array<string>")
    assert [(r.s, r.l, r.turn_count) for r in evidence.fold_turns(turns, "c", "o", ["s"], ["l"]).orderBy("o").collect()] == [("x", ["a"], 1), ("x", ["a", "b"], 2), ("y", ["a", "b"], 3)]
    assert [(r.s, r.l, r.turn_count) for r in evidence.final_state(turns, "c", "o", ["s"], ["l"]).collect()] == [("y", ["a", "b"], 3)]
    attempts = spark.createDataFrame([("d", 1, 1, 0.8), ("d", 1, 2, 0.9), ("d", 1, 3, 0.95), ("e", 1, 1, 0.5), ("e", 1, 2, 0.6), ("e", 1, 3, 0.6)], "doc_id string, page_num int, attempt int, confidence double")
    assert {r.doc_id: (r.attempt, r.is_low) for r in evidence.best_attempt(attempts).collect()} == {"d": (2, False), "e": (2, True)}
    a = spark.createDataFrame([('```json\n{"s": "v"}\n```',), ('so {"s": "w"} then',), ("none",)], "x string").select(evidence.parse_answer(F.col("x"), "s string").alias("p")).collect()
    assert [x.p.s if x.p else None for x in a] == ["v", "w", None]


def test_names_in_pieces_are_never_broadcast(spark):
    """The planner takes exploded names for small; with many terms it would send them all through the driver."""
    names = spark.createDataFrame([(f"Trader {i} v. State of Beta {i * 7}",) for i in range(400)] + [(None,)], "name string").repartition(2)
    terms = spark.createDataFrame([(f"TRADER {i} v. State of Beta {i * 7} and another",) for i in range(3000)] + [("trader 7 V.",), ("77",), (" ",), (None,)], "term string").repartition(2)
    found = graph.containing(names, terms)
    got = {tuple(r) for r in found.collect()}
    assert ("Trader 7 v. State of Beta 49", "trader 7 V.") in got and {t for _, t in got} == {"trader 7 V.", "77"}
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    for k in [k for k, x in enumerate(lines) if "BroadcastExchange" in x]:
        below = next(x for x in lines[k + 1 :] if any(w in x for w in ("Aggregate", "Join", "Scan", "Generate explode(array_distinct(concat")))
        assert "Generate" not in below


def test_staged_titles_against_few_names(spark):
    """More titles than names: still no exploded name is broadcast, and a title counts by its first sixty letters."""
    long = "State of Beta and its Department of Roads and Bridges v. Alpha Traders Pvt. Ltd."
    cases = spark.createDataFrame([(f"Trader {i} v. State of Beta {i * 7}",) for i in range(400)] + [("In re " + long[:60].upper(),), (None,)], "case_name string").repartition(2)
    staged = spark.createDataFrame([(f"w{i}", f"High Court examines rule {i} in a matter of Beta {i * 7}") for i in range(3000)] + [("a", " " + long), ("b", "trader 7 v"), ("c", " "), ("d", None)], "doc_id string, title string").repartition(2)
    found = graph.known_titles(staged, cases)
    assert {r.doc_id for r in found.collect()} == {"a", "b"}
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    for k in [k for k, x in enumerate(lines) if "BroadcastExchange" in x]:
        assert "Generate" not in next(x for x in lines[k + 1 :] if any(w in x for w in ("Aggregate", "Join", "Scan", "Generate explode(array_distinct(concat")))


def test_titles_broadcast_only_numbers_of_pieces(spark, tmp_path):
    """Small files tempt the planner to broadcast by its estimates; only the bounded numbers of the pieces looked up may go out."""
    long = "State of Beta and its Department of Roads and Bridges v. Alpha Traders Pvt. Ltd."
    spark.createDataFrame([(f"Trader {i} v. State of Beta {i * 7}",) for i in range(400)] + [("In re " + long[:60].upper(),), (None,)], "case_name string").write.parquet(f"{tmp_path}/cases")
    spark.createDataFrame([(f"w{i}", f"High Court examines rule {i} in a matter of Beta {i * 7}") for i in range(3000)] + [("a", " " + long), ("b", "trader 7 v"), ("c", " "), ("d", None), ("e", "7")], "doc_id string, title string").write.parquet(f"{tmp_path}/staged")
    found = graph.known_titles(spark.read.parquet(f"{tmp_path}/staged"), spark.read.parquet(f"{tmp_path}/cases"))
    sent = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastExchange" in x]
    assert len(sent) == 1 and "int, true] as bigint" in sent[0]
    assert {r.doc_id for r in found.collect()} == {"a", "b", "e"}

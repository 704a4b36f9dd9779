import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrain.functions import images
from casegrain.operators import answers, chunking, cleaning, conversation, evidence, graph, understanding, web
from casegrain.sources import readers

EVIDENCE = (
    "query_id long, rank int, case_id string, case_name string, decision_date string, court string, judges array<string>, acts array<string>, sections array<string>, "
    "petitioners array<string>, respondents array<string>, final_score double, relevant_chunks array<string>, source string"
)


def own(spark, rows):
    return spark.createDataFrame([(q, r, c, n, None, None, ["J"], a, None, None, ["R"], 0.5, ["text"], answers.OWN) for q, r, c, n, a in rows], EVIDENCE)


def test_facts_of_messages(spark):
    said = [(1, 1, "A lorry hit my father near Chennai, Section 279a, he is in hospital"), (1, 2, "we filed FIR; the bike was in Mumbai"), (1, 3, None), (1, 4, " "), (2, 1, "hello"), (3, 1, None)]
    rows = {r.conv_id: r for r in conversation.states(spark.createDataFrame(said, "conv_id int, turn int, content string")).collect()}
    r = rows[1]
    assert (r.incident, r.legal_domain, r.vehicle, r.city, r.state, r.injury, r.fir_filed, r.sections, r.turn_count) == (
        "Road Accident", "Motor Vehicles", "Truck", "Chennai", "Tamil Nadu", "Serious", True, ["279A"], 2)
    assert rows[2].incident is None and 3 not in rows


def test_slots_and_rewriting(spark):
    said = [(1, 1, "a truck accident, no one was hurt, unhurt"), (2, 1, "hello"), (3, 1, "cheque bounced"), (4, 1, "cheque for Rs. 5,000 bounced")]
    states = conversation.states(spark.createDataFrame(said, "conv_id int, turn int, content string"))
    got = {r.conv_id: r for r in conversation.check_slots(states).collect()}
    assert got[1].is_ready and got[1].missing_required == []
    assert (got[2].is_ready, got[2].missing_required, got[2].next_slot, got[2].required_count) == (False, ["incident"], "incident", 1)
    assert (got[3].is_ready, got[3].next_slot) == (False, "cheque_amount") and got[4].is_ready
    q = {r.conv_id: r for r in conversation.rewrite(states).collect()}
    assert q[3].suggested_acts == ["Negotiable Instruments Act"] and q[3].suggested_sections == ["138"] and q[2].search == "legal dispute India"
    assert q[1].search == "Road Accident Truck accident None injury" and q[1].expanded_concepts[-1] == "road accident" and len(q[1].expanded_concepts) == 8
    shown = {r.conv_id: r.s for r in states.select("conv_id", conversation.summary(states).alias("s")).collect()}
    assert shown[2] == "No facts collected yet." and shown[4] == "Incident: Cheque Bounce; Legal Domain: Criminal; Cheque Amount: 5000"


def test_first_rule_wins(spark):
    m = spark.createDataFrame([("My dog document, Section 5",), ("Nothing Section 9b",)], "q string").select(understanding.apply_rules(F.col("q"), understanding.RULES).alias("m")).collect()
    assert m[0].m.incident_type == "Animal Attack" and m[0].m.sections == ["289", "304A", "428", "5"]
    assert m[1].m.incident_type == "Consumer Dispute" or m[1].m.sections == ["9b"]


def test_gate_puts_own_rows_first(spark):
    rows = own(spark, [(q, r, f"c{r}", f"n{r}", ["A"]) for q in (1, 2) for r in range(1, 8)])
    sure = spark.createDataFrame([(1, 0.35), (2, 0.3499), (3, 0.1)], "query_id long, confidence double")
    found = spark.createDataFrame([(2, "w1", "t", "h", "u", "High Court", "d", "x", ["B"], ["1"], 0.6), (3, None, None, None, None, None, None, None, None, None, None)],
                                  "query_id long, doc_id string, title string, headline string, url string, court string, date string, text_excerpt string, acts array<string>, sections array<string>, relevance_score double")
    got = answers.gated(rows, sure, answers.web_evidence(found).withColumn("place", F.lit(1)))
    by = {q: [(r.rank, r.case_id, r.knowledge_source) for r in sorted(got.collect(), key=lambda r: r.rank) if r.query_id == q] for q in (1, 2, 3)}
    assert by[1] == [(k, f"c{k}", "permanent_kg") for k in range(1, 6)]
    assert by[2] == [(1, "c1", "hybrid"), (2, "c2", "hybrid"), (3, "w1", "hybrid")] and by[3] == [(1, "web_case", "temporary_pool")]
    s = {r.query_id: (r.source, r.acts) for r in answers.sources(got).collect()}
    assert s == {1: ("permanent_kg", ["A"]), 2: ("hybrid", ["A", "B"]), 3: ("temporary_pool", [])}


def test_answers_are_linked(spark):
    e = own(spark, [(1, 1, "a", "A v. B", ["X"]), (1, 2, "b", "C v. D", None), (2, 1, "c", None, ["Y"])])
    told = {"summary": "s", "applicable_acts": ["Z"], "precedents": [{"case_id": "b"}, {"case": "A v. B"}, {"case_id": "far"}]}
    raws = spark.createDataFrame([(1, "```json\n" + json.dumps(told) + "\n```"), (2, None), (3, "no json")], "query_id long, raw string")
    got = {r.query_id: r for r in answers.assemble(raws, e, "take care").collect()}
    assert [(p.case_id, p.linked) for p in got[1].precedents] == [("b", True), ("a", True), ("far", False)] and got[1].applicable_acts == ["Z"]
    assert got[2].applicable_acts == ["Y"] and [(p.case_id, p.case) for p in got[2].precedents] == [("c", "c")] and got[2].summary == "Insufficient evidence found."
    assert got[3].precedents is None and got[3].applicable_acts == [] and got[3].disclaimer == "take care"
    raw = spark.range(1).select(answers.fallback(F.lit(2), F.lit('a "quoted" thing'), F.array(F.lit("X")), F.array().cast("array<string>"))).first()[0]
    assert json.loads(raw)["summary"] == '2 relevant case(s) found for a "quoted" thing'


def test_prompts(spark):
    q = spark.createDataFrame([(1, "q1", "ta", "D", "I", None, ["5"], ["c"] * 7), (2, None, "xx", None, None, None, None, None)],
                              "query_id long, original_query string, detected_language string, legal_domain string, incident_type string, suggested_acts array<string>, suggested_sections array<string>, expanded_concepts array<string>")
    p = {r.query_id: r.prompt for r in answers.prompts(q, own(spark, [(1, 1, "a", None, None)]), "H", "F", F.lit("ctx")).collect()}
    assert p[1].startswith("H\nAnswer in Tamil\nConversation: ctx\nQuery: q1") and "Case 1: a\nCourt: Supreme Court of India\nDate: Unknown" in p[1] and "Concepts: c, c, c, c, c\n" in p[1]
    assert "No evidence found." in p[2] and "Answer in" not in p[2] and p[2].endswith("F")
    assert readers.answer_with(answers.prompts(q, own(spark, [])), lambda p: 1 / 0).where("raw IS NOT NULL").count() == 0


def test_web_sources(spark):
    schema = "query_id long, tid string, title string, headline string, court string, publishdate string, suggested_acts array<string>, suggested_sections array<string>"
    a = web.judgment_rows(spark.createDataFrame([(1, "7", "t", "<b>Section 12a</b> x", None, None, None, ["1"]), (2, None, None, None, None, None, None, ["1"])], schema), "http://x/%s/")
    rows = {r.query_id: r for r in a.collect()}
    assert (rows[1].headline, rows[1].sections, rows[1].url) == ("Section 12a x", ["12a"], "http://x/7/") and rows[2].sections == ["1"] and rows[2].title == ""
    b = web.page_rows(spark.createDataFrame([(1, 1, "The High Court", "http://y", "c" * 900, None, None)], "query_id long, position int, title string, url string, content string, suggested_acts array<string>, suggested_sections array<string>"))
    assert {(r.query_id, r.court) for r in web.by_priority(b, a).collect()} == {(1, "High Court"), (2, "")}
    assert len(b.first().headline) == 400 and len(b.first().text_excerpt) == 800


def test_graph_build_and_load(spark):
    rel = lambda r, o: ("Case", r, o)
    rows = [
        (1, " A  v. B ", None, None, "High  Court", ["J1", " ", None], [("Act X", 1950), ("Act Y", 1700), ("", 1950)], [("Section", "5"), ("", "6")], [("P", "Petitioner"), ("Q", "Judge")],
         [rel("HEARD_IN", "Court"), rel("UNDER_ACT", "Act"), rel("HAS_PETITIONER", "Party"), ("Court", "HEARD_IN", "Case")]),
        (2, "A v. B", "2020-01-01", "Tamil", "", [], [("Act X", 1960)], [], [], [rel("UNDER_ACT", "Act")]),
        (3, None, None, None, None, ["J2"], [], [], [], [rel("DECIDED_BY", "Judge")]),
    ]
    schema = ("o int, case_name string, decision_date string, language string, court string, judges array<string>, acts array<struct<name: string, year: int>>, sections array<struct<type: string, number: string>>, "
              "parties array<struct<name: string, role: string>>, relationships array<struct<subject: string, relation: string, object: string>>")
    nodes, edges = graph.load_graph(spark.createDataFrame(rows, schema), "o")
    n = {(r.label, r.key): r.value for r in nodes.collect()}
    assert n[("Act", "Act X")] == "1960" and n[("Case", "A v. B")] == "2020-01-01|Tamil" and ("Act", "Act Y") not in n and ("Party", "Q") not in n and ("Judge", "J1") in n
    assert {tuple(r) for r in edges.collect()} == {("A v. B", "HEARD_IN", "High Court"), ("A v. B", "UNDER_ACT", "Act X"), ("A v. B", "HAS_PETITIONER", "P")}


def test_terms_are_found_by_their_rarest_piece(spark):
    names = spark.createDataFrame([("State of Beta",), ("State of Gamma",), (None,), ("ab",)], "name string")
    terms = spark.createDataFrame([("state of g",), ("AB",), ("zzz",), (" ",), (None,), ("B",)], "term string")
    assert {tuple(r) for r in graph.containing(names, terms).collect()} == {("State of Gamma", "state of g"), ("ab", "AB"), ("State of Beta", "B"), ("ab", "B")}
    q = spark.createDataFrame([(1, ["fake"], "x", ""), (2, None, None, "tenancy"), (3, [" "], " ", None)], "query_id long, keywords array<string>, original_query string, incident_type string")
    e = spark.createDataFrame([("c1", "CONCEPT_FORGERY"), ("c2", "CONCEPT_TENANCY")], "case_id string, concept string")
    assert {(r.query_id, r.case_id) for r in graph.concept_hits(e, q).collect()} == {(1, "c1"), (2, "c2")}


def test_pages_to_documents(spark):
    text = "\f".join(f"--- Page {k} of 3 ---\nREPORTS\nline {w} of  the page\n{k}" for k, w in ((1, "one"), (2, "two"), (3, "three")))
    got = {r.doc_id: r.text for r in cleaning.clean_documents(spark.createDataFrame([("a", text), ("b", None), ("c", " ")], "doc_id string, text string")).collect()}
    assert got == {"a": "line one of the page\n\nline two of the page\n\nline three of the page", "b": "", "c": ""}
    images_ = spark.createDataFrame([("d", 1, b"x"), ("d", 2, b"")], "doc_id string, page_num int, image binary")
    engine = lambda page: [("tbe end", 0.5, 0, 40, 9, 58), ("HEAD", 0.7, 0, 0, 9, 18)] if page else 1 / 0
    name, chosen = readers.engine_of({"mock": readers.fixed_engine("x"), "own": engine}, ["gone", "own"])
    pages, docs = readers.recognised_documents(readers.recognise(images_, chosen), spark.createDataFrame([("e", 1, "plain")], "doc_id string, page_num int, text string"), {"tbe": "the"})
    assert name == "own" and {r.doc_id: r.text for r in docs.collect()}["e"] == "plain"
    first = {(r.doc_id, r.page_num): r for r in pages.collect()}
    assert first[("d", 1)].text == "[LOW_CONFIDENCE: 60% — Page 1 — verify manually]\nHEAD\n\nthe end" and first[("d", 2)].confidence == 0.0 and first[("e", 1)].mode == "text"
    with pytest.raises(ValueError):
        readers.engine_of({}, ["gone"])


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, c in (("a.txt", b"held"), ("b.PDF", b"%"), ("c.xyz", b"?")):
        (tmp_path / "in" / n).write_bytes(c)
    kinds = {r.doc_id: (r.kind, r.error) for r in readers.folder_files(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a": ("text", None), "b": ("pages", None), "c": (None, "unsupported ending: xyz")}
    up = readers.decode_uploads(spark.createDataFrame([("a.md", b"ok \xff!"), ("b.txt", b" "), ("c.pdf", b"x")], "name string, content binary"))
    assert {r.name: (r.text, r.error) for r in up.collect()} == {"a.md": ("ok !", None), "b.txt": (None, "no text"), "c.pdf": (None, "not a text file")}
    (tmp_path / "m.json").write_text('[{"case_id": "x", "text": "t"}]')
    assert readers.read_chunks_json(spark, str(tmp_path / "m.json"), "case_id string, text string").collect() == [("x", "t")]
    (tmp_path / "r.json").write_text('{"_comment": "c", "tbe": "the"}')
    assert readers.corrections(str(tmp_path / "r.json")) == {"tbe": "the"} and readers.corrections(None) == {} and readers.corrections("/nowhere") == {}
    marked = readers.marked_pages(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc_id string, page_num int, text string")).first().text
    assert marked == "--- Page 1 of 2 ---\na\f--- Page 2 of 2 ---\nb"
    cat = spark.createDataFrame([("p1", "abc", 2), ("p2", "abc", 1), ("p3", "xabcdx", 1), ("p4", "zz", 1)], "path string, stem string, folder_rank int")
    found = readers.case_files(spark.createDataFrame([("abc.pdf",), ("ABCD",), ("zzz",), ("none",)], "case_id string"), cat)
    assert {r.case_id: r.path for r in found.collect()} == {"abc.pdf": "p2", "ABCD": "p3", "zzz": "p4"} or {r.case_id: r.path for r in found.collect()} == {"abc.pdf": "p2", "ABCD": "p2", "zzz": "p4"}
    c = spark.createDataFrame([("", "s", 1, "b"), (None, "s", 0, "a"), (None, None, 0, "u"), ("k", "s", 0, "")], "case_id string, source_file string, chunk_index int, text string")
    assert {r.case_id: r.texts for r in chunking.case_chunks(c).collect()} == {"s": ["a", "b"], "unknown": ["u"]}
    v, m = spark.createDataFrame([(1,), (2,)], "row int"), spark.createDataFrame([(2,), (3,)], "row int")
    assert {tuple(r) for r in chunking.index_gaps(v, m).collect()} == {(1, "metadata"), (3, "vectors")} and chunking.index_gaps(v, v).isEmpty()
    with pytest.raises(Exception, match="no chunk at this row"):
        chunking.chunks_at(v, spark.createDataFrame([(0, 9)], "place int, row int")).collect()


def test_image_measures(spark):
    flat, noisy = np.full((40, 60), 90, dtype=np.uint8), np.random.default_rng(1).integers(0, 255, (40, 60)).astype(np.uint8)
    assert images.blur(flat) == images.contrast(flat) == 0 and images.blur(noisy) > 100 and 0 <= images.noise(flat) < images.noise(noisy) <= 1
    assert images.prepare(noisy, "gentle") is noisy and images.prepare(flat, "aggressive").shape == flat.shape
    with pytest.raises(ValueError):
        images.prepare(flat, "none")
    q = spark.createDataFrame([(50.0, -0.6, 30.0, 0.1)], "blur_score double, skew_angle double, contrast_score double, noise_level double")
    r = q.select(evidence.page_quality(F.struct("*")).alias("q")).first().q
    assert (r.is_blurry, r.has_significant_skew, r.has_low_contrast, r.is_noisy, r.strategy) == (True, True, True, False, "aggressive")

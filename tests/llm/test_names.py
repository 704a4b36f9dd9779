from pyspark.sql import functions as F

from casegrain.llm import canonical, entities, languages, scans
from casegrain.llm.boosting import Boosted


def acts(spark):
    return spark.createDataFrame(
        [("A1", "Coastal Haulage Act, 1987", 1987), ("A2", "Coastal Haulage (Amendment) Act, 2006", 2006), ("A3", "Buyer Protection Act, 1986", 1986), ("A4", "Buyer Protection Act, 2018", 2018), ("A5", "Rules of Testimony, 1947", 1947)],
        "act_id string, canonical_name string, act_year int")


def courts(spark):
    return spark.createDataFrame(
        [("C1", "Supreme Bench of the Union", "Senapur", "supreme"), ("C2", "High Court of Velnadu", "Marupúr", "high"), ("C3", "High Court of Uttar Mirgaon", "Senapur", "high"), ("C4", "High Court of Mirgaon", "Haldivar", "high"), ("C5", "District Court, Dorvani", "Dorvani", "district")],
        "court_id string, canonical_name string, seat string, court_level string")


ACTS = {
    "Coastal Haulage Act, 1987": "A1", "coastal  haulage act 1987.": "A1", "CoastalHaulageAct,1987": "A1", "Haulage Coastal Act 1987": "A1", "The Coastal Haulage Act of 1987": "A1", "Coastal Haoolage Act": "A1",
    "u/s 82 Coastal Haulage Act, 1987": "A1", "C.H.A.": "A1", "CHA 1987": "A1", "Coastal Haulage (Amdt.) Act, 2006": "A2", "Buyer Protection Act '18": "A4", "Buyer Protection (1986 Act)": "A3", "Byer Prot. Act, 2018": "A4",
    "Testimony Rules of Act 1947": "A5", "Buyer Protection Act": "none", "local custom": "none", "Gold Export Act, 1987": "none", "xx": "none", "--": "none", "Sec 12": "none", "x" * 3000: "none",
}
COURTS = {
    "HC of Velnadu": "C2", "Velnadu High Cuort": "C2", "High Court at Marupur": "C2", "H.C. Mirgaon": "C4", "High Court, Uttar Mirgaon": "C3", "High Court of Judicature at Senapur": "C3", "SBU": "C1", "Supreme Bench": "C1",
    "Dist. Ct., Dorvani": "C5", "District Judge's Court, Dorvani": "C5", "High Court of Ostermark": "none", "Court": "none", "?": "none",
}


def test_mapping(spark):
    rows = [("a", i, 0, t, False) for i, t in enumerate(ACTS)] + [("c", i, 0, t, True) for i, t in enumerate(COURTS)]
    rows += [("a", 900, 0, None, False), ("a", 901, 0, "  ", False), rows[0]]
    df = spark.createDataFrame(rows, "field string, row_id int, pos int, typed string, is_court boolean").withColumn("kind", F.lit("clash"))
    got = {(r.field, r.typed): r.ref_id for r in canonical.map_values(df, acts(spark), courts(spark)).collect()}
    assert {t: got[("a", t)] for t in ACTS} == ACTS
    assert {t: got[("c", t)] for t in COURTS} == COURTS and len(got) == len(ACTS) + len(COURTS)
    assert canonical.map_values(df.limit(0), acts(spark), courts(spark)).count() == 0


GROUPS = {
    "judge": [["Zevasharek, Thenmozhi", "Justice T. S. Zevasharek", "ZEVASHAREK T.S.", "Thenmozhi Zevashaerk"], ["Vijayalakshmi @ Viji Sokevavath", "Sokevavath Viji", "Justice V. N. Sokevavath", "Sokevavath, J."], ["Omprakash Caduthandar"]],
    "party": [
        ["State of Velnadu", "The State of Velnadu", "Govt. of Velnadu", "Velnadu, State of", "State of Velnadu rep. by Secretary"],
        ["Velnadu State Road Carriage Corporation", "Velnadu S.R.C.C.", "Managing Director, Velnadu State Road Carriage Corporation", "Velnadu State Rd. Carriage Corpn"],
        ["Cudanitan Engineering Works Ltd.", "M/s. Cudanitan Engg. Works", "The Cudanitan Engineering Works Limited"], ["Cudanitan Software Services Ltd."],
        ["Rukmani T. Mavoshandar", "R.T. Mavoshandar", "Rookmani T. Mavoshandar", "Rukmani Mavoshandar s/o T. Mavoshandar", "Mavoshandar, Rukmani & Ors."], ["Z. Mavoshandar"],
    ],
}


def test_variants(spark):
    rows = [(k, n) for k, gs in GROUPS.items() for g in gs for n in g]
    df = spark.createDataFrame([*rows, rows[0], ("party", None), ("party", " ")], "kind string, name string").withColumn("cluster", F.lit(1))
    by = {}
    for r in entities.resolve(df).collect():
        by.setdefault((r.kind, r.cluster), set()).add(r.name)
    want = {(k, frozenset(g)) for k, gs in GROUPS.items() for g in gs}
    assert {(k, frozenset(v)) for (k, _), v in by.items()} == want
    pairs = entities.variant_pairs(entities.resolve(df)).collect()
    assert len(pairs) == sum(len(g) * (len(g) - 1) // 2 for gs in GROUPS.values() for g in gs) and all(r.name_a < r.name_b for r in pairs)
    assert entities.resolve(df.limit(0)).count() == 0


def learnt(spark):
    """Dictionaries as in production, from the smaller tables."""
    docs, asked = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "legal_queries"))
    return languages.learn(languages.dictionaries(docs), asked, "original_query")


def test_languages(spark):
    content = learnt(spark)
    asked = [("en", "My landlord has not returned the deposit for the house"), ("ta", "veettu owner panam thirumba tharala, naan enna seiyanum"), ("hi", "makan malik paisa wapas nahi kar raha hai, kya kare"),
             ("mr", "माझ्या घरमालकाने पैसे परत दिले नाहीत, काय करावे?"), ("hi", "मेरे मकान मालिक ने पैसा वापस नहीं किया है, क्या करें?"), ("ta", "என் வீட்டு உரிமையாளர்"), ("ja", "お金を返してくれません"), ("zh", "公司没有支付工资，我该怎么办"), (None, "123 ..."), (None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(asked)], "query_id int, text string, lang string")
    got = {r.query_id: r.lang for r in languages.classify_texts(df, "query_id", "text", content).collect()}
    assert [got[i] for i in range(len(asked))] == [lang for lang, _ in asked]


def test_languages_without_documents(spark):
    """Without a labelled document only a script of one language tells anything."""
    content = languages.dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(0, "என் வீட்டு உரிமையாளர்"), (1, "the house"), (2, "मेरे मकान")], "query_id int, text string")
    assert {r.query_id: (r.lang, r.accepted) for r in languages.classify_texts(df, "query_id", "text", content).collect()} == {0: ("ta", True), 1: ("und", False), 2: ("und", False)}


def test_mixed(spark):
    content = learnt(spark)
    en, ta = "The landlord did not return the deposit. The police took my brother last night.", "காவல்துறை என் தம்பியை அழைத்துச் சென்றது. வேலையில் இருந்து என்னை நீக்கிவிட்டார்கள்."
    df = spark.createDataFrame([("m", f"Court copy\n{en}\n\n{ta}\n"), ("h", f"A. B. Rao v. State\n\n{ta}"), ("n", None), ("e", "")], "doc_id string, text string")
    found = languages.text_languages(df, "doc_id", "text", content)
    assert {tuple(r) for r in languages.mixed_texts(found, "doc_id").collect()} == {("m", "en"), ("m", "ta")}


def test_boosting():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted().fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert Boosted().fit(x[:0], y[:0]).score(x[:3]).shape == (3,)


def test_scans(spark):
    import random

    rng = random.Random(2)
    words = "the tenant paid rent before that court found against counsel because notice never reached either party during summer months although landlord waited".split()
    line = lambda n=8: " ".join(rng.choice(words) for _ in range(n))
    clean = spark.createDataFrame([(" ".join(line() for _ in range(20)),) for _ in range(300)], "_text string")
    pages = []
    for d in range(60):
        for p in range(1, 5):
            body = [line() for _ in range(8)]
            text = "\n".join(["REPORTABLE COPY", *body[:4], body[4] + " compen-", "sation " + body[5], *body[6:], f"Page {p} of 4", "Certified true copy"])
            if d == 0 and p == 2:
                text = text.replace(body[1], "the tcnant paid rent b3fore")
            pages.append((f"d{d}", p, "ocr", text))
    pages += [pages[0], ("n", 1, "ocr", None), ("e", 1, "ocr", "")]
    df = spark.createDataFrame(pages, "doc_id string, page_num int, mode string, text string").withColumn("kind", F.lit("x"))
    got = {}
    for r in scans.find(df, clean).where("doc_id = 'd0' AND page_num = 2").collect():
        got.setdefault(r.kind, set()).add(r.line_no)
    n = len([x for x in pages[1][3].split("\n")])
    assert got["furniture"] == {1, n - 1, n} and got["broken_word"] == {6} and got["misread"] == {3}
    text = {r.doc_id: r.text for r in scans.repair(df, clean).collect()}["d0"]
    assert "compensation" in text and "tenant paid rent before" in text and "REPORTABLE" not in text and "Page" not in text
    assert scans.find(df.limit(0), clean).count() == 0

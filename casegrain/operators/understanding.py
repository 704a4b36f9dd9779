"""Reading of queries: script, keywords, concept rules, search strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrain.functions import text as T

# Words by which romanised Tamil is told, and words that are no keywords.
TANGLISH = (
    "vandi wandi vaandi vandiye oruthan modhitan kidaikuma kedaikuma epdi iruka pudichu panna pannitan pannitanga pannalam casela policela enaku "
    "enakku nalla solunga solungha engalukku aachu aayiduchu varuma kuduka varum enga veetula romba periya prachana amma appa appvoda sign oru "
    "document la potutanga potuta poittanga ippo aakuraru athaya kaiyappam eazhuthu veedu nila panam bouncu"
).split()
STOP = (
    "i me my we our you your he she it they their the a an is are was were be been being have has had do does did will would could should may might "
    "shall can to of in on at by for with from into and or but not no so as if then than this that these those what which who how when where why got "
    "get says said say someone another other him her his"
).split()
# Words, domain, incident, acts, sections and concepts of each rule, in order of precedence.
RULES = [
    (["accident", "vehicle", "bike", "truck", "car", "collision", "hit", "motor", "road", "driving", "motorcycle", "pedestrian", "விபத்து", "வண்டி", "மோதி", "இழப்பீடு", "சேதம்",
      "காரை", "दुर्घटना", "वाहन", "मुआवजा"], "Motor Vehicles", "Road Accident", ["Motor Vehicles Act"], ["134", "166", "279", "304A"],
     ["tort liability", "negligence", "compensation", "contributory negligence", "motor accident claim"]),
    (["dog", "animal", "bite", "attack", "cruelty", "stray", "நாய்", "கடித்தது", "விலங்கு"], "Criminal/Tort", "Animal Attack",
     ["Indian Penal Code", "Prevention of Cruelty to Animals Act"], ["289", "304A", "428"], ["strict liability", "nuisance", "negligence", "animal owner liability"]),
    (["landlord", "tenant", "rent", "eviction", "evict", "lease", "property", "house", "flat", "apartment", "வாடகை", "வீடு", "நிலம்"], "Property", "Tenancy / Eviction Dispute",
     ["Transfer of Property Act", "State Rent Control Act"], ["106", "111"], ["wrongful eviction", "tenancy rights", "notice to quit", "mesne profits"]),
    (["forge", "forged", "forgery", "signature", "fraud", "cheating", "document", "fake", "impersonate", "sign", "potutanga", "potuta", "poittanga", "kaiyappam", "eazhuthu",
      "போலி", "கையெழுத்து", "ஏமாற்று"], "Criminal", "Forgery / Document Fraud", ["Indian Penal Code"], ["463", "465", "468", "471", "420"],
     ["forgery", "fraud", "cheating", "document tampering", "mens rea"]),
    (["copyright", "software", "piracy", "intellectual property", "trademark", "patent", "infringement", "plagiarism"], "Intellectual Property", "IP Infringement",
     ["Copyright Act", "Trade Marks Act", "Patents Act", "Information Technology Act"], ["51", "63"], ["copyright infringement", "software piracy", "fair use", "moral rights"]),
    (["employment", "fired", "sacked", "termination", "dismiss", "salary", "wage", "labour", "worker", "retrenchment", "வேலை", "சம்பளம்"], "Labour",
     "Wrongful Termination / Labour Dispute", ["Industrial Disputes Act", "Payment of Wages Act", "Factories Act"], ["25F", "25N", "33"],
     ["wrongful termination", "retrenchment", "reinstatement", "back wages"]),
    (["consumer", "product", "defect", "defective", "warranty", "refund", "service", "cheated", "company", "பொருள்", "நுகர்வோர்"], "Consumer", "Consumer Dispute",
     ["Consumer Protection Act"], ["2", "35", "58"], ["deficiency in service", "unfair trade practice", "product liability", "consumer rights"]),
    (["murder", "assault", "rape", "robbery", "theft", "kidnap", "abduction", "dowry", "harassment", "criminal", "கொலை", "திருட்டு"], "Criminal", "Criminal Offence",
     ["Indian Penal Code", "Code of Criminal Procedure"], ["302", "307", "376", "392", "498A"], ["cognizable offence", "mens rea", "actus reus", "burden of proof", "FIR"]),
]
GENERIC = ("General", "Legal Dispute", ["legal rights", "judicial remedy"])


def script_language(c: Column) -> Column:
    """ta, hi, ta_roman or en, by script and by marker words."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return (
        F.when(c.rlike("[஀-௿]"), "ta").when(c.rlike("[ऀ-ॿ]"), "hi")
        .when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in TANGLISH])), "ta_roman").otherwise("en")
    )


def keywords(c: Column) -> Column:
    """Distinct words of more than two letters that are no stop words, in order."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda w: (F.length(w) > 2) & ~w.isin(STOP)))


def mentioned_sections(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?i)\bsection\s+(\d+[A-Za-z]?)\b"), F.lit(1))


def apply_rules(c: Column, rules: list[tuple[list[str], str, str, list[str], list[str], list[str]]]) -> Column:
    """struct(legal_domain, incident_type, acts, sections, concepts) of the first rule with a keyword in the text.

    Rules are (keywords, domain, incident, acts, sections, concepts), tried in order; else the generic one."""
    low = F.lower(c)
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def made(domain, incident, acts, sections, concepts, mentioned) -> Column:
        return F.struct(
            F.lit(domain).alias("legal_domain"), F.lit(incident).alias("incident_type"), strings(acts).alias("acts"),
            F.array_distinct(F.concat(strings(sections), mentioned)).alias("sections"), strings(concepts).alias("concepts"),
        )

    out = None
    for words, domain, incident, acts, sections, concepts in rules:
        hit, value = T.any_contains(low, words), made(domain, incident, acts, sections, concepts, mentioned_sections(low))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    generic = made(GENERIC[0], GENERIC[1], [], [], GENERIC[2], mentioned_sections(c))
    return generic if out is None else out.otherwise(generic)


def search_text() -> Column:
    """One string of all that a query says, from the columns of legal_queries; empty parts are left out."""
    told = F.coalesce(F.col("original_query") == F.nullif("query_in_english", F.lit("")), F.lit(False)) | F.coalesce(F.col("original_query") == F.nullif("query_in_tamil_script", F.lit("")), F.lit(False))
    original = F.when(~told, F.col("original_query"))
    lists = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    parts = F.concat(
        F.array(F.col("query_in_english"), F.col("query_in_tamil_script"), original, F.col("incident_type")), lists("keywords"), lists("suggested_acts"),
        F.transform(lists("suggested_sections"), lambda s: F.concat(F.lit("Section "), s)), lists("expanded_concepts"),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def web_query() -> Column:
    """Sections, short act names, incident and keywords, most specific first."""
    lists = lambda c, n: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n)
    parts = F.concat(
        F.transform(lists("suggested_sections", 3), lambda s: F.concat(F.lit("section "), s)),
        F.transform(lists("suggested_acts", 2), lambda a: F.trim(F.replace(a, F.lit(" Act"), F.lit("")))),
        F.array(F.coalesce("incident_type", F.lit(""))), lists("keywords", 4),
    )
    return F.array_join(parts, " ")

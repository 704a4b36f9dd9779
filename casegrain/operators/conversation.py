"""Facts told in a conversation, the slots they fill, and the query they are rewritten to.

Every message is read by itself; the state of a conversation is a fold of its messages: the first value told of each
fact stays, lists grow by what is new. Null and blank messages tell nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.functions import text as T

# Words by which vehicles, places, incidents, injuries, reports and notices are told, in order of precedence.
VEHICLES = [
    ("Bike", "bike motorcycle two-wheeler scooter scooty motorbike"), ("Car", "car sedan hatchback"), ("Truck", "truck lorry"), ("Auto", "auto auto-rickshaw autorickshaw"),
    ("Bus", "bus"), ("Van", "van"), ("Tempo", "tempo"), ("Bicycle", "cycle bicycle"), ("Pedestrian", "pedestrian"),
]
CITIES = [
    ("mumbai", "Maharashtra"), ("delhi", "Delhi"), ("bangalore", "Karnataka"), ("bengaluru", "Karnataka"), ("chennai", "Tamil Nadu"), ("hyderabad", "Telangana"),
    ("kolkata", "West Bengal"), ("pune", "Maharashtra"), ("ahmedabad", "Gujarat"), ("jaipur", "Rajasthan"), ("lucknow", "Uttar Pradesh"), ("bhopal", "Madhya Pradesh"),
    ("chandigarh", "Punjab"), ("kochi", "Kerala"), ("coimbatore", "Tamil Nadu"), ("nagpur", "Maharashtra"), ("patna", "Bihar"), ("indore", "Madhya Pradesh"),
    ("thiruvananthapuram", "Kerala"), ("visakhapatnam", "Andhra Pradesh"), ("guwahati", "Assam"), ("ranchi", "Jharkhand"), ("raipur", "Chhattisgarh"), ("surat", "Gujarat"),
    ("vadodara", "Gujarat"), ("noida", "Uttar Pradesh"), ("gurgaon", "Haryana"), ("gurugram", "Haryana"),
]
STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "delhi", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala",
    "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura",
    "uttar pradesh", "uttarakhand", "west bengal",
]
INCIDENTS = [
    ("Road Accident", "Motor Vehicles", "accident collision hit crash road vandi wandi modhitan moadhitan"),
    ("Property Dispute", "Property", "property land flat house tenant landlord evict eviction veedu nila idathula"),
    ("Cheque Bounce", "Criminal", "cheque bounce bounced dishonour bouncu"), ("Domestic Violence", "Family", "dowry domestic violence harassment 498"),
    ("Consumer Complaint", "Consumer", "consumer product defect refund warranty"), ("Theft / Robbery", "Criminal", "theft robbery stolen steal thiruttu"),
    ("Homicide", "Criminal", "murder kill homicide kolai"), ("Family Dispute", "Family", "divorce custody maintenance alimony"),
    ("Labour Dispute", "Labour", "employment fired sacked salary termination velai"),
    ("Fraud / Forgery", "Criminal", "fraud forge forgery cheating fake sign potutanga potuta poittanga kaiyappam eazhuthu signature"),
]
INJURIES = [
    ("Fatal", ["fatal", "death", "died", "dead", "killed"]), ("Serious", ["serious", "severe", "hospital", "fracture", "critical"]),
    ("Minor", ["minor", "bruise", "scratch", "small"]), ("None", ["no injury", "not injured", "no one was hurt", "unhurt"]),
]
FIR = [
    (True, ["filed fir", "fir filed", "police complaint", "lodged fir", "registered fir", "filed a complaint"]),
    (False, ["no fir", "didn't file", "did not file", "haven't filed", "not filed"]),
]
NOTICE = [(True, ["sent notice", "gave notice", "served notice"]), (False, ["no notice", "didn't send", "without notice"])]
AMOUNT, MENTIONED = r"(?:rs\.?|inr|rupees?)\s*(\d[\d,]*)", r"\bsection\s+(\d+[a-z]?)\b"
#: What a conversation can be asked: incident, slots needed, slots that help, number needed.
SLOTS = [
    ("Road Accident", ["vehicle", "injury"], ["state", "fir_filed", "sections", "city"], 2),
    ("Property Dispute", ["property_type", "dispute_type"], ["state", "agreement_exists"], 2),
    ("Tenancy / Eviction Dispute", ["property_type", "dispute_type"], ["state", "agreement_exists"], 2),
    ("Cheque Bounce", ["cheque_amount", "bank"], ["notice_sent"], 1), ("Domestic Violence", ["injury"], ["fir_filed", "state"], 1),
    ("Consumer Complaint", ["incident"], ["state", "cheque_amount"], 1), ("Animal Attack", ["injury"], ["state", "fir_filed"], 1),
    ("Labour Dispute", ["incident"], ["state"], 1), ("Fraud / Forgery", ["incident"], ["fir_filed", "state"], 1),
    ("Criminal Offence", ["incident"], ["fir_filed", "state", "injury"], 1), ("Family Dispute", ["incident"], ["state"], 1),
    ("Homicide", ["incident"], ["fir_filed", "state"], 1), ("Theft / Robbery", ["incident"], ["fir_filed", "state"], 1), ("IP Infringement", ["incident"], ["state"], 1),
]
OTHERWISE = (["incident"], ["state", "sections"], 1)
PATIENCE, LAST = 4, 3
DOCTRINES = {
    "Motor Vehicles": ["tort liability", "negligence", "compensation", "contributory negligence", "motor accident claim", "rash and negligent driving", "third party insurance"],
    "Criminal": ["cognizable offence", "mens rea", "actus reus", "burden of proof", "FIR", "bail", "anticipatory bail"],
    "Criminal/Tort": ["strict liability", "nuisance", "negligence", "animal owner liability", "municipal corporation duty"],
    "Property": ["wrongful eviction", "tenancy rights", "notice to quit", "mesne profits", "adverse possession", "title dispute"],
    "Family": ["maintenance", "custody", "divorce petition", "domestic violence", "protection order"],
    "Consumer": ["deficiency in service", "unfair trade practice", "product liability", "consumer rights", "compensation"],
    "Labour": ["wrongful termination", "retrenchment", "reinstatement", "back wages", "industrial dispute"],
}
#: Statutes and provisions taken where none is told: words of the incident, a word of the messages, acts, sections.
DEFAULTS = [
    (["forge", "fraud"], "sign", ["Indian Penal Code"], ["463", "465", "468", "471", "420"]),
    (["accident"], "vandi", ["Motor Vehicles Act", "Indian Penal Code"], ["134", "166", "279"]),
    (["cheque", "bounce"], None, ["Negotiable Instruments Act"], ["138"]), (["property", "evict"], None, ["Transfer of Property Act"], ["106", "111"]),
]
ROMAN = (
    "ena vandi idichu enaka iruku teriyum ungalukku puriyudha aachen sonnanga panren pannanum aachu poyi vanthu senthuten paathu mudiyum pannanga"
).split()
SCALARS = ["incident", "legal_domain", "vehicle", "state", "city", "injury", "fir_filed", "cheque_amount", "notice_sent"]
#: All slots of a conversation in the order in which they are told of.
DECLARED = [
    "incident", "legal_domain", "vehicle", "state", "city", "court", "sections", "acts", "injury", "fir_filed", "current_goal", "property_type", "dispute_type",
    "agreement_exists", "cheque_amount", "bank", "notice_sent",
]


def _first_told(pairs: list[tuple[Column, object]]) -> Column:
    return F.coalesce(*[F.when(hit, F.lit(value)) for hit, value in pairs])


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def facts(message: Column) -> Column:
    """struct of what one message tells: sections and the SCALARS, null where it tells nothing of them."""
    low = F.lower(F.coalesce(message, F.lit("")))
    vehicle = _first_told([(low.rlike(rf"\b{w}\b"), v) for v, words in VEHICLES for w in words.split()])
    city = _first_told([(F.contains(low, F.lit(c)), c.title()) for c, _ in CITIES])
    by_city = _first_told([(F.contains(low, F.lit(c)), s) for c, s in CITIES])
    state = F.coalesce(by_city, _first_told([(F.contains(low, F.lit(s)), s.title()) for s in STATES]))
    hits = [(T.any_contains(low, words.split()), incident, domain) for incident, domain, words in INCIDENTS]
    amount = F.nullif(F.replace(F.regexp_extract(low, AMOUNT, 1), F.lit(","), F.lit("")), F.lit(""))
    return F.struct(
        F.transform(F.regexp_extract_all(low, F.lit(MENTIONED), F.lit(1)), F.upper).alias("sections"), _first_told([(h, i) for h, i, _ in hits]).alias("incident"),
        _first_told([(h, d) for h, _, d in hits]).alias("legal_domain"), vehicle.alias("vehicle"), state.alias("state"), city.alias("city"),
        _first_told([(T.any_contains(low, words), v) for v, words in INJURIES]).alias("injury"), _first_told([(T.any_contains(low, words), v) for v, words in FIR]).alias("fir_filed"),
        amount.alias("cheque_amount"), _first_told([(F.contains(low, F.lit("notice")) & T.any_contains(low, words), v) for v, words in NOTICE]).alias("notice_sent"),
    )


def states(messages: DataFrame, by: str = "conv_id", order: str = "turn", content: str = "content") -> DataFrame:
    """(by, SCALARS, sections, turn_count, said): the state after the last message; ``said``: the last three messages."""
    told = messages.where(T.strip(F.coalesce(content, F.lit(""))) != "").withColumn("_f", facts(F.col(content)))
    first = [F.min_by(F.col("_f")[s], F.when(F.col("_f")[s].isNotNull(), F.col(order))).alias(s) for s in SCALARS]
    inorder = lambda value: F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])
    some = F.when(F.size(F.col("_f")["sections"]) > 0, F.struct(F.col(order).alias("o"), F.col("_f")["sections"].alias("v")))
    sections = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(some)), lambda x: x["v"])))
    return told.groupBy(by).agg(*first, sections.alias("sections"), F.count(F.lit(1)).alias("turn_count"), inorder(F.col(content)).alias("_said")).select(
        by, *SCALARS, "sections", "turn_count", F.slice("_said", F.greatest(F.size("_said") - LAST + 1, F.lit(1)), F.lit(LAST)).alias("said"), F.array_join("_said", " ").alias("all_said")
    )


def _has(df: DataFrame, slot: str) -> Column:
    if slot not in df.columns:
        return F.lit(False)
    c = F.col(slot)
    return c.isNotNull() & ((F.size(c) > 0) if dict(df.dtypes)[slot].startswith("array") else F.lit(True))


def filled(df: DataFrame) -> Column:
    """The names of the slots that are filled, in the order in which they are declared."""
    return F.array_compact(F.array(*[F.when(_has(df, s), F.lit(s)) for s in DECLARED]))


def summary(df: DataFrame) -> Column:
    """The filled slots as "Label: value; ...", truth as Yes and No, lists with commas."""
    kinds = dict(df.dtypes)

    def shown(s: str) -> Column:
        if s not in kinds:
            return F.lit(None).cast("string")
        c = F.col(s)
        value = F.array_join(c, ", ") if kinds[s].startswith("array") else F.when(c, "Yes").otherwise("No") if kinds[s] == "boolean" else c.cast("string")
        return F.when(_has(df, s), F.concat(F.lit(s.replace("_", " ").title() + ": "), value))

    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*[shown(s) for s in DECLARED])), "; "), F.lit("")), F.lit("No facts collected yet."))


def check_slots(df: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, is_ready, missing_required, missing_helpful, next_slot, filled_count, required_count) of conversation states.

    Ready with enough of the needed slots, or after PATIENCE turns; without an incident only that is asked. The
    registry of slots has a fixed size."""
    there = filled(df)
    known = F.create_map(*[x for i, need, helps, n in SLOTS for x in (F.lit(i), F.struct(_strings(need).alias("need"), _strings(helps).alias("helps"), F.lit(n).alias("n")))])
    other = F.struct(_strings(OTHERWISE[0]).alias("need"), _strings(OTHERWISE[1]).alias("helps"), F.lit(OTHERWISE[2]).alias("n"))
    s = df.withColumn("_there", there).withColumn("_slots", F.coalesce(F.try_element_at(known, F.coalesce("incident", F.lit(""))), other))
    s = s.withColumn("_missing", F.array_except("_slots.need", "_there")).withColumn("_helps", F.array_except("_slots.helps", "_there"))
    count = F.size("_slots.need") - F.size("_missing")
    blank = F.coalesce("incident", F.lit("")) == ""
    ready = ~blank & ((count >= F.col("_slots.n")) | (F.col("turn_count") >= PATIENCE))
    asked = F.get(F.concat("_missing", F.slice("_helps", 1, 1)), F.lit(0))
    pick = lambda a, b: F.when(blank, a).otherwise(b)
    return s.select(
        by, ready.alias("is_ready"), pick(_strings(["incident"]), F.col("_missing")).alias("missing_required"), pick(_strings([]), F.col("_helps")).alias("missing_helpful"),
        F.when(~ready, pick(F.lit("incident"), asked)).alias("next_slot"), pick(F.lit(0), count).alias("filled_count"), pick(F.lit(1), F.col("_slots.n")).alias("required_count"),
    )


def expanded_concepts(domain: Column, incident: Column) -> Column:
    """Doctrines of the domain, then the incident in small letters; the first eight."""
    known = F.create_map(*[x for d, cs in DOCTRINES.items() for x in (F.lit(d), _strings(cs))])
    told = F.when(F.coalesce(incident, F.lit("")) != "", F.array(F.lower(incident))).otherwise(_strings([]))
    return F.slice(F.concat(F.coalesce(F.try_element_at(known, F.coalesce(domain, F.lit(""))), _strings([])), told), 1, 8)


def rewrite(df: DataFrame, by: str = "conv_id") -> DataFrame:
    """Conversation states as queries: the columns of legal_queries that retrieval takes, and ``search``, a plain search string."""
    original, low, said = F.array_join("said", " | "), F.lower(F.coalesce("incident", F.lit(""))), F.lower(F.array_join("said", " | "))
    hits = [T.any_contains(low, words) | (F.contains(said, F.lit(word)) if word else F.lit(False)) for words, word, _, _ in DEFAULTS]
    acts = F.coalesce(*[F.when(h, _strings(a)) for h, (_, _, a, _) in zip(hits, DEFAULTS)], _strings([]))
    numbers = F.coalesce(*[F.when(h, _strings(n)) for h, (_, _, _, n) in zip(hits, DEFAULTS)], _strings([]))
    words = F.regexp_extract_all(F.lower("all_said"), F.lit(r"\b[a-z]+\b"), F.lit(0))
    language = F.when(F.col("all_said").rlike("[஀-௿]"), "ta").when(F.arrays_overlap(words, _strings(ROMAN)), "ta_roman").otherwise("en")
    fir = F.when(F.col("fir_filed"), "FIR").when(~F.col("fir_filed"), "no FIR")
    keywords = F.array_compact(F.array(F.lower("incident"), F.lower("vehicle"), F.lower("injury"), fir))
    search = F.array_join(F.array_compact(F.concat(
        F.array(F.col("incident"), F.concat("vehicle", F.lit(" accident"))), F.transform("sections", lambda s: F.concat(F.lit("Section "), s)),
        F.array(F.concat("injury", F.lit(" injury")), F.col("state")),
    )), " ")
    return df.select(
        by, original.alias("original_query"), language.alias("detected_language"), F.coalesce("legal_domain", F.lit("General")).alias("legal_domain"),
        F.coalesce("incident", F.lit("Legal Dispute")).alias("incident_type"), keywords.alias("keywords"), acts.alias("suggested_acts"),
        F.when(F.size("sections") > 0, F.col("sections")).otherwise(numbers).alias("suggested_sections"), F.array_compact(F.array("vehicle")).alias("key_entities"),
        expanded_concepts(F.col("legal_domain"), F.col("incident")).alias("expanded_concepts"), F.coalesce(F.nullif(search, F.lit("")), F.lit("legal dispute India")).alias("search"),
    )

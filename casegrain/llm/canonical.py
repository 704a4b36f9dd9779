"""P2: mapping freely typed values to a canonical list, with built-in SQL functions only.

Typed values and reference names are brought to keys (words in order, words sorted, initials).
Equal keys are joined first; the rest go through a partition-based pigeonhole join: a reference key is
cut into k + 1 segments, of which at least one survives k edits within a few places of its position, so
an equality join on positional substrings finds every candidate, and ``levenshtein`` verifies it.
What matches nothing, or two entries alike, is reported through an anti-join as meaning none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "none"

# Abbreviations used in titles of acts and names of courts.
ABBREVIATIONS = {
    "acqn": "acquisition", "agri": "agricultural", "amdt": "amendment", "app": "appellate", "arbn": "arbitration",
    "assn": "association", "assns": "associations", "commn": "commission", "corpn": "corporation", "corrn": "corruption",
    "cos": "companies", "crl": "criminal", "ct": "court", "dist": "district", "distt": "district", "empt": "employment",
    "hc": "high court", "instts": "instruments", "limn": "limitation", "maint": "maintenance", "munl": "municipal",
    "possn": "possession", "prevn": "prevention", "prot": "protection", "pvt": "private", "recov": "recovery",
    "regn": "registration", "retr": "retrenchment", "sess": "sessions", "sup": "supreme", "tr": "transfer",
    "trib": "tribunal", "univ": "university",
}
# Words that carry no meaning in such names.
FILLERS = ["the", "of", "and", "to", "on", "for", "in", "at", "a", "an"]
COURT_FILLERS = [*FILLERS, "judicature", "judge", "judges", "s", "honble", "hon", "ble"]
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"


def blank(c: Column) -> Column:
    """Whether a value is null or holds white space only, Unicode white space included."""
    return F.coalesce(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f​﻿]+", ""), F.lit("")) == ""


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f​﻿]+", " "))


def _plain(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def _words(c: Column, fillers: list[str]) -> Column:
    """Words in order: abbreviations written out, fillers dropped."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    parts = F.filter(F.split(F.trim(F.regexp_replace(c, r"[^a-z]+", " ")), " "), lambda w: w != "")
    full = F.split(F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, w), w)), " "), " ")
    return F.filter(full, lambda w: (w != "") & ~w.isin(fillers))


def act_parts(typed: str) -> dict[str, Column]:
    """Columns made from a typed act: year, words and initials."""
    spaced = _spaced(F.col(typed))
    cased = F.regexp_replace(spaced, r"(?<=[a-z])(?=[A-Z][a-z])", " ")
    text = _plain(F.regexp_replace(cased, "&", " and "))
    text = F.regexp_replace(text, r"^(u/s|sec\.?|section|ss?\.)\s*\d+[a-z]?(\([0-9a-z]+\))*(-[a-z])?\s+(of\s+(the\s+)?)?", "")
    year = F.coalesce(
        F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"['’](\d{2})(?!\d)", 1), F.lit("")),
    )
    name = F.regexp_replace(text, r"\(?(?<!\d)\d{4}(\s+act)?\)?(?!\d)|['’]\d{2}(?!\d)", " ")
    name = F.regexp_replace(F.trim(F.regexp_replace(name, r"[^a-z]+$", "")), r"\s*act(\s+of)?$", "")
    bare = F.trim(F.regexp_replace(spaced, r"[\s,]*(\d{4}|['’]\d{2})\s*$", ""))
    short = F.regexp_replace(F.regexp_replace(bare, r"\s+Act$", "A"), r"[.\s]", "")
    initials = F.when(bare.rlike(r"^([A-Z]\.?\s?){2,7}( Act)?$") & short.rlike("^[A-Z]{2,8}$"), F.lower(short))
    return {"year": year, "words": _words(name, FILLERS), "whole": F.regexp_replace(name, r"[^a-z]+|^the\b", ""), "initials": initials}


def court_parts(typed: str) -> dict[str, Column]:
    spaced = _spaced(F.col(typed))
    text = _plain(spaced)
    text = F.regexp_replace(text, r"\bh\.\s*c\.?(?=\s|,|$)", "high court ")
    text = F.regexp_replace(text, r"\bs\.\s*b\.?(?=\s|,|$)", "supreme bench ")
    text = F.regexp_replace(F.regexp_replace(text, r"hon['’]?ble", " "), r"['’]s\b", " ")
    short = F.regexp_replace(spaced, r"[.\s]", "")
    initials = F.when(spaced.rlike(r"^([A-Z]\.?\s?){3,6}$"), F.lower(short))
    return {
        "year": F.lit(None).cast("string"), "words": _words(text, COURT_FILLERS),
        "whole": F.regexp_replace(text, r"[^a-z]+|^the\b", ""), "initials": initials,
    }


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _keys(df: DataFrame, carry: list[str]) -> DataFrame:
    """(carry, kind, key, words): the ways in which a name is held against another."""
    ordered = F.array_join("words", "")
    rows = F.array(
        F.struct(F.lit("ordered").alias("kind"), ordered.alias("key")),
        F.struct(F.lit("sorted").alias("kind"), F.array_join(F.array_sort("words"), "").alias("key")),
        F.struct(F.lit("whole").alias("kind"), F.col("whole").alias("key")),
        F.struct(F.lit("initials").alias("kind"), F.col("initials").alias("key")),
    )
    return (
        df.withColumn("_k", F.explode(rows))
        .select(*carry, "_k.kind", "_k.key", "words")
        .where("key IS NOT NULL AND key != ''")
    )


def act_names(acts: DataFrame) -> DataFrame:
    """(ref_id, year, kind, key, words) of the reference acts."""
    base = acts.select(F.col("act_id").alias("ref_id"), F.col("act_year").cast("string").alias("year"), F.col("canonical_name").alias("_n"))
    parts = act_parts("_n")
    base = base.select("ref_id", "year", parts["words"].alias("words"), parts["whole"].alias("whole"), F.lower("_n").rlike(r"\bact\b").alias("_act"))
    base = base.withColumn("initials", F.concat(_initials(F.col("words")), F.when(F.col("_act"), F.lit("a")).otherwise(F.lit(""))))
    return _keys(base, ["ref_id", "year"]).distinct()


def court_names(courts: DataFrame) -> DataFrame:
    """(ref_id, year, kind, key, words) of the reference courts, their seats taken in."""
    parts = court_parts("_n")
    base = courts.select(
        F.col("court_id").alias("ref_id"), F.col("canonical_name").alias("_n"), "court_level",
        F.filter(F.split(F.regexp_replace(_plain(_spaced(F.col("seat"))), r"[^a-z]+", " "), " "), lambda w: w != "").alias("_seat"),
    ).withColumn("_words", parts["words"])
    ways = F.array_compact(
        F.array(
            F.col("_words"),
            F.array_union("_words", "_seat"),
            F.concat(F.array_union("_words", "_seat"), F.array(F.lit("bench"))),
            F.when(F.col("court_level") == "high", F.concat(F.array(F.lit("high"), F.lit("court")), "_seat")),
            F.when(F.col("court_level") == "supreme", F.slice("_words", 1, 2)),
            F.when(F.col("court_level") == "supreme", F.concat(F.slice("_words", 1, 2), F.col("_seat"))),
        )
    )
    named = base.select("ref_id", F.explode(ways).alias("words"), F.col("_words").alias("_own")).select(
        "ref_id", F.lit(None).cast("string").alias("year"), "words", F.array_join("words", "").alias("whole"),
        F.when(F.col("words") == F.col("_own"), _initials(F.col("words"))).alias("initials"),
    )
    return _keys(named, ["ref_id", "year"]).distinct()


def _allowed(length: Column) -> Column:
    """Edits allowed by a key's length."""
    return F.when(length < 5, 0).when(length < 8, 1).when(length < 11, 2).when(length < 16, 3).otherwise(4)


def match(typed: DataFrame, names: DataFrame) -> DataFrame:
    """(typed, ref_id): for each distinct typed value with ``kind, key, words, year`` the one entry meant."""
    agree = (F.col("t.year").isNull() | F.col("n.year").isNull() | (F.col("t.year") == F.col("n.year"))
             | (F.col("t.year") == F.substring("n.year", -2, 2)))
    equal = (
        typed.alias("t").join(names.alias("n"), (F.col("t.kind") == F.col("n.kind")) & (F.col("t.key") == F.col("n.key")) & agree)
        .select("t.typed", "n.ref_id", F.lit(0).alias("edits"))
    )
    rest = typed.where("kind != 'initials'").join(equal.select("typed").distinct(), "typed", "left_anti")

    refs = names.where("kind != 'initials'").withColumn("len", F.length("key")).withColumn("k", _allowed(F.col("len"))).where("k > 0")
    segments = refs.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("seg")
    ).withColumn("from", F.floor(F.col("seg") * F.col("len") / (F.col("k") + 1)).cast("int")).withColumn(
        "size", (F.floor((F.col("seg") + 1) * F.col("len") / (F.col("k") + 1)) - F.col("from")).cast("int")
    ).withColumn("piece", F.expr("substring(key, from + 1, size)"))
    shapes = segments.select("kind", "len", "k", "seg", "from", "size").distinct()
    probes = (
        rest.withColumn("tlen", F.length("key")).alias("t")
        .join(F.broadcast(shapes).alias("s"), (F.col("t.kind") == F.col("s.kind")) & (F.abs(F.col("t.tlen") - F.col("s.len")) <= F.col("s.k")))
        .select("t.typed", "t.key", "t.words", "t.year", "t.kind", "tlen", "len", "seg", "size", "k",
                F.explode(F.sequence(
                    F.greatest(-F.col("seg"), F.col("tlen") - F.col("len") - (F.col("k") - F.col("seg"))),
                    F.greatest(
                        F.least(F.col("seg"), F.col("tlen") - F.col("len") + (F.col("k") - F.col("seg"))),
                        F.greatest(-F.col("seg"), F.col("tlen") - F.col("len") - (F.col("k") - F.col("seg")))),
                )).alias("shift"), "from")
        .where("from + shift >= 0 AND from + shift + size <= tlen")
        .withColumn("piece", F.expr("substring(key, from + shift + 1, size)"))
    )
    close = F.forall(
        F.zip_with("t.words", "n.words", lambda a, b: F.when(F.length(b) <= 4, F.levenshtein(a, b) <= 2).otherwise(F.levenshtein(a, b) <= 3)),
        lambda x: x,
    )
    found = (
        probes.select("typed", "key", "words", "year", "kind", "len", "seg", "piece").alias("t")
        .join(segments.alias("n"), (F.col("t.kind") == F.col("n.kind")) & (F.col("t.len") == F.col("n.len")) & (F.col("t.seg") == F.col("n.seg")) & (F.col("t.piece") == F.col("n.piece")) & agree)
        .withColumn("edits", F.levenshtein(F.col("t.key"), F.col("n.key")))
        .where("edits <= k")
        .where((F.size("t.words") != F.size("n.words")) | (F.col("t.kind") != "ordered") | close)
        .select("typed", "ref_id", "edits")
    )
    best = equal.unionByName(found).groupBy("typed", "ref_id").agg(F.min("edits").alias("edits"))
    # The closest entry, and only where no other is as close.
    return (
        best.groupBy("typed").agg(F.min_by("ref_id", "edits").alias("ref_id"), F.min("edits").alias("_m"), F.collect_list("edits").alias("_e"))
        .where(F.size(F.filter("_e", lambda e: e == F.col("_m"))) == 1)
        .select("typed", "ref_id")
    )


def _resolve(values: DataFrame, parts, names: DataFrame) -> DataFrame:
    """(typed, ref_id) of every distinct typed value; what means no entry has NONE."""
    distinct = values.select("typed").distinct()
    made = parts("typed")
    keyed = _keys(distinct.select("typed", *[c.alias(n) for n, c in made.items()]), ["typed", "year"])
    matched = match(keyed, names)
    unmatched = distinct.join(matched, "typed", "left_anti").select("typed", F.lit(NONE).alias("ref_id"))
    return matched.unionByName(unmatched)


def map_values(occurrences: DataFrame, acts: DataFrame, courts: DataFrame) -> DataFrame:
    """(field, row_id, pos, ref_id) for occurrences (field, row_id, pos, typed, is_court).

    Null and blank values are left out; a value that is a canonical name maps to its entry; ties between
    entries mean none. Repeated rows count once. Each distinct value is resolved once and joined back."""
    from casegrain.functions.lineage import cut

    there = occurrences.where(~blank(F.col("typed")))
    resolved = _resolve(there.where(~F.col("is_court")), act_parts, act_names(acts)).withColumn("is_court", F.lit(False)).unionByName(
        _resolve(there.where("is_court"), court_parts, court_names(courts)).withColumn("is_court", F.lit(True))
    )
    return there.join(cut(resolved), ["typed", "is_court"]).select("field", "row_id", "pos", "ref_id", "typed").distinct()

"""P3: variant spellings of names typed by people, by merge-and-rematch.

Every distinct string is read into a profile: what kind of party it is, the family name (or a firm's
own word, or the State), the given names (or a firm's trade), their first letters and the middle letters (or a firm's
form). Profiles that agree are merged: the merged profile holds the spellings and initials of all its
strings. The richer profiles enter blocking again, until a round over all profiles merges nothing.

Which words are given names, family names or trades is learnt from the strings themselves: "A K. B", "B, A",
"A. K. B" and forms of firms fix the role of their words, and the roles decide the strings that can't tell.
Blocking is by family name without one letter, so any single error in a name of four letters or more keeps a
common key, together with the first or the last letter of a given name, so a frequent family name is split. After
the first round only merged profiles look for full matches again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions.lineage import cut

# Titles, words for representatives and unnamed co-parties, forms of firms, abbreviations.
_TAIL = re.compile(
    r"\s*[,(]?\s*(?:(?<!\w)(?:rep(resented|d)?\b\.?\s+(by|through)|through\s+(its|the)|by\s+(its|lrs?|legal)|(s|d|w|c)/o\b|son of|daughter of|wife of"
    r"|(?<!\w)(and|&)\s+(anr|ors|others?|another)\b|\(?\s*(dead|deceased|since deceased)\b)).*$", re.I)
_LEAD = re.compile(
    r"^\s*((m/s|messrs|the|hon'?ble|hon|mr|mrs|ms|shri|sri|smt|dr|prof|adv|justice|chief justice|managing director|general manager"
    r"|secretary|chairman|commissioner|director)\b[.,]*\s*(of\s+)?)+", re.I)
_BENCH = re.compile(r"[,\s]+(c\.?j\.?i?|jj?)\.?\s*$", re.I)
_JUDGE = re.compile(r",\s*(c\.?j\.?i?|jj?)\.?\s*$", re.I)
_FIRM = re.compile(r"\b(ltd|limited|llp|l\.l\.p|pvt|private|\(p\)|co|company|sons|bros|brothers|inc|corpn|corporation)\b\.?", re.I)
FORMS = [
    (re.compile(r"\(?\b(pvt|private|\(p\)|p)\b\.?\)?\s*(ltd|limited)\b\.?\)?", re.I), "pvt"),
    (re.compile(r"\(p\)\s*(ltd|limited)\b\.?", re.I), "pvt"),
    (re.compile(r"\(?\b(llp|l\.\s?l\.\s?p)\b\.?\)?", re.I), "llp"),
    (re.compile(r"\(?\b(ltd|limited)\b\.?\)?", re.I), "ltd"),
    (re.compile(r"\(?(&|\band\b)\s*(co|company)\b\.?\)?", re.I), "co"),
    (re.compile(r"\(?(&|\band\b)\s*sons?\b\.?\)?", re.I), "sons"),
]
ABBREVIATIONS = {
    "agri": "agricultural", "chem": "chemical", "co": "company", "constn": "construction", "constrn": "construction", "corpn": "corporation",
    "engg": "engineering", "engrg": "engineering", "fin": "finance", "gen": "general", "genl": "general", "govt": "government", "hosp": "hospitals", "hsg": "housing",
    "ind": "industries", "inds": "industries", "ins": "insurance", "insce": "insurance", "insur": "insurance", "mfg": "manufacturing", "prods": "products",
    "rd": "road", "serv": "services", "servs": "services", "svcs": "services", "softw": "software", "sw": "software", "tex": "textiles", "tpt": "transport",
    "trans": "transport", "transp": "transport", "trdg": "trading", "trpt": "transport", "wks": "works",
}
_STATE = re.compile(r"^(?:(?:state|govt\.?|government) of (.+)|(.+?),\s*(?:state|govt\.?|government) of)$", re.I)

SHAPE = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("words", T.ArrayType(T.StringType())), T.StructField("letters", T.ArrayType(T.StringType())),
        T.StructField("alias", T.StringType()), T.StructField("form", T.StringType()), T.StructField("family", T.StringType()),
        T.StructField("given", T.StringType()), T.StructField("plain", T.ArrayType(T.StringType())), T.StructField("rows", T.LongType()),
    ]
)


def sound(w: str) -> str:
    """One spelling for letters that are typed for each other by ear; doubled letters once."""
    w = re.sub(r"[^a-z]", "", w.lower()).replace("oo", "u").replace("ee", "i").replace("w", "v").replace("q", "k").replace("x", "ks")
    w = re.sub(r"c(?!h)", "k", w)
    return re.sub(r"(.)\1+", r"\1", w)


def read_name(kind: str, name: str) -> dict:
    """What a string says by itself; ``family`` and ``given`` only where its form fixes them."""
    out = {"kind": kind, "name": name, "type": "person", "words": [], "letters": [], "alias": None, "form": None, "family": None, "given": None, "plain": []}
    text = re.sub(r"[\s ​﻿]+", " ", name).replace("’", "'").strip(" .,;")
    firm = bool(re.match(r"\s*(m/s|messrs)\b", text, re.I))
    text = _TAIL.sub("", text)
    if kind == "judge":
        only = _JUDGE.search(text)
        text = _BENCH.sub("", text) if only else text
    for _ in range(2):
        text = _LEAD.sub("", text).strip(" .,;")
    state = _STATE.match(text)
    if state and kind == "party":
        place = state.group(1) or state.group(2)
        return out | {"type": "state", "family": sound(place), "given": "state", "words": [sound(place)]}
    if kind == "party":
        for pattern, form in FORMS:
            if pattern.search(text):
                out["form"], firm = form, True
                text = pattern.sub(" ", text).strip(" .,;&()-")
                break
        if firm or _FIRM.search(text) or re.search(r"\b([A-Z]\.){3,}$|\b[A-Z]{4,}$", text) and not text.isupper() or re.search(r"\b[A-Za-z]\.[A-Za-z]\.[A-Za-z]\.", text):
            out["type"] = "firm"
    if out["type"] == "firm":
        parts = [p for p in re.split(r",", text) if p.strip()]
        if len(parts) == 2:
            text = parts[1] + " " + parts[0]
        dotted = r"\b(?:[A-Za-z]\.){2,}[A-Za-z]?(?![A-Za-z])"
        initials = {m.replace(".", "").lower() for m in re.findall(dotted, text)}
        text = re.sub(dotted, lambda m: m.group().replace(".", ""), text)
        words = [re.sub(r"[^a-z]", "", w.lower()) for w in re.split(r"[\s\-/&()]+|(?<=\.)(?=[A-Za-z])", text)]
        words = [ABBREVIATIONS.get(w, w) for w in words if w and w not in ("the", "and", "of", "m", "s")]
        if not words:
            return out | {"type": "other", "words": [name]}
        if "state" in words[1:]:
            k = words.index("state", 1)
        elif len(words) > 1 and len(words[-1]) > 2 and words[-1] in initials:
            k = len(words) - 1  # a place and the initials of what is the State's
        else:
            k = 1
        return out | {"words": words, "family": sound("".join(words[:k])), "given": " ".join(words[k:]) or None}
    alias = re.search(r"(\w+)\s*(?:@|alias)\s*(\w+)", text)
    if alias:
        out["alias"] = sound(alias.group(2))
        text = text.replace(alias.group(0), alias.group(1))
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    comma = text.split(",")
    parts = [w for w in re.split(r"[\s.,]+", text) if re.search("[A-Za-z]", w)]
    letters = [w.lower() for w in parts if len(w) == 1]
    words = [w for w in parts if len(w) > 1]
    if text.isupper() and len(words) > 1 and len(words[-1]) <= 2:
        letters, words = letters + list(words[-1].lower()), words[:-1]
    out["letters"], out["words"] = letters, [sound(w) for w in words]
    plain = [re.sub(r"[^a-z]", "", w.lower()) for w in words]
    out["plain"] = [ABBREVIATIONS.get(w, w) for w in plain]
    if not words:
        return out | {"type": "other", "words": [name]}
    if len(words) == 1:
        out["family"] = out["words"][0]
    elif len(words) == 2 and len(comma) == 2 and comma[0].strip() and comma[1].strip():
        out["family"], out["given"] = out["words"][0], out["words"][1]
    elif len(words) == 2 and (letters or alias) and re.match(r"[^\s.,]{2,}\s.*[^\s.,]{2,}$", text):
        out["given"], out["family"] = out["words"][0], out["words"][1]
    elif len(words) > 2:
        out["given"], out["family"] = out["words"][0], out["words"][-1]
    return out


def _read(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([read_name(k, n) | {"rows": r} for k, n, r in zip(b["kind"], b["name"], b["rows"])], columns=SHAPE.names)

    return (names if "rows" in names.columns else names.withColumn("rows", F.lit(1))).select("kind", "name", "rows").mapInPandas(run, SHAPE)


def _roles(read: DataFrame) -> DataFrame:
    """Strings that don't fix the role of their words get it from the strings that do."""
    people = read.where("type = 'person'")
    said = (
        people.where("family IS NOT NULL AND size(words) > 0").select("kind", F.col("family").alias("w"), F.lit(1).alias("f"), F.lit(0).alias("g"))
        .unionByName(people.where("given IS NOT NULL").select("kind", F.col("given").alias("w"), F.lit(0).alias("f"), F.lit(1).alias("g")))
        .unionByName(people.where("alias IS NOT NULL").select("kind", F.col("alias").alias("w"), F.lit(0).alias("f"), F.lit(1).alias("g")))
        .groupBy("w").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
        .select("w", ((F.col("g") - F.col("f")) / (F.col("g") + F.col("f") + 1.0)).alias("lean"))
    )
    open_ = people.where("family IS NULL").withColumn("w0", F.col("words")[0]).withColumn("w1", F.col("words")[1])
    told = (
        open_.join(said.select(F.col("w").alias("w0"), F.col("lean").alias("l0")), "w0", "left")
        .join(said.select(F.col("w").alias("w1"), F.col("lean").alias("l1")), "w1", "left")
        .withColumn("_first", F.coalesce("l0", F.lit(0.0)) >= F.coalesce("l1", F.lit(0.0)))
        .withColumn("given", F.when(F.col("_first"), F.col("w0")).otherwise(F.col("w1")))
        .withColumn("family", F.when(F.col("_first"), F.col("w1")).otherwise(F.col("w0")))
        .select(*SHAPE.names)
    )
    return read.where("type != 'person' OR family IS NOT NULL").unionByName(told)


def _trades(read: DataFrame) -> DataFrame:
    """A string that ends in a known trade, as the forms of firms fix it, belongs to a firm without its form."""
    trades = (
        read.where("type = 'firm' AND form IS NOT NULL AND size(words) > 1")
        .groupBy(F.element_at("words", -1).alias("_w")).agg(F.count_distinct("family").alias("n"))
        .where("n >= 3").select("_w", F.lit(True).alias("_trade"))
    )
    mixed = (F.col("kind") == "party") & (F.col("type") == "person") & (F.size("plain") > 1)
    marked = read.withColumn("_w", F.when(mixed, F.try_element_at("plain", F.lit(-1)))).join(trades, "_w", "left").drop("_w")
    firm = F.coalesce("_trade", F.lit(False))
    return (
        marked.withColumn("type", F.when(firm, F.lit("firm")).otherwise(F.col("type")))
        .withColumn("family", F.when(firm, F.get("words", F.lit(0))).otherwise(F.col("family")))
        .withColumn("given", F.when(firm, F.array_join(F.slice("plain", F.lit(2), F.size("plain")), " ")).otherwise(F.col("given")))
        .select(*SHAPE.names)
    )


def profiles(names: DataFrame) -> DataFrame:
    """(kind, name, type, family, given, alias, first, middle, rows): one row for each distinct string."""
    return (
        _roles(cut(_trades(cut(_read(names)))))
        .withColumn("_l", F.col("letters"))
        .withColumn(
            "first",
            F.when(F.col("type") != "person", F.substring(F.coalesce("given", F.lit("")), 1, 1))
            .when(F.col("given").isNotNull(), F.substring("given", 1, 1)).otherwise(F.get("_l", F.lit(0))),
        )
        .withColumn(
            "middle",
            F.when(F.col("type") == "firm", F.col("form")).when(F.col("type") != "person", F.lit(None))
            .when(F.col("given").isNotNull(), F.get("_l", F.lit(0))).otherwise(F.get("_l", F.lit(1))),
        )
        .withColumn("first", F.nullif(F.translate("first", "wqc", "vkk"), F.lit("")))
        .withColumn("middle", F.when(F.col("type") == "person", F.translate("middle", "wqc", "vkk")).otherwise(F.col("middle")))
        .select("kind", "name", "type", "family", "given", "alias", "first", "middle", "rows")
    )


def _without_one(c: str) -> Column:
    """The word and the word without each of its letters."""
    n = F.length(c)
    return F.array_distinct(
        F.concat(F.array(F.col(c)), F.when(n >= 4, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))).otherwise(F.array().cast("array<string>")))
    )


# Neighbours on the keyboard, in both directions.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEAR = " ".join(
    {a + b for row in _ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
    | {x for up, low in zip(_ROWS, _ROWS[1:]) for k, c in enumerate(low) for u in up[k : k + 2] for x in (c + u, u + c)}
)


def _slip(x: Column, y: Column) -> Column:
    """One slip of the hand: a letter missed or added, two exchanged, or a neighbouring key."""
    n = F.length(x)
    apart = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    first, last = F.get(apart, F.lit(0)), F.get(apart, F.lit(1))
    letter = lambda c, i: F.substring(c, i, F.lit(1))
    equal_length = (
        ((F.size(apart) == 1) & F.contains(F.lit(NEAR), F.concat(letter(x, first), letter(y, first))))
        | ((F.size(apart) == 2) & (last == first + 1) & (letter(x, first) == letter(y, last)) & (letter(x, last) == letter(y, first)))
    )
    return F.when(n == F.length(y), F.coalesce(equal_length, F.lit(False))).otherwise(F.levenshtein(x, y) == 1)


def _merge_clusters(p: DataFrame) -> DataFrame:
    """A profile for each cluster: all its spellings and letters; ``changed`` if a string came to it in the last round."""
    keep = lambda c: F.array_sort(F.collect_set(c))
    weight = lambda f: F.aggregate("_seen", F.lit(0).cast("long"), lambda t, x: t + F.when(x["family"] == f, x["n"]).otherwise(0))
    return p.groupBy("cluster").agg(
        F.first("kind").alias("kind"), F.first("type").alias("type"), keep("family").alias("families"), F.collect_list(F.struct("family", "n")).alias("_seen"),
        F.array_sort(F.array_distinct(F.concat(F.collect_set("given"), F.collect_set("alias")))).alias("givens"),
        keep("first").alias("firsts"), keep("middle").alias("middles"), F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.bool_or("moved").alias("changed"),
    ).withColumn("core", F.array_max(F.transform("families", lambda f: F.struct(weight(f).alias("n"), f.alias("family"))))["family"]).drop("_seen")


def _any_close(a: str, b: str) -> Column:
    """Whether two sets of given names or trades hold a pair for one: equal, an error or two apart, a short form, initials."""
    initials = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.substring(w, 1, 1)), "")

    def pair(x: Column, y: Column) -> Column:
        long = F.when(F.length(x) >= F.length(y), x).otherwise(y)
        short = F.when(F.length(x) >= F.length(y), y).otherwise(x)
        return (
            (x == y)
            | ((F.length(short) >= 5) & (F.levenshtein(x, y) <= 2) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)))
            | ((F.length(short) >= 8) & (F.levenshtein(x, y) <= 2))
            | ((F.length(short) >= 4) & (F.instr(long, " ") == 0) & (long.startswith(F.substring(short, F.lit(1), F.length(short) - 1)) | long.endswith(short)))
            | (F.contains(long, F.lit(" ")) & (F.length(short) >= 3) & (initials(long) == short))
        )

    return F.exists(F.col(a), lambda x: F.exists(F.col(b), lambda y: pair(x, y)))


#: A misspelling is far rarer than what it is meant for; up to FEW different strings nothing can be said of that.
FEW, RARER = 3, 0.1
_HELD = ["cluster", "core", "families", "givens", "firsts", "middles", "n", "rows"]


def _blocks(c: DataFrame, whole: bool) -> DataFrame:
    """(kind, type, key, cluster, asks): family names without one letter, with each first and each last letter of a given name.

    ``asks``: the cluster looks for others under this key. Clusters known by the family name only ask under the whole name."""
    free = lambda x: F.size(x) == 0
    letter = lambda x, at: F.translate(F.substring(x, at, 1), "wqc", "vkk")
    tags = F.array_distinct(F.concat(
        F.transform("firsts", lambda x: F.concat(F.lit("<"), x)), F.transform("givens", lambda x: F.concat(F.lit("<"), letter(x, 1))),
        F.transform("givens", lambda x: F.concat(F.lit(">"), letter(x, -1))),
    ))
    asks = F.lit(True) if whole else F.col("changed") | free("givens")
    keys = F.flatten(F.transform(_without_one("_f"), lambda k: F.transform("_tags", lambda t: F.struct(F.concat(k, t).alias("key"), F.col("_asks").alias("asks")))))
    named = c.select("kind", "type", "cluster", F.explode("families").alias("_f"), tags.alias("_tags"), asks.alias("_asks"), (free("givens") & free("firsts")).alias("_lone"))
    named = named.select("kind", "type", "cluster", F.explode(F.array_append(keys, F.struct(F.col("_f").alias("key"), F.col("_lone").alias("asks")))).alias("_k"))
    return named.groupBy("kind", "type", F.col("_k.key").alias("key"), "cluster").agg(F.bool_or("_k.asks").alias("asks"))


def _links(c: DataFrame, whole: bool, phases: int = 3) -> DataFrame:
    """(cluster, to): the merges of a round over the profiles ``c``; ``whole`` also looks at full matches of unchanged ones.

    Of the three kinds of merges the first ``phases`` are looked for: full names, initials, family names only."""
    free = lambda x: F.size(x) == 0
    blocks = _blocks(c, whole)
    side = lambda x: c.select(*[F.col(h).alias(f"{x}_{h}") for h in _HELD])
    met = blocks.where("asks").withColumnRenamed("cluster", "a_cluster").join(blocks.withColumnRenamed("cluster", "b_cluster"), ["kind", "type", "key"]).where("a_cluster != b_cluster")
    pairs = met.select("a_cluster", "b_cluster").distinct().join(side("a"), "a_cluster").join(side("b"), "b_cluster")
    # A family name is the same if one's usual spelling is among the other's; slips count between usual spellings
    # only, so that a misspelling between two names can't join them.
    same_family = F.array_contains("b_families", F.col("a_core")) | F.array_contains("a_families", F.col("b_core"))
    slip = same_family | _slip(F.col("a_core"), F.col("b_core"))
    middle_ok = free("a_middles") | free("b_middles") | F.arrays_overlap("a_middles", "b_middles")
    few = (F.least("a_n", "b_n") <= FEW) | (F.least("a_rows", "b_rows") <= RARER * F.greatest("a_rows", "b_rows"))
    full = ~free("a_givens") & ~free("b_givens") & middle_ok & (same_family | (few & slip)) & _any_close("a_givens", "b_givens")
    # One side knows initials, or the family name only: it goes where there is one place to go.
    initials = free("a_givens") & ~free("a_firsts") & F.arrays_overlap("a_firsts", "b_firsts") & middle_ok & (same_family | (few & slip))
    alone = free("a_givens") & free("a_firsts") & same_family
    kind = F.when(full, 1).when(initials & F.lit(phases > 1), 2).when(alone & F.lit(phases > 2), 3)
    rank = F.when(same_family, 0).otherwise(4) + F.when(F.coalesce(F.arrays_overlap("a_middles", "b_middles"), F.lit(False)), 0).otherwise(2) + free("b_givens").cast("int")
    told = cut(pairs.select("a_cluster", "b_cluster", "a_n", "b_n", kind.alias("kind"), same_family.alias("same"), rank.alias("rank")).where("kind IS NOT NULL"))
    way = lambda x, y: F.struct(F.col(x + "_cluster").alias("a_cluster"), F.col(y + "_cluster").alias("b_cluster"), F.col(x + "_n").alias("a_n"), F.col(y + "_n").alias("b_n"), "same")
    both = told.where("kind = 1").select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("_p")).select("_p.*")
    lighter = (F.col("b_n") > F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_cluster") < F.col("a_cluster")))
    down = F.when(F.col("same") & (F.col("b_cluster") < F.col("a_cluster")), F.col("b_cluster"))
    named = both.groupBy(F.col("a_cluster").alias("cluster")).agg(
        F.min(down).alias("_same"), F.max_by(F.when(~F.col("same") & lighter, F.col("b_cluster")), F.when(~F.col("same") & lighter, F.struct("b_n", -F.col("b_cluster")))).alias("_slip")
    )
    # Prefer the same family name and the same middle letter; among what is left there must be one.
    best = told.where("kind > 1").groupBy("a_cluster", "rank").agg(F.min("b_cluster").alias("to"), F.max("b_cluster").alias("_other")).groupBy("a_cluster").agg(F.min(F.struct("rank", "to", "_other")).alias("_b"))
    only = best.where("_b.to = _b._other").select(F.col("a_cluster").alias("cluster"), F.col("_b.to").alias("to"))
    return named.select("cluster", F.coalesce("_same", "_slip").alias("to")).where("to IS NOT NULL").unionByName(only)


def _follow(links: DataFrame) -> DataFrame:
    """Links whose target stays where it is this round; of two that point at each other the smaller stays."""
    back = links.select(F.col("cluster").alias("to"), F.col("to").alias("_next"))
    mutual = (F.col("_next") == F.col("cluster")) & (F.col("cluster") > F.col("to"))
    return links.join(back, "to", "left").where(F.col("_next").isNull() | mutual).select("cluster", "to")


def _moved(p: DataFrame, moves: DataFrame) -> DataFrame:
    """The profiles after a round of moves (cluster, to)."""
    return p.drop("moved").join(moves, "cluster", "left").withColumn("moved", F.col("to").isNotNull()).withColumn("cluster", F.coalesce("to", "cluster")).drop("to")


def resolve(names: DataFrame) -> DataFrame:
    """(kind, name, cluster) of every distinct string of ``names`` (kind, name).

    Null and blank strings are left out; repeated rows count once. A string of which nothing can be read
    stays alone. The rounds end when no phase merges anything: every other round leaves fewer clusters."""
    clean = names.where(F.trim(F.coalesce("name", F.lit(""))) != "").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("rows"))
    alike = ["kind", "type", "family", "given", "alias", "first", "middle"]
    strings = cut(profiles(clean).withColumn("start", F.xxhash64(*alike, F.when(F.col("type") == "other", F.col("name")))))
    # Strings of one profile go together; the rounds see each profile once.
    p = cut(
        strings.where("type != 'other'").groupBy("start", *alike).agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
        .withColumn("cluster", F.col("start")).withColumn("moved", F.lit(True))
    )
    k, whole = 0, True
    while True:
        k += 1
        links = _links(cut(_merge_clusters(p)), whole, k)
        after = cut(_moved(p, _follow(links)))
        if after.where("moved").isEmpty():
            if not links.isEmpty():  # all are in rings or lead into them: those that point downwards are no ring
                after, whole = cut(_moved(p, _follow(links.where("cluster > to")))), True
            elif whole and k > 2:
                break
            else:
                whole = True  # nothing is left unless a look at all profiles finds it
        else:
            whole = False
        p = after
    return strings.join(p.select("start", "cluster"), "start", "left").select("kind", "name", F.coalesce("cluster", "start").alias("cluster"))


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """(kind, name_a, name_b): all pairs of a cluster, name_a < name_b by code point."""
    a = resolved.select("kind", "cluster", F.col("name").alias("name_a"))
    b = resolved.select("kind", "cluster", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "cluster"]).where("name_a < name_b").select("kind", "name_a", "name_b")


def names_of(evidence: DataFrame) -> DataFrame:
    """(kind, name) of judges and of parties, petitioners and respondents together."""
    one = lambda kind, col: evidence.select(F.lit(kind).alias("kind"), F.explode(col).alias("name"))
    return one("judge", "judges").unionByName(one("party", "petitioners")).unionByName(one("party", "respondents"))

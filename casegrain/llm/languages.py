"""P4: language of texts and of the stretches of mixed texts, by compression.

A text is encoded with a zstandard raw-content dictionary of each language; the smallest encoding
names the language, and a narrow margin to the next is rejected. The dictionaries hold a bounded sample of labelled
documents whose script agrees with their label. For Tamil and Hindi in Roman letters the same sample is written as
people type it, by rule. What dictionaries of judgments lack, the register of everyday questions, is learnt from
the commonest sentences of all unlabelled texts, as far as they are told by a wide margin, in a few rounds.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents taken for each language's dictionary, at most about this many, chosen by hash.
SAMPLE_DOCS = 80
#: Bytes of a dictionary from documents, at most, and from unlabelled texts.
DICTIONARY_BYTES, LEARNT_BYTES = 60_000, 30_000
#: Sentences of unlabelled texts looked at for the dictionaries: so many of the commonest at most.
SAMPLE_TEXTS = 3000
#: The margins by which such a text must be told, round by round: first only what leaves no doubt, then what that has made plain.
LEARN_BYTES, LEARN_SHARES = 6, (0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)
#: Further rounds with the last margin, at most, until they change nothing.
LEARN_MORE = 12
LEVEL = 3
#: A stretch is rejected if the next language needs less than this many bytes, or this share, more.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.04
UNKNOWN = "und"
LABELS = ["en", "ta", "hi", "mr", "te", "bn", "ur", "zh", "ja", "th"]
#: Languages that are typed in Roman letters too; "_r" marks these.
ROMANISED = {"ta": "ta_r", "hi": "hi_r"}

# How letters are typed in Roman ones; a vowel sign takes the place of a consonant's own "a".
_CONSONANTS = dict(zip(
    "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ" + "கஙசஞடணதநபமயரலவழளறனஜஷஸஹ",
    "k kh g gh ng ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split() + "k ng s nj d n th n p m y r l v zh l r n j sh s h".split(),
))
_VOWELS = dict(zip("अआइईउऊऋएऐओऔ" + "அஆஇஈஉஊஎஏஐஒஓஔ", "a aa i ee u oo ri e ai o au".split() + "a aa i ee u oo e e ai o o au".split()))
_SIGNS = dict(zip("ािीुूृेैोौ" + "ாிீுூெேைொோௌ", "aa i ee u oo ri e ai o au".split() + "aa i ee u oo e e ai o o au".split()))
_STOPS, _NASALS, _DOT = "्்", {"ं": "n", "ँ": "n", "ः": "h"}, "\u093c"
_VOICED = {"k": "g", "th": "dh", "p": "b", "d": "d"}


def romanised(text: str, long: bool = True) -> str:
    """Devanagari and Tamil as they are typed in Roman letters, with double or single letters for long vowels.

    In Hindi the last consonant of a word has no vowel; Tamil stops are voiced between vowels. Other letters stay."""
    text = unicodedata.normalize("NFD", text)
    out: list[str] = []
    bare = False  # the last consonant still has its own vowel
    for k, c in enumerate(text):
        after = text[k + 1 : k + 2]
        if c in _CONSONANTS:
            sound = _CONSONANTS[c]
            if "\u0b80" <= c <= "\u0bff":
                before = text[k - 1 : k]
                if before and ("\u0b80" <= before <= "\u0bff") and before not in _STOPS and after not in _STOPS:
                    sound = _VOICED.get(sound, sound)
                elif sound == "d" and after in _STOPS:
                    sound = "t"
            out.append(("a" if bare else "") + sound)
            bare = True
        elif c in _SIGNS:
            out.append(_SIGNS[c])
            bare = False
        elif c in _STOPS:
            bare = False
        elif c == _DOT:
            continue
        else:
            if c in _NASALS:
                out.append(("a" if bare else "") + _NASALS[c])
            else:
                ended = bare and not c.isalpha()
                tamil = ended and k and "\u0b80" <= text[k - 1] <= "\u0bff"
                out.append(("a" if bare and (not ended or tamil) else "") + _VOWELS.get(c, c))
            bare = False
    roman = "".join(out)
    return roman if long else roman.replace("aa", "a").replace("ee", "i").replace("oo", "u")


# The scripts of a language.
SCRIPTS = {
    "en": {"LATIN"}, "ta_r": {"LATIN"}, "hi_r": {"LATIN"}, "ta": {"TAMIL"}, "hi": {"DEVANAGARI"}, "mr": {"DEVANAGARI"}, "te": {"TELUGU"},
    "bn": {"BENGALI"}, "ur": {"ARABIC"}, "zh": {"CJK"}, "ja": {"KANA", "CJK"}, "th": {"THAI"},
}

_BLOCKS = np.zeros(512, dtype=np.int64)
_NAMES = ["", "LATIN", "TAMIL", "DEVANAGARI", "TELUGU", "BENGALI", "ARABIC", "KANA", "CJK", "THAI"]
# Where the scripts lie, in blocks of 128 code points.
for _name, _ranges in {
    "LATIN": [(0x80, 0x24F), (0x1E00, 0x1EFF)], "TAMIL": [(0xB80, 0xBFF)], "DEVANAGARI": [(0x900, 0x97F)], "TELUGU": [(0xC00, 0xC7F)],
    "BENGALI": [(0x980, 0x9FF)], "ARABIC": [(0x600, 0x77F), (0xFB80, 0xFDFF)], "KANA": [(0x3080, 0x30FF)], "CJK": [(0x3400, 0x9FFF)], "THAI": [(0xE00, 0xE7F)],
}.items():
    for _a, _b in _ranges:
        _BLOCKS[_a >> 7 : (_b >> 7) + 1] = _NAMES.index(_name)
_FITS = {name: {lang for lang, s in SCRIPTS.items() if name in s} for name in _NAMES if name}
_SENTENCE = re.compile(r"[.!?…।॥۔؟。！？]+[\"'”’)\]」』]*(?:\s+|$)|\n")
_PLAIN = str.maketrans({c: " " for c in "0123456789.,;:!?\"'()[]{}<>/\\|-_@#$%^&*+=~`।॥۔؟،؛。，、！？：；“”‘’「」…—–"})


def _codes(text: str) -> np.ndarray:
    """The script of each character, as a place in _NAMES."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _BLOCKS[np.minimum(code >> 7, 511)]
    low = code | 32
    out[(low >= 97) & (low <= 122)] = 1
    return out


def scripts(text: str) -> dict[str, int]:
    """Letters and marks of each script, counted by block of code points."""
    counts = np.bincount(_codes(text), minlength=len(_NAMES))
    return {name: int(n) for name, n in zip(_NAMES, counts) if n and name}


def letter_counts(text: str) -> dict[str, np.ndarray]:
    """For each script of a text, the number of its letters before each position."""
    codes = _codes(text)
    return {_NAMES[k]: np.concatenate(([0], np.cumsum(codes == k))) for k in np.unique(codes) if k}


def clean(text: str) -> str:
    """Words apart by one space, without case, digits and signs."""
    return " " + " ".join(text.casefold().translate(_PLAIN).split()) + " "


class Compressors:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.by = {}
        for lang, data in sorted(dictionaries.items()):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by[lang] = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.kept: dict[str, tuple] = {}

    def sizes(self, text: str, among: set[str]) -> list[tuple[int, str]]:
        data = clean(text).encode("utf-8", "replace")
        return sorted((len(self.by[lang].compress(data)), lang) for lang in among)

    def classify(self, text: str, top: str | None = None) -> tuple[str | None, float, bool]:
        """(language, confidence, whether the margin is wide enough); None where there is no letter.

        The smallest encoding among the languages of the script that holds most letters (``top``, if known) wins; the
        margin is that to the next of these. Where the script has one language, English is compressed beside it for the
        confidence, but can't reject it. Roman letters of Tamil and Hindi count as these."""
        got = self.kept.get((text, top))
        if got is None:
            if top is None:
                there = scripts(text)
                if not there:
                    return None, 0.0, False
                top = max(there, key=lambda s: (there[s], s))
                if top == "CJK" and there.get("KANA", 0):
                    top = "KANA"
            fits = _FITS[top] & set(self.by)
            if not fits:  # without a dictionary only the script can tell
                return (next(iter(_FITS[top])), 0.5, True) if len(_FITS[top]) == 1 else (UNKNOWN, 0.0, False)
            sizes = {lang: n for n, lang in self.sizes(text, fits | ({"en"} & set(self.by)))}
            best, lang = min((sizes[x], x.removesuffix("_r")) for x in fits)
            others = [n for x, n in sizes.items() if x.removesuffix("_r") != lang]
            same = [sizes[x] for x in fits if x.removesuffix("_r") != lang]
            margin = min(same or others, default=best + 64) - best
            confidence = 1 - 0.5 ** (1 + max(0, margin))
            got = (lang, round(confidence, 6), not same or margin >= max(MARGIN_BYTES, MARGIN_SHARE * best))
            if len(self.kept) > 100_000:
                self.kept.clear()
            self.kept[(text, top)] = got
        return got


def dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw content for each language: a sample of labelled documents, for some languages also as they are typed in Roman letters.

    The sample is bounded by ``sample_docs`` a language and DICTIONARY_BYTES; a labelled text counts only if
    the label's script holds nine tenths of its letters. A language without such a text has no dictionary."""
    known = docs.where(F.col(lang_col).isin(LABELS) & (F.length(F.trim(text_col)) > 0))
    share = known.groupBy(lang_col).count().select(lang_col, (F.lit(sample_docs) / F.col("count") * 1_000_000).cast("long").alias("_part"))
    rows = known.join(F.broadcast(share), lang_col).where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < F.col("_part")).select(lang_col, text_col).collect()
    texts: dict[str, list[str]] = {}
    for lang, text in rows:
        there = scripts(text)
        if there and sum(there.get(s, 0) for s in SCRIPTS[lang]) >= 0.9 * sum(there.values()):
            texts.setdefault(lang, []).append(text)
    out = {}
    for lang, found in texts.items():
        whole = "".join(map(clean, sorted(found)))
        out[lang] = whole.encode()[:DICTIONARY_BYTES]
        if lang in ROMANISED:
            half = DICTIONARY_BYTES // 2
            out[ROMANISED[lang]] = b"".join(clean(romanised(whole, long)).encode("ascii", "ignore")[:half] for long in (False, True))
    return out


def _sentences(texts: DataFrame, text_col: str) -> DataFrame:
    """(text, n): the cleaned sentences of all texts and how often each stands there.

    Numbers and the order of sentences make new texts without end as a table grows, but no new sentences."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[c for c in map(clean, _SENTENCE.split(t)) if c.strip()] for t in batch], dtype=object)

    return texts.where(F.length(F.trim(text_col)) > 0).select(F.explode(split(F.col(text_col))).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _covering(texts: list[str], most: int) -> bytes:
    """The texts that bring a pair of neighbouring words which none before them has, in ``most`` bytes at most."""
    seen: set[tuple[str, str]] = set()
    out, size = [], 0
    for text in texts:
        words = text.split()
        pairs = {*zip(["", *words], [*words, ""])}
        data = text.encode()
        if pairs - seen and size + len(data) <= most:
            seen |= pairs
            out.append(data)
            size += len(data)
    return b"".join(out)


def learn(content: dict[str, bytes], texts: DataFrame, text_col: str, sample_texts: int = SAMPLE_TEXTS, shares: tuple[float, ...] = LEARN_SHARES) -> dict[str, bytes]:
    """Dictionaries with what unlabelled texts add: in each round the sentences told by the round's margin are put to their
    language; the margins start wide, lest a wrong guess teach itself, and the last is kept until nothing changes. The
    ``sample_texts`` commonest sentences, counted over all texts, and LEARNT_BYTES a language at most; what repeats is left out."""
    sample = [r[0] for r in _sentences(texts, text_col).orderBy(F.desc("n"), "text").limit(sample_texts).select("text").collect()]
    now = content
    before = None
    for k, share in enumerate([*shares, *[shares[-1]] * LEARN_MORE]):
        c = Compressors(now)
        told: dict[str, list[str]] = {}
        for text in sample:
            ranked = c.sizes(text, set(now)) if scripts(text) else []
            if ranked:
                best, lang = ranked[0]
                rest = min((n for n, other in ranked if other.removesuffix("_r") != lang.removesuffix("_r")), default=best + 64)
                if rest - best >= max(LEARN_BYTES, share * best):
                    told.setdefault(lang, []).append(text)
        if k >= len(shares) and told == before:
            break
        before = told
        now = {lang: data + _covering(told.get(lang, []), LEARNT_BYTES) for lang, data in content.items()}
    return now


def classify_texts(df: DataFrame, id_col: str, text_col: str, content: dict[str, bytes]) -> DataFrame:
    """(id, lang, confidence, accepted) of each row; null and letterless texts have null and confidence 0."""
    shared = df.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("struct<lang string, confidence double, accepted boolean>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Compressors(shared.value)
        for batch in texts:
            yield pd.DataFrame([c.classify(t) if t else (None, 0.0, False) for t in batch], columns=["lang", "confidence", "accepted"])

    return df.select(F.col(id_col).alias("_id"), run(F.col(text_col)).alias("_r")).select(F.col("_id").alias(id_col), "_r.lang", "_r.confidence", "_r.accepted")


# ---------------------------------------------------------------- stretches of mixed texts

_END = re.compile(r"(?<=[.!?…।॥۔؟])[\"'”’)\]]*\s+|(?<=[。！？])[」』”’）]*\s*|\n\s*\n|\f")
_FULL = re.compile(r"[.!?।॥۔؟。！？|][\"'”’)\]」』]*\s*$")
_TITLE = re.compile(r"\bv(s|ersus)?\.?(\s|$)", re.I)
_LINES = re.compile(r"[^\n\f]*[\n\f]|[^\n\f]+")
_DIGITS = re.compile(r"\d+")
_SOME_WORD = re.compile(r"[^\s\d.\-–—/|()\[\]]{2}")
_QUOTED = re.compile(r"[\"“「][^\"”」]*[\"”」]")


def stretches(text: str) -> list[tuple[int, int, bool, int]]:
    """(start, end, whole, paragraph) of the sentences of a text without page furniture: lines that recur, with
    other numbers or not, and lines without a word; a whole sentence ends in a full stop."""
    lines = _LINES.findall(text)
    keys = [_DIGITS.sub("0", line.strip().casefold()) for line in lines]
    seen = Counter(keys)
    body = [
        " " * (len(line) - 1) + "\n" if key and (seen[key] > 1 or (len(key) < 60 and not _SOME_WORD.search(key))) and line[-1:] in "\n\f"
        else " " * len(line) if key and seen[key] > 1 else line
        for line, key in zip(lines, keys)
    ]
    joined = "".join(body)
    out, a, paragraph = [], 0, 0
    for m in [*_END.finditer(joined), None]:
        b = m.start() if m else len(joined)
        part = joined[a:b]
        inner = part.strip()
        if inner:
            s = a + part.index(inner[0])
            e = s + len(inner)
            out.append((s, e, bool(_FULL.search(joined[max(s, e - 4) : e + 1])), paragraph))
        if m:
            a = m.end()
            gap = m.group()
            paragraph += gap.count("\n") > 1 or "\f" in gap
    return out


def languages_of(text: str, c: Compressors) -> list[tuple[int, int, str, float, bool, int]]:
    """(start, end, language, confidence, whole, sentences) of each stretch; neighbours of one language are joined.

    A paragraph in one script of which the languages lie far apart is compressed as one, others sentence by
    sentence. A rejected stretch goes with the one before it, or else the one after."""
    found = stretches(text)
    if not found:
        return []
    counts = letter_counts(text)
    parts = []
    k = 0
    while k < len(found):
        m = k
        while m < len(found) and found[m][3] == found[k][3]:
            m += 1
        a, b = found[k][0], found[m - 1][1]
        there = {name: int(n[b] - n[a]) for name, n in counts.items() if n[b] > n[a]}
        one = None
        if there:
            top = max(there, key=lambda s: (there[s], s))
            if top not in ("DEVANAGARI", "CJK", "KANA") and there[top] >= 0.97 * sum(there.values()):
                lang, confidence, accepted = c.classify(text[a:b], top)
                if accepted:
                    one = (lang, confidence)
        for s, e, whole, _ in found[k:m]:
            part = text[s:e]
            words = part.count(" ") + part.count("\n") + 1
            if one:
                lang, confidence = one
                accepted = True
            else:
                mine = {name: int(n[e] - n[s]) for name, n in counts.items() if n[e] > n[s]}
                if not mine:
                    continue
                core = _QUOTED.sub(" ", part) if len(part) > 60 and ('"' in part or "“" in part or "「" in part) else part
                best = max(mine, key=lambda x: (mine[x], x))
                if core is not part:
                    lang, confidence, accepted = c.classify(core)
                else:
                    if best == "CJK" and mine.get("KANA"):
                        best = "KANA"
                    lang, confidence, accepted = c.classify(part, best)
            spaced = lang not in ("zh", "ja", "th")
            letters = len(part) - words + 1
            whole = whole and letters >= (12 if spaced else 6) and (words >= 4 or not spaced) and not (words <= 14 and (_TITLE.search(part) or part.isupper()))
            if lang == "th":
                whole = letters >= 15
            parts.append([s, e, lang if accepted else None, confidence, whole])
        k = m
    known = next((p[2] for p in parts if p[2]), None)
    out: list[list] = []
    for p in parts:
        if p[2] is None:
            p[2], p[4] = (out[-1][2] if out else known), False
        if out and out[-1][2] == p[2]:
            out[-1][1] = p[1]
            out[-1][3] = max(out[-1][3], p[3])
            out[-1][4] = out[-1][4] or p[4]
            out[-1][5] += int(p[4])
        else:
            out.append([*p, int(p[4])])
    return [tuple(p) for p in out if p[2]]


def text_languages(df: DataFrame, id_col: str, text_col: str, content: dict[str, bytes]) -> DataFrame:
    """(id, start, end, lang, confidence, sentences) of every stretch; ``sentences`` counts the whole ones.

    Null, empty and letterless texts give no row."""
    shared = df.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("array<struct<start int, end int, lang string, confidence double, sentences int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = Compressors(shared.value)
        for batch in texts:
            yield pd.Series(
                [[{"start": a, "end": b, "lang": lang, "confidence": p, "sentences": n} for a, b, lang, p, _, n in languages_of(t, c)] if t else [] for t in batch],
                dtype=object,
            )

    return df.select(F.col(id_col).alias("_id"), F.explode(run(F.col(text_col))).alias("_s")).select(F.col("_id").alias(id_col), "_s.*")


def mixed_texts(found: DataFrame, id_col: str, least: int = 2) -> DataFrame:
    """(id, lang) of texts with whole sentences in several languages, ``least`` of each; one alone may be a page's header."""
    by = found.groupBy(id_col, "lang").agg(F.sum("sentences").alias("_n")).where(F.col("_n") >= least).select(id_col, "lang")
    several = by.groupBy(id_col).agg(F.collect_set("lang").alias("_l")).where(F.size("_l") > 1)
    return several.select(id_col, F.explode("_l").alias("lang"))

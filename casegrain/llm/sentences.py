"""P9: sentence boundaries across languages and scripts.

A hidden-event n-gram language model inserts boundary events between words: at every gap where
a boundary is possible, the model holds the probability of the words without an event against
that of an event followed by a sentence's opening, and forward-backward posteriors decide.

The model is learnt from the corpus itself. Blank lines are known boundaries, so how often a word
stands at a paragraph's end against its other places tells how likely an event follows it, and the
paragraphs' openings tell how sentences begin; expectation-maximisation over all documents refines
both. Its rounds read no text: what decides a gap are the words around it and the gaps next to it, so the first
pass leaves the distinct stretches of neighbouring gaps with their number. Counts live in hashed tables of a fixed number of buckets, so what is collected and sent to the
workers does not grow with the corpus.

A blank line always ends a sentence; inside quotation marks and brackets there is no boundary; a
paragraph's number stays with its first sentence. Where words are written without full stops (Thai),
every space is a possible gap; where they are written without spaces (Chinese, Japanese), every
final mark is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.lineage import cut

BUCKETS = 1 << 23
ROUNDS = 2
#: Distinct stretches of gaps held in a worker before they are passed on.
HELD = 200_000

_BLANK = re.compile(r"\n[^\S\n]*(?=\n)")
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_THAI = re.compile("[ก-๛]")
_CLOSERS = "\"'”’»」』)]）】"
_MARKS = ".!?…।॥|۔؟。！？"
_CHUNK = re.compile(r"\S+?(?:[。！？…]+[」』”’）】]*(?=[^\s。！？…」』”’）】])|(?=\s|\Z))|\S")
_FINAL = re.compile(rf"([{re.escape(_MARKS)}]+)([{re.escape(_CLOSERS)}]*)$")
_ONLY_MARK = re.compile(rf"^[{re.escape(_MARKS)}{re.escape(_CLOSERS)}]+$")
_NUMBER = re.compile(r"^[(\[]?(\d{1,4}|[ivxlc]{1,6}|[a-z])[.)\]]+$")
_DIGITS = re.compile(r"\d+")
_QUOTES = {"“": "”", "「": "」", "『": "』", "«": "»", "(": ")", "（": "）"}
_CASED = re.compile(r"[A-Z]")
_LATIN = re.compile(r"[A-Za-z]")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between lines that hold nothing or only white space."""
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _masked(p: str) -> list[bool]:
    """For each position after a character, whether a quotation or bracket is open there."""
    out, stack = [False] * (len(p) + 1), []
    straight = [i for i, c in enumerate(p) if c == '"']
    if len(straight) % 2:
        straight.pop()
    for a, b in zip(straight[::2], straight[1::2]):
        out[a + 1 : b + 1] = [True] * (b - a)
    for i, c in enumerate(p):
        if c in _QUOTES:
            stack.append((_QUOTES[c], i))
        elif stack and c == stack[-1][0]:
            _, a = stack.pop()
            out[a + 1 : i + 1] = [True] * (i - a)
    return out


_GLUED = re.compile(
    r"(?<=[^\W\d_]{3}[.!?…])(?=[A-Z][^\W\d_A-Z])|(?<=[^\W\d_]{4}[.!?…])(?=[^\W\d_]{4})|(?<=[।॥۔؟])(?=[^\W\d_])"
    r"|(?<=[^\W\d_]{3}[.!?…][\"”])(?=[A-Z])"
)
_INFO: dict[str, tuple] = {}


def _info(w: str) -> tuple:
    """(left, right, shape or None, Thai, only marks, case, number) of a word, kept per worker."""
    got = _INFO.get(w)
    if got is None:
        if len(_INFO) > 200_000:
            _INFO.clear()
        final, thai = _FINAL.search(w), bool(_THAI.search(w))
        got = _INFO[w] = (
            _left(w), _right(w), _shape(w) if final else None, thai, bool(_ONLY_MARK.match(w)), _case(w),
            bool(_NUMBER.match(w.lower())),
        )
    return got


class Paragraph:
    """Words of a paragraph and the gaps where an event is possible."""

    __slots__ = ("spans", "left", "right", "gaps", "shape", "case", "numbered", "end_shape", "cases")

    def __init__(self, text: str, start: int, end: int, cased: bool):
        p = text[start:end]
        spans: list[tuple[int, int]] = []
        words: list[str] = []
        for m in _CHUNK.finditer(p):
            a, b = m.span()
            w = m.group()
            if words and _info(w)[4]:
                spans[-1] = (spans[-1][0], b)
                words[-1] = words[-1] + w
                continue
            if b - a > 7 and (cuts := [x.start() for x in _GLUED.finditer(w)]):
                at = [0, *cuts, len(w)]
                for c, d in zip(at, at[1:]):
                    spans.append((a + c, a + d))
                    words.append(w[c:d])
                continue
            spans.append((a, b))
            words.append(w)
        known = [_info(w) for w in words]
        self.left = [x[0] for x in known]
        self.right = [x[1] for x in known]
        self.gaps, self.shape, self.case = [], [], []
        self.cases = [x[5] for x in known] if cased else []
        self.numbered = len(words) > 1 and known[0][6]
        self.end_shape = (known[-1][2] or "plain") if words else "plain"
        masked = None
        for i in range(len(spans) - 1):
            shape = known[i][2]
            if shape is None:
                if not (known[i][3] or known[i + 1][3]):
                    continue
                shape = "plain"
            if i == 0 and self.numbered:
                continue
            if masked is None:
                masked = _masked(p)
            if masked[spans[i][1]]:
                continue
            self.gaps.append(i)
            self.shape.append(shape)
            self.case.append(known[i + 1][5] if cased else 0)
        self.spans = [(start + a, start + b) for a, b in spans]


def _left(w: str) -> str:
    m = _FINAL.search(w)
    base = w[: m.start()] if m else w
    base = _DIGITS.sub("0", re.sub(r"\s+", "", base).casefold())
    mark = "" if not m else ("." if m.group(1)[-1] in ".।|۔。॥" else "!" if m.group(1)[-1] in "!?؟！？" else "…")
    quote = '"' if m and any(c in "\"”」』»" for c in m.group(2)) else ")" if m and m.group(2) else ""
    return base[-(8 if _THAI.search(base) else 3 if re.search(f"[{_CJK}]", base) else 12) :] + mark + quote


def _right(w: str) -> str:
    w = _DIGITS.sub("0", w.casefold())
    if _THAI.search(w):
        return w[:6]
    if re.search(f"[{_CJK}]", w):
        return w[:2]
    return w.rstrip(",;:!?।|")[:12]


def _shape(w: str) -> str:
    m = _FINAL.search(w)
    if not m:
        return "plain"
    base = w[: m.start()].lstrip("\"'“(")
    letters = re.sub(r"[\W\d_]", "", base)
    kind = (
        "none" if not base else "number" if base[-1].isdigit() else "dotted" if "." in base
        else "initial" if len(letters) <= 2 else "short" if len(letters) <= 3 else "word"
    )
    return kind + m.group(1)[-1] + ('"' if m.group(2) else "")


def _case(x: str) -> int:
    """1 for a capital, -1 for a small letter, 0 where neither can be told."""
    c = x.lstrip("\"'“(‘[")[:1]
    return 1 if c.isupper() else -1 if c.islower() else 0


def parse(text: str) -> list[Paragraph]:
    cased = bool(_CASED.search(text)) and bool(_LATIN.search(text))
    return [q for a, b in paragraphs(text) if (q := Paragraph(text, a, b, cased)).spans]


# ---------------------------------------------------------------- counting


def _known(q: Paragraph, n: Counter) -> None:
    """Counts that need no posterior: unigrams, paragraph ends and openings."""
    right, left = q.right, q.left
    n.update(right)
    n["N"] += len(right)
    n["pe\x1f" + left[-1]] += 1
    n["ps\x1f" + q.end_shape] += 1
    first = 1 if q.numbered else 0
    n["po\x1f" + right[first]] += 1
    n["PO"] += 1
    if first + 1 < len(right):
        n[f"p2\x1f{right[first]}\x1f{right[first + 1]}"] += 1
    open_to_case = set(q.gaps)
    for i, s in zip(q.gaps, q.shape):
        n["gv\x1f" + left[i]] += 1
        n["gs\x1f" + s] += 1
    for i in range(first + 1, len(q.cases)):
        if q.cases[i] and i - 1 not in open_to_case:
            n[("uc\x1f" if q.cases[i] > 0 else "lc\x1f") + right[i]] += 1


#: Stands for a word where there is none; words hold no white space, to which these belong.
_NONE, _FIELD, _GAP = "\x1d", "\x1f", "\x1e"


class Stretch:
    """Neighbouring gaps by their words alone; gaps further off don't bear on them."""

    __slots__ = ("gaps", "raw")

    def __init__(self, text: str):
        self.raw = [tuple(g.split(_FIELD)) for g in text.split(_GAP)]
        self.gaps = list(range(len(self.raw)))


def _stretches(q: Paragraph) -> Iterator[str]:
    """The paragraph's gaps as text, those of neighbouring gaps together."""
    held: list[str] = []
    for k, i in enumerate(q.gaps):
        if held and q.gaps[k - 1] != i - 1:
            yield _GAP.join(held)
            held = []
        held.append(_FIELD.join((
            q.left[i - 1] if i else _NONE, q.left[i], q.right[i + 1], q.right[i + 2] if i + 2 < len(q.right) else _NONE, q.shape[k], str(q.case[k]),
        )))
    if held:
        yield _GAP.join(held)


def _expected(q: Stretch, model: "Model", post: list[float], n: Counter, times: int) -> None:
    """Counts of the likelier case in each gap of a stretch that occurs so many times."""
    for k, e in enumerate(post):
        u, v, x, y, s, _ = model.context(q, k)
        if e > 0.5:
            n["o\x1f" + x] += times
            n["O"] += times
            n[f"o2\x1f{x}\x1f{y}"] += times
            n[f"e2\x1f{u}\x1f{v}"] += times
        else:
            n[f"c2\x1f{u}\x1f{v}\x1f{x}"] += times
            n[f"c1\x1f{v}\x1f{x}"] += times
            n["cv\x1f" + v] += times
            n[f"c0\x1f{s}\x1f{x}"] += times
            n["cs\x1f" + s] += times
            n[f"d\x1f{v}\x1f{x}\x1f{y}"] += times
        n[f"n2\x1f{u}\x1f{v}"] += times


# ---------------------------------------------------------------- the model

#: A word ends its sentence in one of these shares of its places; what each share is worth, by the word's
#: shape, before its paragraph ends are looked at.
_SHARES = (0.005, 0.15, 0.5, 0.99)
_STRONG = (0.01, 0.02, 0.02, 0.95)
_WEIGHTS = {
    "word": (0.05, 0.05, 0.05, 0.85), "short": (0.3, 0.2, 0.2, 0.3), "dotted": (0.5, 0.25, 0.15, 0.1),
    "initial": (0.6, 0.3, 0.07, 0.03), "number": (0.3, 0.2, 0.2, 0.3), "plain": (0.3, 0.2, 0.2, 0.3), "none": (0.3, 0.1, 0.1, 0.5),
}


class Model:
    """Reads the hashed table; factors are kept per worker by context."""

    def __init__(self, table: np.ndarray):
        self.t = table
        self.kept: dict[tuple, tuple[float, float]] = {}
        self.priors: dict[tuple, float] = {}
        self.names: dict[tuple, str] = {}
        self.rare = max(4.0, 1e-6 * self.at("N"))

    def at(self, key: str) -> float:
        return float(self.t[xxhash.xxh32_intdigest(key) % BUCKETS])

    def seen(self, w: str, left: bool) -> str:
        """The word itself, or the class of rare words."""
        got = self.names.get((w, left))
        if got is None:
            n = self.at("pe\x1f" + w) + self.at("gv\x1f" + w) if left else self.at(w)
            got = w if n >= self.rare or w[:1] == "0" or len(w) < 3 else "~" + (w[-1] if left and w[-1] in '."!…' else "")
            if len(self.names) > 200_000:
                self.names.clear()
            self.names[(w, left)] = got
        return got

    def context(self, q: Paragraph | Stretch, k: int) -> tuple:
        """(word before the last, last word, next, next but one, shape, case) of a gap."""
        i, seen = q.gaps[k], self.seen
        if isinstance(q, Stretch):
            u, v, x, y, s, case = q.raw[k]
            return "<s>" if u == _NONE else seen(u, True), seen(v, True), seen(x, False), "</p>" if y == _NONE else seen(y, False), s, int(case)
        return (
            seen(q.left[i - 1], True) if i else "<s>", seen(q.left[i], True), seen(q.right[i + 1], False),
            seen(q.right[i + 2], False) if i + 2 < len(q.right) else "</p>", q.shape[k], q.case[k],
        )

    def share(self, s: str) -> float:
        """How many of the sentences that end like this shape end a paragraph: read off full words before
        the same mark, nearly all of which end a sentence."""
        mark = s[len("word") :] if s.startswith("word") else s.lstrip("abcdefghijklmnopqrstuvwxyz")
        if not mark:
            return 0.3
        ends, inside = self.at("ps\x1fword" + mark), self.at("gs\x1fword" + mark)
        return min(0.9, max(0.05, (ends + 3) / (ends + inside + 10)))

    def event(self, v: str, s: str, case: int) -> float:
        """Probability of an event after a word: its paragraph ends against the share expected."""
        ends, inside = self.at("pe\x1f" + v), self.at("gv\x1f" + v)
        r = self.share(s)
        kind = s.rstrip(_MARKS + '"')
        weights = _STRONG if s.rstrip('"')[-1:] in "!?।॥۔؟。！？" and kind != "none" else _WEIGHTS[kind]
        logs = [math.log(w) + ends * math.log(p * r) + inside * math.log(1 - p * r) for w, p in zip(weights, _SHARES)]
        top = max(logs)
        post = [math.exp(x - top) for x in logs]
        e = sum(w * p * (1 - r) / (1 - p * r) for w, p in zip(post, _SHARES)) / sum(post)
        return max(e, 0.5) if weights is _STRONG and (ends or case > 0) else e

    def capital(self, x: str) -> float:
        """Share of capitals of a word where no sentence begins."""
        up, low = self.at("uc\x1f" + x), self.at("lc\x1f" + x)
        return min(1.0, (up + 0.05) / (up + low + 0.2 + 0.05 * self.at(x)))

    def prior(self, c: tuple) -> float:
        """First guess of an event, from paragraph ends and openings alone."""
        got = self.priors.get(c)
        if got is None:
            u, v, x, _, s, case = c
            e = self.event(v, s, case)
            opening = (self.at("po\x1f" + x) + 0.02) / (self.at("PO") + 1)
            common = (self.at(x) + 0.05) / (self.at("N") + 1)
            full = s.startswith("word")
            odds = e / (1 - e) * min(30.0, max(0.2 if full and not case else 0.02, opening / common))
            if case:
                odds *= 1 / self.capital(x) if case > 0 else 0.002
            odds = odds * odds  # sharpened, lest what is unsure be learnt as a habit
            got = odds / (1 + odds)
            if len(self.priors) > 200_000:
                self.priors.clear()
            self.priors[c] = got
        return got

    def factors(self, c: tuple) -> tuple[float, float]:
        """The probability of what follows the gap (without, with) an event."""
        got = self.kept.get(c)
        if got is not None:
            return got
        u, v, x, y, s, case = c
        at = self.at
        size = at("N") + 1e4
        unigram, second = (at(x) + 0.5) / size, (at(y) + 0.5) / size
        event = self.event(v, s, case)
        event = (at(f"e2\x1f{u}\x1f{v}") + 20 * event) / (at(f"n2\x1f{u}\x1f{v}") + 20)
        rest = (at(f"c0\x1f{s}\x1f{x}") + 5 * unigram) / (at("cs\x1f" + s) + 5)
        rest = (at(f"c1\x1f{v}\x1f{x}") + 5 * rest) / (at("cv\x1f" + v) + 5)
        inner = at(f"n2\x1f{u}\x1f{v}") - at(f"e2\x1f{u}\x1f{v}")
        rest = (at(f"c2\x1f{u}\x1f{v}\x1f{x}") + 10 * rest) / (max(0.0, inner) + 10)
        start = (at("o\x1f" + x) + 2 * at("po\x1f" + x) + 20 * unigram) / (at("O") + 2 * at("PO") + 20)
        after_start = (at(f"o2\x1f{x}\x1f{y}") + at(f"p2\x1f{x}\x1f{y}") + 5 * second) / (at("o\x1f" + x) + at("po\x1f" + x) + 5)
        after_rest = (at(f"d\x1f{v}\x1f{x}\x1f{y}") + 5 * second) / (at(f"c1\x1f{v}\x1f{x}") + 5)
        event = min(0.999, event)
        without, event_path = (1 - event) * rest * after_rest**0.5, event * start * after_start**0.5
        if case > 0:
            without *= self.capital(x)
        elif case < 0:
            event_path *= 0.002
        if len(self.kept) > 200_000:
            self.kept.clear()
        self.kept[c] = (without, event_path)
        return without, event_path

    def first_guess(self, q: Paragraph | Stretch) -> list[float]:
        return [self.prior(self.context(q, k)) for k in range(len(q.gaps))]

    def posteriors(self, q: Paragraph | Stretch) -> list[float]:
        """Forward-backward over the gaps; the state is whether an event stands in the gap. It reaches
        the next gap only where that follows after a single word, whose history then is the opening."""
        m = len(q.gaps)
        if not m:
            return []
        step = []
        for k in range(m):
            c = self.context(q, k)
            plain = self.factors(c)
            near = k and q.gaps[k] == q.gaps[k - 1] + 1
            step.append((plain, self.factors(("<s>", *c[1:])) if near else plain))
        a0, a1 = step[0][0]
        forward = [(a0 / (a0 + a1), a1 / (a0 + a1))]
        for k in range(1, m):
            f0, f1 = forward[-1]
            (p00, p01), (p10, p11) = step[k]
            a0, a1 = f0 * p00 + f1 * p10, f0 * p01 + f1 * p11
            forward.append((a0 / (a0 + a1), a1 / (a0 + a1)))
        b0 = b1 = 1.0
        out = [0.0] * m
        for k in range(m - 1, -1, -1):
            p0, p1 = forward[k][0] * b0, forward[k][1] * b1
            out[k] = p1 / (p0 + p1)
            (p00, p01), (p10, p11) = step[k]
            b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
        return out


# ---------------------------------------------------------------- over a corpus


def _buckets(n: Counter) -> pd.DataFrame:
    """Hashed counts, added up by bucket."""
    out: Counter = Counter()
    for key, v in n.items():
        out[xxhash.xxh32_intdigest(key) % BUCKETS] += v
    n.clear()
    return pd.DataFrame({"bucket": pd.array(list(out), dtype="Int32"), "stretch": None, "n": list(out.values())})


def _read(docs: DataFrame, text_col: str) -> DataFrame:
    """(bucket, stretch, n): the one pass over all texts of the fit. A row is a bucket of the counts that need
    no posterior, or a distinct stretch of neighbouring gaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Counter = Counter()
        gaps: Counter = Counter()

        def told() -> pd.DataFrame:
            out = pd.DataFrame({"bucket": pd.array([None] * len(gaps), dtype="Int32"), "stretch": list(gaps), "n": list(gaps.values())})
            gaps.clear()
            return out

        for b in batches:
            for text in b[text_col]:
                if text:
                    for q in parse(text):
                        _known(q, known)
                        gaps.update(_stretches(q))
            if len(gaps) > HELD:
                yield told()
            if len(known) > 5 * HELD:
                yield _buckets(known)
        if gaps:
            yield told()
        if known:
            yield _buckets(known)

    rows = docs.select(text_col).mapInPandas(run, "bucket int, stretch string, n long")
    return cut(rows.groupBy("bucket", "stretch").agg(F.sum("n").alias("n")))


def _table(rows: DataFrame) -> np.ndarray:
    """The counts of (bucket, n) rows."""
    got = rows.toPandas()
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[got["bucket"].to_numpy(dtype="int64")] = got["n"].to_numpy(dtype="float64")
    return out


def _round(stretches: DataFrame, shared, first: bool) -> np.ndarray:
    """One round of expectation-maximisation over all stretches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        n: Counter = Counter()
        for b in batches:
            for text, times in zip(b["stretch"], b["n"].tolist()):
                q = Stretch(text)
                _expected(q, model, model.first_guess(q) if first else model.posteriors(q), n, times)
            if len(n) > 5 * HELD:
                yield _buckets(n)[["bucket", "n"]]
        if n:
            yield _buckets(n)[["bucket", "n"]]

    return _table(stretches.mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """The model's table, of BUCKETS numbers. The counts and all rounds of expectation-maximisation are taken
    over every text."""
    sc = docs.sparkSession.sparkContext
    read = _read(docs, text_col)
    known = _table(read.where("bucket IS NOT NULL").select("bucket", "n"))
    stretches = read.where("stretch IS NOT NULL").select("stretch", "n")
    table = known
    for k in range(rounds):
        shared = sc.broadcast(table)
        table = known + _round(stretches, shared, k == 0)
        shared.unpersist()
    return table


def spans(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; together they hold all of it but white space."""
    out = []
    for q in parse(text):
        start = q.spans[0][0]
        for i, e in zip(q.gaps, model.posteriors(q)):
            if e > 0.5:
                out.append((start, q.spans[i][1]))
                start = q.spans[i + 1][0]
        out.append((start, q.spans[-1][1]))
    return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: np.ndarray | None = None) -> DataFrame:
    """(id, sent_start, sent_end) of every sentence; offsets count code points, the end is exclusive.

    Null, empty and blank texts have no sentence; repeated rows give their sentences once."""
    if table is None:
        table = fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<struct<a int, b int>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Model(shared.value)
        for batch in texts:
            yield pd.Series([[{"a": a, "b": b} for a, b in spans(x, t)] if x else [] for x in batch], dtype=object)

    return (
        docs.select(F.col(id_col).alias("_id"), F.explode(find(F.col(text_col))).alias("_s"))
        .select(F.col("_id").alias(id_col), F.col("_s.a").alias("sent_start"), F.col("_s.b").alias("sent_end"))
        .distinct()
    )

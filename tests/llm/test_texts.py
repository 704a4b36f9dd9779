import random
import unicodedata

import pytest

from casegrain.llm import charforms, packing, sentences, splitting, tokens

BIG = " ".join(f"Sentence number {i} of the judgment stands here." for i in range(900))


@pytest.mark.parametrize("text", [BIG, "x" * 9000, "வழக்கு " * 900, "a\n\n" * 3000, "க்ஷ" * 3000, "中文。" * 2000, BIG[:2401], "é" * 2400])
@pytest.mark.parametrize("limit,overlap", [(2400, 200), (300, 0), (100, 99)])
def test_split_invariants(text, limit, overlap):
    cuts = splitting.cut_points(text, limit, overlap)
    assert cuts[0][1] == cuts[0][2] == 0 and cuts[-1][3] == len(text)
    for (_, a, f, b), (_, a2, f2, _b2) in zip(cuts, cuts[1:]):
        assert f2 == b and b - overlap <= a2 <= b
    assert all(b - a <= limit and b > f for _, a, f, b in cuts)
    assert (len(cuts) > 1) == (len(text) > limit)


def test_split_at_pauses():
    cuts = splitting.cut_points(BIG, 2400, 200)
    assert all(BIG[f - 2 : f] == ". " for _, _, f, _ in cuts[1:])


def test_split_frame(spark):
    rows = [(1, None, 9, "x"), (2, "", 9, "x"), (3, "short", 9, "x"), (4, BIG, 9, "x"), (4, BIG, 9, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, piece_no int, piece string")
    got = splitting.split_oversized(df).collect()
    assert {r.doc_id for r in got} == {3, 4} and max(len(r.piece) for r in got) <= 2400
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_char_forms():
    same = ["The ﬁne café No. 5", "The fine café No. 5", "Ｔhe fine café No. 5", "The fi​ne café No. 5", "Тhe finе café No. 5"]
    assert len({charforms.visible_text(x) for x in same}) == 1 and len({charforms.canonical_text(x) for x in same}) == 1
    for a, b in (("5", "6"), ("½", "1/2"), ("The", "the"), ("™", "TM"), ("क्‍ष", "क्ष")):
        assert charforms.visible_text(a) != charforms.visible_text(b)
    for x in [*same, "STRASSE ß", "ǅ", "ﷺ"]:
        c = charforms.canonical_text(x)
        assert charforms.canonical_text(c) == c
    assert unicodedata.is_normalized("NFC", charforms.visible_text("é"))


def test_same_look(spark):
    rows = [("a", "x 1"), ("b", "x 1"), ("c", "x 2"), ("a", "x 1"), ("d", None), ("e", " "), ("f", "​"), ("g", "x 1"), (None, "x 1")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as key_a", "2 as _c")
    assert {tuple(r) for r in charforms.same_look(df, "doc_id", "text").collect()} == {("a", "b"), ("b", "g")}
    assert charforms.same_look(df.limit(0), "doc_id", "text").count() == 0


TEXTS = ["", None, "  ", "Hello's world, it'll 123 <|endoftext|> \n\n  x", "தமிழ் உரை 45", "日本語。テスト", "a" * 5000, "  tab\t\r\n", "🙏🏽 ok", "No. 5"]


def test_tokens_round_trip(spark):
    enc = tokens.encoder()
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _word string")
    got = tokens.encode_corpus(df).collect()
    assert {r.doc_id: r.ids for r in got} == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)} and len(got) == len(TEXTS)
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_packing_rule():
    rng = random.Random(3)
    import numpy as np

    sizes = np.array([rng.randint(1, 60) for _ in range(3000)])
    bins = packing.sum_of_squares(sizes, 100)
    filled = np.bincount(bins, sizes)
    assert filled.max() <= 100 and sizes.sum() / (100 * len(filled)) > 0.98
    # against the rule spelt out
    n, out = {}, []
    for k, s in enumerate(sizes[:200].tolist()):
        options = [(2 * n.get(100 - s, 0) + 1 if s < 100 else 0, 1000, None)]
        for gap, c in sorted(n.items()):
            if c and gap >= s:
                options.append(((2 * (n.get(gap - s, 0) - c) + 2) if gap > s else 1 - 2 * c, gap, gap))
        _, _, gap = min(options, key=lambda o: (o[0], o[1]))
        if gap is not None:
            n[gap] -= 1
            if gap > s:
                n[gap - s] = n.get(gap - s, 0) + 1
        elif s < 100:
            n[100 - s] = n.get(100 - s, 0) + 1
        out.append(gap is None)
    seen, opened = set(), []
    for b in bins[:200]:
        opened.append(b not in seen)
        seen.add(b)
    assert opened == out


def test_pack_frame(spark):
    rows = [(1, 5000, 0), (2, 48, 0), (2, 48, 0), (3, 0, 0), (4, None, 0), (5, 2048, 0)]
    df = spark.createDataFrame(rows, "doc_id int, n int, piece int")
    got = packing.pack(df, ["doc_id"], "n").collect()
    used, per = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.piece_size
        per.setdefault(r.doc_id, []).append(r.piece_size)
    assert max(used.values()) <= 2048 and sorted(per[1]) == [904, 2048, 2048] and per[2] == [48, 48] and set(per) == {1, 2, 5}
    assert packing.pack(df.limit(0), ["doc_id"], "n").count() == 0


def corpus():
    rng = random.Random(5)
    subjects, verbs = ["The court", "The tenant", "It", "She", "No order", "Counsel for Mr. A. Rao"], ["went on", "was paid Rs. 500", "lost", "saw p. 12 of the file", "came at 9 a.m. sharp"]
    out, gold = [], []
    for _ in range(600):
        parts = [[f"{rng.choice(subjects)} {rng.choice(verbs)}{rng.choice('..?')}" for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        out.append("\n\n".join(" ".join(p) for p in parts))
        gold.append([s for p in parts for s in p])
    return out, gold


def test_sentences(spark):
    texts, gold = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(-1, None, 0), (-2, " \n ", 0), (0, texts[0], 0)], "doc_id int, text string, sent_start int")
    got = {}
    for r in sentences.sentences(df).collect():
        got.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    assert set(got) == set(range(len(texts)))
    right = total = 0
    for i, want in enumerate(gold):
        spans = sorted(got[i])
        assert "".join(texts[i][a:b] for a, b in spans).replace(" ", "") == "".join(texts[i].split())
        found = [texts[i][a:b] for a, b in spans]
        right += sum(s in found for s in want)
        total += len(want)
    assert right / total > 0.97
    assert sentences.sentences(df.limit(0)).count() == 0


def test_sentence_rules():
    import numpy as np

    m = sentences.Model(np.zeros(sentences.BUCKETS, dtype=np.float32))
    text = '1. He said, "I ran. It stopped." and left.\n\n HEADING \n \nNext one'
    assert [text[a:b] for a, b in sentences.spans(text, m)] == ['1. He said, "I ran. It stopped." and left.', "HEADING", "Next one"]
    assert sentences.spans("", m) == [] and len(sentences.spans("word " * 20000, m)) == 1


def test_equal_texts_are_one_text(spark):
    """Copies aren't paired with each other; each is paired with every text that looks the same, and classes need no pairs."""
    rows = [(f"a{k}", "the court held") for k in range(4)] + [("b", "the  court held"), ("c", "the\u00a0court held"), ("d", "another"), ("e", None), ("f", " ")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    pairs = {tuple(r) for r in charforms.same_look(df, "doc_id", "text").collect()}
    assert not any(x.startswith("a") and y.startswith("a") for x, y in pairs) and {(f"a{k}", "c") for k in range(4)} <= pairs
    classes = {r.doc_id: r.representative for r in charforms.look_classes(df, "doc_id", "text").collect()}
    assert classes["a3"] == classes["c"] == "a0" and classes["d"] == "d" and "e" not in classes and "f" not in classes

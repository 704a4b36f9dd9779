from collections import Counter

import numpy as np

from casegrain.llm import sentences


def test_fit_counts_every_document(spark):
    """The rounds run over every text, however many there are: each gap is counted once, with an event or without."""
    texts = [f"The judge no. {i} sat on. It rained on day {i % 7}. None came.\n\nThe rest left at {i % 5} p.m. sharp." for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").crossJoin(spark.range(120).select("id"))
    parsed = [q for t in texts for q in sentences.parse(t)]
    model = sentences.Model(sentences.fit(df.selectExpr("doc_id * 1000 + id AS doc_id", "text")))
    counted = model.at("O") + sum(model.at("cs\x1f" + s) for s in {s for q in parsed for s in q.shape})
    assert counted == 120 * sum(len(q.gaps) for q in parsed)


def test_stretches_hold_all_of_a_gap():
    text = "One two. x. y. Three <s> four. Rs. 5 was paid.\n\nแรก สอง สาม สี่ Mr. A. B. Rao ran! He won. End."
    counts = Counter()
    for q in sentences.parse(text):
        sentences._known(q, counts)
    table = np.zeros(sentences.BUCKETS, dtype=np.float32)
    for key, n in counts.items():
        table[sentences.xxhash.xxh32_intdigest(key) % sentences.BUCKETS] += n
    model = sentences.Model(table)
    for q in sentences.parse(text):
        parts = [sentences.Stretch(x) for x in sentences._stretches(q)]
        assert [model.context(p, k) for p in parts for k in p.gaps] == [model.context(q, k) for k in range(len(q.gaps))]
        assert np.allclose([e for p in parts for e in model.posteriors(p)], model.posteriors(q))

import itertools

import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import toxicity
from basketry.llm.words import slices
from tests.llm.plain import remainder

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def known(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return docs, labels, toxicity.learn_from(docs, labels)


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(2)
    model = toxicity.Chain(np.zeros(0, dtype=np.uint64))
    model.move = rng.normal(size=(2, 2))
    odds = rng.normal(size=11)
    opens = np.isin(np.arange(11), [0, 6, 7])
    closes = np.isin(np.arange(11), [5, 6, 10])
    want = []
    for low, high in ((0, 6), (6, 7), (7, 11)):
        total, on = 0.0, np.zeros(high - low)
        for path in itertools.product((0, 1), repeat=high - low):
            score = np.exp(
                np.dot(path, odds[low:high]) + sum(model.move[a, b] for a, b in zip(path, path[1:]))
            )
            total += score
            on += score * np.array(path)
        want += list(on / total)
    assert np.allclose(model.marginals(odds, opens, closes), want)
    # Pieces of any length give the same.
    whole = toxicity._chain
    for piece in (1, 3, 4):
        toxicity._chain = lambda *a, piece=piece: whole(*a, piece=piece)
        try:
            assert np.allclose(model.marginals(odds, opens, closes), want)
        finally:
            toxicity._chain = whole


def test_window_marginals_are_those_of_the_chain():
    rng = np.random.default_rng(3)
    model = toxicity.Chain(np.zeros(0, dtype=np.uint64))
    model.move = rng.normal(size=(2, 2))
    odds = rng.normal(size=(4, 9))
    node, edge = toxicity._window_marginals(odds, model.move)
    opens, closes = np.tile(np.arange(9) == 0, 4), np.tile(np.arange(9) == 8, 4)
    assert np.allclose(node.ravel(), model.marginals(odds.ravel(), opens, closes))
    assert np.isclose(edge.sum(), 4 * 8)


def test_held_out_documents(spark, known):
    docs, labels, _ = known
    got = toxicity.op5_toxicity_crf(spark, FOLDER)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    truth = [(r.toxic, rows[r.doc_id]) for r in labels.collect() if remainder(r.doc_id, 3) == 1]
    hit = sum(r.predicted for t, r in truth if t == 1)
    assert hit >= 0.6 * sum(t for t, _ in truth)
    assert sum(r.predicted for t, r in truth if t == 0) <= 0.02 * len(truth)


def test_spans_are_code_points(spark, known):
    _, _, model = known
    text = "Ääß é the idiot of it.\nAnd … IDIOT, in the end"
    df = spark.createDataFrame([(1, text, 0.5)], "id int, text string, Score double")
    row = toxicity.tag(df, model).first()
    assert {text[s.start : s.end].lower() for s in row.spans} == {"idiot"} and len(row.spans) == 2


def test_clean_keeps_rows_and_columns(spark, known):
    _, labels, _ = known
    docs = known[0].withColumnsRenamed({"source": "Score", "lang": "spans"})
    odd = spark.createDataFrame(
        [(None, None, "x", "y", 1), (7, "", "x", "y", 0), (7, "", "x", "y", 0)], docs.schema
    )
    kept = toxicity.clean(docs.union(odd), labels)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum(r.text is None for r in rows) == 1 and sum(r.text == "" for r in rows) == 2
    assert 850 < len(rows) < 980


def test_without_labels_or_documents(spark, known):
    docs, labels, _ = known
    nothing = toxicity.learn_from(docs, labels.filter("toxic = 0"))
    assert nothing is None and toxicity.tag(docs.limit(5), nothing).first().score == 0
    assert toxicity.learn_from(docs.limit(0), labels) is None
    assert toxicity.clean(docs.limit(0), labels).count() == 0
    few = toxicity.learn(["bad words", "good words", "", "good"], [1, 0, 0, 0])
    assert few is not None


def test_long_text(known):
    _, _, model = known
    words = next(slices(pa.array(["the idiot " + "of the end " * 100_000])))[1]
    p = model.marginals(model.odds(toxicity._features(words)), *toxicity._bounds(words))
    assert len(p) == 300_002 and p[1] > 0.5 and p[1000:].max() < 0.5


def test_short_texts_teach():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}x" for i in range(300)]
    texts, toxic = [], []
    for i in range(800):
        words = list(rng.choice(vocabulary, 8 - i % 5))
        if i % 2:
            words[rng.integers(len(words))] = "vile"
        texts.append(" ".join(words))
        toxic.append(i % 2)
    model = toxicity.learn(texts, toxic)
    words = next(slices(pa.array(["w1x w2x vile", "w1x w2x w3x", "vile"])))[1]
    p = model.marginals(model.odds(toxicity._features(words)), *toxicity._bounds(words))
    assert p[2] > 0.9 and p[6] > 0.5 and max(p[0], p[1], *p[3:6]) < 0.1
    score = 1 / (1 + np.exp(-toxicity._summary(words, p) @ model.curve))
    assert score[0] > 0.9 and score[1] < 0.1


def test_sample_places_go_to_documents_that_count(spark):
    docs = spark.createDataFrame(
        [(i, "x" * 50 if i < 90 else f"word {i}") for i in range(100)] + [(95, "other")] * 5,
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, toxic=2, clean=2, chars=10).collect()
    assert sorted(r.toxic for r in rows) == [0, 0, 1, 1]

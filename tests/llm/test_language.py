import math
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import sentencepiece

import public_tokenizers
from basketry.llm import language
from basketry.llm.words import slices
from tests.llm.plain import remainder

FOLDER = "/root/testdata/sf0.01"


def pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(language.VOCABULARY))
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            yield model.id_to_piece(i), i


def some_chances(size, languages=2):
    out = np.random.default_rng(0).random((size, languages))
    return out / out.sum(axis=0)


def test_forward_sums_all_segmentations():
    known, vocabulary = dict(pieces()), language.trie()
    chances = some_chances(vocabulary.size)

    def brute(text):
        if not text:
            return np.ones(2)
        out = language._UNKNOWN * brute(text[1:])
        for i in range(1, len(text) + 1):
            if text[:i] in known:
                out = out + chances[known[text[:i]]] * brute(text[i:])
        return out

    words = ["▁the", "▁éèqu", "▁ñad", "x", "▁th中", "▁"]
    table, length = language._table([w.encode() for w in words])
    got = language.forward(vocabulary, table, length, chances)[0]
    assert np.allclose(got, np.log([brute(w) for w in words]))


def test_expected_counts_are_the_slope_of_the_likelihood():
    vocabulary = language.trie()
    chances = some_chances(vocabulary.size, 1)
    table, length = language._table(["▁there".encode(), "▁an".encode()])
    weight = np.array([[2.0], [3.0]])
    counts = language.expected(vocabulary, table, length, chances, weight)
    for piece in np.argsort(-counts[:, 0])[:4]:
        near = chances.copy()
        near[piece] *= 1 + 1e-6
        rise = language.forward(vocabulary, table, length, near)[0] - language.forward(
            vocabulary, table, length, chances
        )[0]
        assert np.isclose((weight * rise).sum() / 1e-6, counts[piece, 0], rtol=1e-3)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = language.op10_language_id(spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in tested) >= 0.97 * len(tested)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learn_from(docs, rows=20)
    assert language.sample(docs, rows=20).groupBy("lang").count().filter("count > 20").isEmpty()
    text = docs.filter("lang = 'de'").first().text
    rows = [(1, None, 0.1), (2, "", 0.1), (3, "12 34 !!", 0.1), (4, "é" * 5000, 0.1), (None, text * 40, 0.1), (5, "中文", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df.drop("Score"), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == "de" and got[4][0] != "und" and got[5][0] != "und"
    nothing = language.identify(df.drop("Score"), None).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(df.drop("Score").limit(0), model).count() == 0
    assert language.learn([], []) is None


def test_kept_words_do_not_change_scores(monkeypatch):
    _, _, chances = model = language.learn(["the end of it", "das Ende von dem"], ["en", "de"])
    words = next(slices(pa.array(["the end das " * 5, "x y z the", ""])))[1]
    first = language._Scorer(chances, None)
    a, b = first.totals(words), first.totals(words)
    monkeypatch.setattr(language, "KEPT_WORDS", 2)
    c = language._Scorer(chances, None).totals(words)
    assert np.allclose(a, b) and np.allclose(a, c) and model[0] == ["de", "en"]


def plain_logs(word, known, chances):
    """Log probability of a word of any length, by exact sums over where its last piece begins."""
    sums = [[Fraction(1)] * chances.shape[1]]
    for end in range(1, len(word) + 1):
        here = [x * Fraction(language._UNKNOWN) for x in sums[end - 1]]
        for start in range(max(0, end - 20), end):
            piece = known.get(word[start:end])
            if piece is not None:
                here = [h + x * Fraction(c) for h, x, c in zip(here, sums[start], chances[piece])]
        sums.append(here)
    return [math.log(x.numerator) - math.log(x.denominator) for x in sums[-1]]


def test_words_of_any_length_are_scored_whole():
    known, vocabulary = dict(pieces()), language.trie()
    assert max(map(len, known)) <= 20
    chances = some_chances(vocabulary.size)
    words = ["▁donaudampfschifffahrtsgesellschaft", "▁" + "überbevölkerung" * 4, "▁the", "▁" + "中a" * 40, "▁" + "x" * 33]
    words = words + ["▁" + "a" * n for n in (14, 15, 16, 28, 29, 30)]
    table, length = language._table([w.encode() for w in words])
    got = language.forward(vocabulary, table, length, chances)[0]
    assert np.allclose(got, [plain_logs(w, known, chances) for w in words])
    weight = np.ones((len(words), 2))
    counts = language.expected(vocabulary, table, length, chances, weight)
    for piece in np.argsort(-counts[:, 0])[:6]:
        near = chances.copy()
        near[piece] *= 1 + 1e-6
        rise = language.forward(vocabulary, table, length, near)[0] - got
        assert np.allclose(rise.sum(axis=0) / 1e-6, counts[piece], rtol=1e-3)


def test_languages_are_worked_on_a_few_at_a_time(monkeypatch):
    texts, langs = ["the end of it " * 3, "das Ende von dem " + "lang" * 20, "le fin"], ["en", "de", "fr"]
    whole = language.learn(texts, langs)
    monkeypatch.setattr(language, "_CELLS", 64)
    parts = language.learn(texts, langs)
    assert np.allclose(whole[2], parts[2])
    words = next(slices(pa.array(texts)))[1]
    assert np.allclose(language._Scorer(whole[2], None).totals(words), language._Scorer(parts[2], None).totals(words))


def test_a_very_long_word_is_quick():
    _, _, chances = language.learn(["the end of it", "das Ende"], ["en", "de"])
    words = next(slices(pa.array(["abcdefgh" * 4000])))[1]
    start = time.process_time()
    assert np.isfinite(language._Scorer(chances, None).totals(words)).all()
    assert time.process_time() - start < 20

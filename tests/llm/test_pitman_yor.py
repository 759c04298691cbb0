import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from basketry.llm import pitman_yor
from basketry.llm.words import NO_BLANKS, slices
from tests.llm.plain import lower, remainder

FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def plain_runs(text, depth=5):
    row = b"\n" * depth + " ".join(tokens(text)[:-1]).encode() + b"\n"
    return [int.from_bytes(row[i : i + depth + 1], "big") for i in range(len(row) - depth)]


def test_byte_runs():
    texts = ["The end  of\tit", "", None, "é", "  a\n", "x" * 50]
    words = next(slices(pa.array(texts), NO_BLANKS))[1]
    values, begin = pitman_yor.runs(words)
    got = [values[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    assert got == [plain_runs(t) for t in texts]


def small_model(depth=2, **options):
    text = ("the cat sat on the mat and the dog ate the rat " * 30).encode()
    row = b"\n" * depth + text
    count = Counter(int.from_bytes(row[i : i + depth + 1], "big") for i in range(len(text)))
    per_context = Counter()
    for key, n in count.items():
        per_context[key >> 8] += n
    deep = {k: n for k, n in count.items() if per_context[k >> 8] >= 40}
    rest = Counter()
    for key, n in count.items():
        if key not in deep:
            rest[key & 0xFFFF] += n
    levels = [Counter(), rest, deep]
    arrays = [
        (np.array(sorted(c), dtype=np.uint64), np.array([c[k] for k in sorted(c)], dtype=np.int64)) for c in levels
    ]
    return pitman_yor.sample_model(arrays, **options), count


def test_chances_add_up_to_one():
    model, count = small_model()
    for context in [0x7468, 0x6520, 0x0A0A, 0x7A7A, 0x6174]:
        runs = np.array([(context << 8) | b for b in range(256)], dtype=np.uint64)
        chance = 10 ** model.log_chance(runs)
        assert math.isclose(chance.sum(), 1, rel_tol=1e-6) and (chance > 0).all()


def test_seats_follow_the_restaurant_process():
    """The mean number of tables of one dish with fixed weights equals that of guests seated one by one."""
    rng = np.random.default_rng(0)
    guests, weight, discount = 60, 1.5, 0.4
    chance = np.zeros(guests + 1)
    chance[1] = 1
    for n in range(1, guests):
        t = np.arange(guests + 1)
        new = weight / (weight + np.maximum(n - discount * t, 1e-9))
        chance = chance * (1 - new) + np.concatenate([[0], (chance * new)[:-1]])
    want = (chance * np.arange(guests + 1)).sum()
    many = np.full(20_000, guests)
    got = pitman_yor._seat(rng, many, lambda at, t: np.full(len(at), weight), discount)
    assert abs(got.mean() - want) < 0.08 and got.min() >= 1


def test_counts_and_base_scores_equal_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = pitman_yor.op3_pitman_yor(spark, FOLDER)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert rows.columns == columns
    rows = rows.collect()
    known = Counter()
    for doc, text in docs.items():
        if remainder(doc, 5) != 1:
            known.update(tokens(text))
    total, kinds = sum(known.values()), len(known)
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r.doc_id])
        base = sum(math.log10((known[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in own)
        assert (r.n_tokens, r.n_known) == (len(own), sum(known[t] > 0 for t in own))
        assert r.train_tokens == total and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (remainder(r.doc_id, 5) == 1)


def test_held_out_texts_are_more_likely_than_by_word_frequency(spark):
    rows = pitman_yor.op3_pitman_yor(spark, "/root/testdata/sf0.1").filter("held_out")
    facts = pitman_yor.perplexity(rows).first()
    assert facts.perplexity < 0.9 * facts.base_perplexity


def test_corpus_counts_are_whole(spark):
    texts = ["a b a", "A  b", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = pitman_yor.corpus_counts(df).collect()
    runs = Counter(run for t in texts for run in plain_runs(t))
    assert {r.key: r.n for r in rows if r.kind == 0} == runs
    assert sorted(r.n for r in rows if r.kind == 1) == [2, 3, 4]
    grams = spark.createDataFrame([(k, n) for k, n in runs.items()], "key long, n long")
    for share in (4e-6, 0.3, 1.1):
        seated = pitman_yor.customers(grams, share=share)
        assert seated.agg(F.sum("n")).first()[0] == sum(runs.values())
        assert share < 1 or seated.filter("depth > 0").count() == 0


def test_odd_rows_and_no_training(spark):
    docs = spark.createDataFrame(
        [(1, None, 2), (2, "", 2), (None, "word " * 3000, 2), (3, "b a", 2), (3, "b a", 2)],
        "doc_id long, text string, n_tokens int",
    )
    model, counts = pitman_yor.learn(docs.limit(0))
    rows = pitman_yor.log_scores(docs, model, counts).collect()
    assert len(rows) == 5 and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert all(math.isclose(r.score, -math.log10(256)) for r in rows if r.doc_id in (1, 2))
    model, counts = pitman_yor.learn(docs)
    scores = pitman_yor.log_scores(docs, model, counts)
    assert all(r.n_known == r.n_tokens for r in scores.collect())
    assert pitman_yor.log_scores(docs.limit(0), model, counts).count() == 0
    facts = pitman_yor.perplexity(scores).first()
    assert facts.n_tokens == 3001 + 1 + 1 + 3 + 3 and 1 <= facts.perplexity
    assert scores.filter(F.col("doc_id") == 3).select("score").distinct().count() == 1


def test_contexts_below_the_core_have_restaurants(spark):
    """Runs, counts and customers are whole, and chances of a tree's contexts add up to one."""
    text = "the cat sat on the mat and the dog ate the rat " * 20 + "zebra quagga gnu zebra quagga"
    count = Counter(plain_runs(text))
    grams = spark.createDataFrame([(k, n) for k, n in count.items()], "key long, n long")
    seated = pitman_yor.customers(grams, share=0.05).toPandas()
    columns = [seated[c].to_numpy() for c in ("depth", "dish", "n")]
    core = pitman_yor.sample_model(pitman_yor.by_depth(*columns))
    keys, n = (np.array(x, dtype=t) for x, t in ((list(count), np.uint64), (list(count.values()), np.int64)))
    own = core.depth(keys) < 5
    assert own.any()
    levels = pitman_yor.trees(keys[own], n[own], core)
    assert levels[5].direct.sum() == n[own].sum()
    model = pitman_yor.sample_trees(levels, core, 1)
    for context in {int(k) >> 8 for k in keys[own][:40]} | {0x7A7A7A7A7A, int.from_bytes(b"xagga", "big")}:
        runs = np.array([(context << 8) | b for b in range(256)], dtype=np.uint64)
        chance = 10 ** model.log_chance(runs)
        assert math.isclose(chance.sum(), 1, rel_tol=1e-6) and (chance > 0).all()
    assert n[own] @ model.log_chance(keys[own]) > n[own] @ core.log_chance(keys[own])
    depth, dish, sent = pitman_yor.sent_to_core(levels)
    assert core.depth(dish[depth < 5]).max() <= 4 and 0 < sent.sum() <= n[own].sum() and sent.min() >= 1


def test_a_rare_passage_is_known(spark):
    """Its contexts are under SHARE of the training bytes; the core alone gives it far less."""
    rng = np.random.default_rng(1)
    letters = np.array([*"abcdefghijklmnopqrstuvwxyz"])
    frequent = ["".join(rng.choice(letters, 6)) for _ in range(40)]
    passage = " ".join("".join(rng.choice(letters, 8)) for _ in range(60))
    texts = [" ".join(rng.choice(frequent, 3000)) for _ in range(60)] + [passage] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    core, counts = pitman_yor.learn(docs)
    asked = spark.createDataFrame([(1, passage), (2, "".join(rng.choice(letters, len(passage))))], docs.schema)
    known, other = (r.score for r in pitman_yor.log_scores(asked, core, counts).orderBy("doc_id").collect())
    words = next(slices(pa.array([passage]), NO_BLANKS))[1]
    alone = core.log_chance(pitman_yor.runs(words)[0]).sum()
    assert known > 0.5 * alone and known > -0.6 * len(passage) and other < -len(passage)

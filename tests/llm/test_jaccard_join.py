import itertools
import random

import numpy as np

from basketry.llm import gram_sets, jaccard_join
from basketry.llm.components import components
from tests.llm.plain import grams, groups, jaccard


def expected(docs, threshold=0.8):
    sets = {d: grams(t) or ({t} if t else set()) for d, t in docs}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= threshold]
    root = groups(sets, linked)
    return {d: (root[d], sum(d in pair for pair in linked)) for d in sets}


def some_docs():
    """Near copies of a few texts, far more than a block holds, beside odd rows."""
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(3)]
    docs = []
    for i in range(260):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(text))
    docs += ["two words", "Two, words!", "", "", "...", "...", "?!", "w " * 4000, "w " * 5000]
    return list(enumerate(docs))


def check(spark, docs, **options):
    df = spark.createDataFrame([(*r, "c", 2) for r in docs], "doc_id long, text string, class string, copies int")
    rows = jaccard_join.links_per_document(df, **options).collect()
    assert {r.doc_id: (r.group_id, r.n_links) for r in rows} == expected(docs)


def test_links_equal_brute_force(spark, monkeypatch):
    # Small blocks, so that one bucket becomes many tasks.
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 40)
    check(spark, some_docs(), recall=1 - 1e-9)


def test_links_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = jaccard_join.op8_ngram_jaccard_join(spark, folder).collect()
    assert {r.doc_id: (r.group_id, r.n_links) for r in rows} == expected(docs)


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven"
    rows = [(3, text, "b"), (1, text.upper(), "a"), (1, text.upper(), "a"), (2, None, None), (2, None, None)]
    rows += [(4, "", "e"), (5, "", "e"), (None, "quite another text of many words", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __llm_extra string")
    kept = jaccard_join.one_per_group(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text)
    assert got == [("1", text.upper()), ("None", "quite another text of many words")]
    assert {r.doc_id for r in kept.collect() if not r.text} == {2, 4, 5}
    assert jaccard_join.one_per_group(df.limit(0)).count() == 0


def test_shared_counts_equal_plain_sets():
    rng = np.random.default_rng(1)
    sets = [set(rng.choice(60, rng.integers(1, 50), replace=False).tolist()) for _ in range(70)]
    sets += [set(range(60)) - {i} for i in range(70)]
    entries = [(g, i) for i, s in enumerate(sets) for g in sorted(s)]
    got = gram_sets.shared_counts(
        np.array([g for g, _ in entries], dtype=np.uint64), np.array([i for _, i in entries]), len(sets)
    )
    want = [[len(a & b) for b in sets] for a in sets]
    assert (got == np.array(want)).all()


def test_number_of_bands():
    assert jaccard_join.bands_for(0.8, 5, 0.9995) == 20


def test_components_of_chains(spark):
    links = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i % 20 != 19] + [("900", "900")]
    df = spark.createDataFrame(links, "a string, b string")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == {f"{i:03d}": f"{i // 20 * 20:03d}" for i in range(60)}

import itertools
import random
import re

import numpy as np

from basketry.llm import near_dedup
from tests.llm.plain import groups, lower

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    found = WORD.findall(lower(text))
    return {tuple(found[i : i + 2]) for i in range(max(1, len(found) - 1))} if found else set()


def expected(docs):
    """(n_shingles, component_id, kept) of each document, from all pairs."""
    sets = [shingles(t) for _, t in docs]
    linked = []
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            linked.append((i, j))
    root = groups(range(len(docs)), linked)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root[i]] = min(doc_id, least.get(root[i], doc_id))
    out = []
    for i, (doc_id, _) in enumerate(docs):
        top = least.get(root[i])
        out.append((doc_id, len(sets[i]), top, doc_id is None or doc_id == top))
    return sorted(out, key=repr)


def changed(rng, words, many):
    words = list(words)
    for _ in range(many):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def some_docs(seed, families=6, copies=25):
    """Families of near copies whose members are linked with some of the others only."""
    rng = random.Random(seed)
    out = [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "a b c d e f"), (906, "a b c d e")]
    out += [(None, "x y z"), (907, "X y z"), (907, "X y z"), (908, "\x1c q\x1cr")]
    for family in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 200]))]
        for i in range(copies):
            base = changed(rng, base, 1) if rng.random() < 0.5 else base
            out.append((family * 100 + i, " ".join(changed(rng, base, rng.choice([0, 1, 1, 2, 3])))))
    rng.shuffle(out)
    return out


def got(spark, docs, **options):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = near_dedup.near_duplicates(table, **options)
    return sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_bins_agree_with_the_similarity():
    rng = np.random.default_rng(2)
    order = near_dedup.probes(150)
    for size, common in ((5, 4), (20, 16), (400, 320)):
        same = []
        for _ in range(40):
            all_ = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            a, b = np.sort(all_[:common]), np.sort(all_)
            values = []
            for x in (a, b):
                least, filled = near_dedup.bins_of(x, np.zeros(len(x), np.int64), 1, 150)
                assert filled.sum() <= len(x)
                values.append(near_dedup.densified(least, filled, order)[0])
            same.append((values[0] == values[1]).mean())
        assert abs(np.mean(same) - common / size) < 0.04


def test_bands():
    bands = near_dedup.bands_for(80, 6, 0.9999)
    assert 1 - (1 - 0.8**6) ** bands >= 0.9999 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_groups_equal_brute_force(spark):
    docs = some_docs(1)
    assert got(spark, docs) == expected(docs)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TASK_MEMBERS", 4)
    monkeypatch.setattr(near_dedup, "TASK_WORDS", 600)
    docs = some_docs(2, families=3, copies=40)
    assert got(spark, docs) == expected(docs)


def test_members_that_only_meet_beside_the_centre(spark):
    # With one row a band, buckets are wide and hold several groups around a centre that fits neither.
    docs = some_docs(3, families=4, copies=12)
    assert got(spark, docs, rows=1) == expected(docs)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = near_dedup.op12_near_dedup(spark, folder).collect()
    assert sorted(map(tuple, rows), key=repr) == expected(docs)


def test_empty_and_extra_columns(spark, rows):
    table = rows([(1, "a b c", 2, "x")], "doc_id long, text string, class int, Bands string")
    assert near_dedup.near_duplicates(table.limit(0)).count() == 0
    assert near_dedup.near_duplicates(table).count() == 1

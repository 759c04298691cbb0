import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from basketry.llm import periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least=24, turns=3):
    """Every maximal stretch by its smallest period, straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, turns * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    inside = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in inside]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def ids_of(texts):
    number = {}
    split = [t.split() for t in texts]
    bound = np.cumsum([0] + [len(w) for w in split])
    return np.array([number.setdefault(w, len(number)) for x in split for w in x], dtype=np.int64), bound, split


def check(texts):
    ids, bound, split = ids_of(texts)
    text, start, length, period = periodic_runs.find_runs(ids, bound)
    got = [[] for _ in texts]
    for t, s, n, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[t].append((s, n, q))
    for words, runs in zip(split, got):
        assert runs == brute(words)
    return got


def test_transform_is_a_convolution():
    rng = np.random.default_rng(1)
    for size in (2, 8, 64):
        x = rng.integers(0, periodic_runs.PRIME, (3, size), dtype=np.uint64)
        back = periodic_runs.transform(periodic_runs.transform(x), inverse=True)
        assert (back == (x * np.uint64(size)) % np.uint64(periodic_runs.PRIME)).all()
        one = np.zeros((1, size), dtype=np.uint64)
        one[0, 1] = 1
        # The transform of the second unit vector are the powers of the root, each once.
        assert len(set(periodic_runs.transform(one)[0].tolist())) == size


@pytest.mark.parametrize("seed", range(12))
def test_random_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        letters = "abcdefghij"[: rng.choice([1, 2, 2, 3, 10])]
        parts = []
        for _ in range(rng.randint(1, 6)):
            pattern = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 33, 70]))]
            many = rng.choice([1, 2, 3, 4, 9])
            part = pattern * many
            parts += part[: max(1, len(part) - rng.randint(0, len(pattern)))]
        texts.append(" ".join(parts))
    texts += ["", " ", "a", "a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a"]
    assert any(check(texts))


def test_one_letter_and_long_texts():
    rng = random.Random(3)
    pattern = [str(rng.randint(0, 9)) for _ in range(700)]
    [runs] = check([" ".join(["x"] * 50 + pattern * 3 + ["y"] + ["z"] * 4000)])
    assert (51 + 2100, 4000, 1) in runs and (50, 2100, 700) in runs


def test_other_limits_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(5, np.int64), np.array([0, 5]), turns=2)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    data = [(None, "a " * 30), (7, None), (8, ""), (9, "\x1c  " * 30), (9, "\x1c  " * 30)]
    for i in range(200):
        letters = [chr(0xE0 + x) for x in range(rng.choice([2, 5, 400]))]
        data.append((i + 10, rng.choice([" ", "\n", "\t "]).join(rng.choices(letters, k=rng.randint(0, 300)))))
    folder = str(tmp_path / "t")
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = periodic_runs.op13_periodic_runs(spark, folder).collect()
    want = []
    for doc_id, text in data:
        words = planted(doc_id, WORD.findall(text or ""))
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        sha = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        rest = hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *top, sha, rest))
    key = repr
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = planted(doc_id, WORD.findall(text or ""))
        if len(words) > 3000:
            continue
        runs = brute(words)
        assert got[doc_id].n_runs == len(runs)
        rest = hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
        assert got[doc_id].collapsed_sha256 == rest


def test_other_columns_and_empty_tables(spark, rows):
    given = rows([(1, "a " * 30, 5)], "id long, text string, Runs int")
    [row] = periodic_runs.find(given).collect()
    assert (row.id, [tuple(r) for r in row.runs], row.collapsed) == (1, [(0, 30, 1)], "a")
    assert periodic_runs.find(given.limit(0)).count() == 0

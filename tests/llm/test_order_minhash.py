import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from basketry.llm import order_minhash


def _hash(values):
    code = 42
    for v in values:
        if isinstance(v, str):
            code = xxhash.xxh64_intdigest(v.encode(), code)
        else:
            code = xxhash.xxh64_intdigest(struct.pack(v[0], v[1]), code)
    return code - (1 << 64) if code >> 63 else code


def plain_print(text):
    """The fingerprint by its definition, one element after the other."""
    words = [_hash([w]) for w in re.split("[ \t\n\r]+", text) if w]
    grams = [_hash([("<q", w) for w in words[i : i + 3]]) for i in range(max(len(words) - 3, 0) + 1)]
    places, times, cells, ranks = (1 << 28) - 1, {}, {}, []
    for i, gram in enumerate(grams):
        kmer = gram >> 28
        number = times[kmer] = times.get(kmer, -1) + 1
        rank = (_hash([("<q", kmer), ("<i", number)]) & ~places) | i
        ranks.append(rank)
        cell = (rank >> 57) & 127
        cells[cell] = min(rank, cells.get(cell, rank))
    order = [*range(64, 128), *range(64)]
    out = []
    for j in range(64):
        both = [cells[c] for c in order[2 * j : 2 * j + 2] if c in cells]
        if len(both) < 2:
            both = sorted((_hash([("<q", r >> 28), ("<i", j)]) & ~places) | (r & places) for r in ranks)[:2]
        at = sorted(r & places for r in both)
        out.append("%08x" % (_hash([("<q", grams[i]) for i in at]) & 0xFFFFFFFF) if at else "-" * 8)
    return "".join(out)


def alike(a, b):
    cells = [(a[i : i + 8], b[i : i + 8]) for i in range(0, 512, 8)]
    there = [x for x in cells if x != ("-" * 8, "-" * 8)]
    return sum(x == y for x, y in there) / len(there)


def check(rows, docs):
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    texts = [d[1] or "" for d in ordered]
    want = []
    for i, (doc, text) in enumerate(zip((d[0] for d in ordered), texts)):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain_print(text), plain_print(edited), plain_print(after)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want.append((str(doc), len(text), digest, a, b, round(alike(a, b), 9), round(alike(a, c), 9)))
    got = [(str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in rows]
    assert sorted(got) == sorted(want)


def test_small_tables_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET_ROWS", 30)
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = order_minhash.op2_order_minhash(spark, folder)
    assert out.columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    ]
    check(out.collect(), docs)


def test_odd_rows(spark):
    docs = [(5, None), (5, "b a"), (5, "b a"), (9, ""), (None, "é ü x y z"), (2, "w " * 4000), (7, "one"), (7, "two three four")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_chars int")
    check(order_minhash.edits(df).collect(), docs)
    assert order_minhash.edits(df.limit(0)).count() == 0
    alone = order_minhash.edits(df.filter("doc_id = 9")).first()
    assert alone.near_next == alone.near_edited == 1.0


def test_order_and_edits_lower_the_likeness(spark):
    words = [f"w{i}" for i in range(600)]
    moved = words[300:] + words[:300]
    swapped = [w for i in range(0, 600, 2) for w in (words[i + 1], words[i])]
    few = [("x" if i in (100, 400) else w) for i, w in enumerate(words)]
    texts = [words, few, moved, swapped]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    prints = [
        r[0] for r in df.sort("i").select(order_minhash.written(order_minhash.fingerprint(F.col("text")))).collect()
    ]
    near = [alike(prints[0], p) for p in prints]
    assert near[0] == 1 and near[1] > 0.9 and near[3] == 0
    # The same k-mers but for the seam: only their order tells the texts apart.
    assert 0.2 < near[2] < 0.8


def test_halves_that_change_places_in_short_texts(spark):
    sizes = (30, 60, 100, 150)
    texts = []
    for n in sizes:
        words = [f"v{n}x{i}" for i in range(n)]
        texts += [words, words[n // 2 :] + words[: n // 2]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    prints = [
        r[0] for r in df.sort("i").select(order_minhash.written(order_minhash.fingerprint(F.col("text")))).collect()
    ]
    for i in range(len(sizes)):
        # Half of the tuples span both halves and must break.
        assert 0.25 < alike(prints[2 * i], prints[2 * i + 1]) < 0.65

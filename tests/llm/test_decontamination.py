import hashlib

from pyspark.sql import functions as F

from basketry.llm import decontamination
from tests.llm.plain import words

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [
    (1, LONG),
    (2, "Tiny item"),
    (2, "one more text of item two that is well above ten words long"),
    (3, None),
    (4, "!!!"),
    (None, "nameless item of six words here"),
]
DOCS = [
    (10, "x " + LONG.upper().replace(" ", ", ") + " y"),
    (11, " ".join(LONG.split()[:9])),
    (12, " ".join(LONG.split()[1:11]) + " then TINY-ITEM."),
    (13, "a tiny. Item nameless item of six words here tiny item"),
    (14, None),
    (15, ""),
    (16, "é ü " * 3000 + LONG),
    (10, "x " + LONG.upper().replace(" ", ", ") + " y"),
    (None, LONG),
]


def expected(docs, items):
    known = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for key, names in known.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    found |= names
        yield doc, len(w), len(hit), sorted(found)


def tables(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, words string, start int")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_report_equals_brute_force(spark):
    rows = decontamination.report(*tables(spark)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in rows)
    want = sorted((str(a), b, c, d) for a, b, c, d in expected(DOCS, ITEMS))
    assert got == want and all(r.n_items == len(r.items) for r in rows)


def test_clean_keeps_columns_and_rows(spark):
    docs, items = tables(spark)
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [11, 14, 15]


def test_clean_documents_stay_where_they_are(spark):
    """Only documents that may be left out are shuffled for the join, however large the list of them."""
    docs, items = tables(spark, [(i, f"text {i} of its own") for i in range(60)] + DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = decontamination.clean(docs.repartition(30), items).select(
            "doc_id", F.spark_partition_id().alias("part")
        ).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc_id for r in kept) == sorted([*range(10), 11, 14, 15, *range(10, 60)])
    assert len({r.part for r in kept}) > 8


def test_empty_tables(spark):
    docs, items = tables(spark)
    rows = decontamination.report(docs, items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.n_hit for r in rows)
    assert decontamination.report(docs.limit(0), items).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == len(DOCS)


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    want = {
        (d, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0)
        for d, n, h, f in expected(
            [(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items]
        )
    }
    got = decontamination.op6_winnowing_decontamination(spark, folder)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got.columns == columns and {tuple(r) for r in got.collect()} == want

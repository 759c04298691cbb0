import itertools

import corpus_pipeline
import pyarrow as pa
from basketry.llm import pii, tables, toxicity
from basketry.storage import save
from pyspark.sql import functions as F
from tests.llm.plain import grams, groups, jaccard, words
from tests.llm.test_packing import check

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = tables.read(spark, FOLDER, "documents")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, FOLDER), name)
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    # Toxicity: what is not predicted to be toxic, unchanged.
    all_ = tables.read(spark, FOLDER, "documents")
    model = toxicity.learn_from(all_, tables.read(spark, FOLDER, "labels"))
    fair = {r.doc_id for r in toxicity.tag(all_, model).filter("score < 0.7").collect()}
    assert {r.doc_id for r in out["toxicity"]} == fair
    # Near duplicates: the least id of each group of its input.
    sets = {r.doc_id: grams(r.text) for r in out["toxicity"]}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8]
    left = set(groups(sets, linked).values())
    assert {r.doc_id for r in out["near_duplicates"]} == left
    # Decontamination: no ten words of an item are left, and nothing else went.
    known = set()
    for item in tables.read(spark, FOLDER, "benchmark").collect():
        w = words(item.text)
        known |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))}

    def shares(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in known for n in {len(k) for k in known} for i in range(len(w) - n + 1))

    left = {r.doc_id for r in out["near_duplicates"] if not shares(r.text)}
    assert {r.doc_id for r in out["decontamination"]} == left
    # Personal data: what was found is gone, the rest is as it was.
    before = spark.createDataFrame(out["decontamination"])
    finds = pii.findings(before, pii.TEST_KEY).groupBy("doc_id").agg(F.collect_list("value").alias("v")).collect()
    after = {r.doc_id: r for r in out["pii"]}
    assert set(after) == left and len(finds) > 0
    for r in finds:
        assert not any(v in after[r.doc_id].text for v in r.v)
    changed = {r.doc_id for r in finds}
    assert all(after[r.doc_id].text == r.text for r in out["decontamination"] if r.doc_id not in changed)
    assert all(r.n_chars == len(r.text) for r in out["pii"])
    # Packing: the texts' ids, cut and placed.
    check(out["packing"], [(r.doc_id, r.text) for r in out["pii"]], 4096)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(rows.columns)
    assert rows.count() > 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null and empty texts, null and repeated ids, ties, repeated rows and clashing columns."""
    folder = str(tmp_path / "t")
    long = " ".join(f"word{i}" for i in range(40))
    data = [
        (1, None), (2, ""), (2, ""), (3, long), (3, long), (4, long), (None, "alone here"), (5, "a"), (5, "b"),
        (6, "the test has these ten words in a row you see"), (7, "mail ann.lee@x.org " + long[:150]),
    ]
    docs = spark.createDataFrame([(*d, "x", 1.5, 7) for d in data], "doc_id long, text string, Score string, class double, times int")
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [("i", "the test has these ten words in a row you see")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(3, 0), (5, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = save(stage(spark, kept, folder), name)
        assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    mail = [t for i, t in rows if i == 7]
    assert len(mail) == 1 and "ann.lee" not in mail[0] and mail[0].startswith("mail ")
    rest = [(1, None), (2, ""), (3, long), (5, "a"), (5, "b"), (None, "alone here")]
    assert [r for r in rows if r[0] != 7] == sorted(rest, key=repr)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert packed.select("doc_id", "piece").count() == 7
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0
        empty = docs.limit(0)


def test_stages_bound_the_batches_of_texts(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    try:
        for allowed, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("300", 300)):
            spark.conf.set(setting, allowed)
            corpus_pipeline.STAGES[3][1](spark, docs, FOLDER)
            assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == most
    finally:
        spark.conf.set(setting, before)

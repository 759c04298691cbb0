from basketry.llm import token_counts
from tests.llm.test_packing import ODD, plain_ids


def test_limits_equal_direct_sums(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CELL", 4)
    df = spark.createDataFrame([(t, 1) for t in ODD * 2], "text string, length int")
    counts = token_counts.histogram(df)
    sizes = sorted(len(plain_ids(t)) for t in ODD * 2)
    rows = token_counts.limits(counts).collect()
    assert sorted(r.length for r in rows) == sorted(set(sizes))
    for r in rows:
        assert r.n_docs == sizes.count(r.length)
        assert r.docs_within == sum(s <= r.length for s in sizes)
        assert r.docs_over == sum(s > r.length for s in sizes)
        assert r.tokens_within == sum(s for s in sizes if s <= r.length)
        assert r.truncated_tokens == sum(min(s, r.length) for s in sizes)
        assert r.lost_tokens == sum(sizes) - r.truncated_tokens
        assert r.tokens_over == sum(sizes) - r.tokens_within
    total = token_counts.totals(counts).first()
    assert tuple(total) == (len(sizes), sum(sizes), sizes[0], sizes[-1])
    got = {r.share: r.length for r in token_counts.quantiles(counts, [0.01, 0.5, 1.0]).collect()}
    assert got == {0.01: sizes[0], 0.5: sizes[len(sizes) // 2 - 1], 1.0: sizes[-1]}
    for r in token_counts.truncated_at(counts, [0, 5, 10**6]).collect():
        assert r.n_tokens == sum(min(s, r.limit) for s in sizes)
        assert r.n_cut == sum(s > r.limit for s in sizes)


def test_query_counts_every_document(spark):
    folder = "/root/testdata/sf0.001"
    sizes = [len(plain_ids(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = token_counts.op4_length_histogram(spark, folder).collect()
    assert {r.length: r.n_docs for r in rows} == {s: sizes.count(s) for s in set(sizes)}


def test_empty_table(spark):
    counts = token_counts.histogram(spark.createDataFrame([], "text string"))
    assert counts.count() == 0 and token_counts.limits(counts).count() == 0
    assert tuple(token_counts.totals(counts).first()) == (0, 0, None, None)
    assert token_counts.quantiles(counts, [0.5]).count() == 0

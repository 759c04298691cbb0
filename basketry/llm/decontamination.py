"""Benchmark decontamination by winnowing.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words is one window). The
fingerprint of a window is the least hash among its ``gram``-word grams: winnowing keeps just these, and
two equal windows always keep the same one, so every shared span of ``size`` words or more is found.

Documents are read once. Their fingerprints are checked against a Bloom filter of the benchmark's
fingerprints, of a fixed size whatever the benchmark (a larger benchmark lets more through and costs time,
not rows). What passes is joined with the benchmark on fingerprint and then on the words themselves, so
no hash decides. Short items have windows of their own length, looked for as such.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item has no window; a null
item id is listed as an empty text; repeated items count once by id; repeated documents each get their row;
an empty table of items leaves every document clean; other columns of the tables are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm import tables
from basketry.llm.key_filter import key_filter, marking
from basketry.llm.words import slices
from basketry.storage import save

SIZE, GRAM = 10, 5
_BITS = 1 << 23

_WINDOWS = "item_id string, size int, fingerprint long, words string"
_FOUND = (
    "doc_id {id}, text_key long, n_words long, "
    "found array<struct<start: int, size: int, fingerprint: long, words: string>>"
)


def _fingerprints(words, size: int, gram: int):
    """Per word: the fingerprint of the window of ``size`` words from it on, and whether it is one."""
    gram = min(gram, size)
    hashes, _ = words.grams(gram)
    count = len(words.code) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    least = hashes[:count].copy()
    for i in range(1, size - gram + 1):
        np.minimum(least, hashes[i : i + count], out=least)
    return least, words.row[:count] == words.row[size - 1 :]


def windows(items: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The windows of (item_id, text), one row per item and different window."""

    def of_batches(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, words in slices(batch.column(1)):
                out = []
                for i in range(len(words.bound) - 1):
                    low, high = int(words.bound[i]), int(words.bound[i + 1])
                    width = min(size, high - low)
                    if width:
                        name = ids[first + i].as_py()
                        out += [(name, width, at) for at in range(low, high - width + 1)]
                prints = {n: _fingerprints(words, n, gram)[0] for n in {x[1] for x in out}}
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_id": pa.array([x[0] for x in out], pa.string()),
                        "size": pa.array([x[1] for x in out], pa.int32()),
                        "fingerprint": pa.array(
                            [int(prints[n][at].astype(np.int64)) for _, n, at in out], pa.int64()
                        ),
                        "words": pa.array([words.text(at, n) for _, n, at in out], pa.string()),
                    }
                )

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    return named.mapInArrow(of_batches, _WINDOWS).distinct()


def _bloom(prints: DataFrame) -> dict[int, np.ndarray]:
    """By window length, ``_BITS`` bits; at most one row of 64 bits for each place goes to the driver."""
    places = F.explode(
        F.array(
            F.pmod("fingerprint", F.lit(_BITS)),
            F.pmod(F.shiftright("fingerprint", 32), F.lit(_BITS)),
        )
    )
    bits = (
        prints.select("size", places.alias("place"))
        .groupBy("size", F.shiftright("place", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
    )
    out = {}
    for row in bits.collect():
        cells = out.setdefault(row["size"], np.zeros(_BITS // 64, dtype=np.int64))
        cells[row["cell"]] = row["bits"]
    return {n: cells.view(np.uint64) for n, cells in out.items()}


def _in_bloom(cells: np.ndarray, prints: np.ndarray) -> np.ndarray:
    signed = prints.astype(np.int64)
    out = np.ones(len(prints), dtype=bool)
    for place in (signed % _BITS, (signed >> 32) % _BITS):
        out &= (cells[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def _candidates(docs: DataFrame, bloom: dict, size: int, gram: int) -> DataFrame:
    """Per document its number of words and the windows whose fingerprint passes the filter."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of_batches(batches):
        for batch in batches:
            for first, words in slices(batch.column(2)):
                rows = len(words.bound) - 1
                found = [[] for _ in range(rows)]
                for n, cells in bloom.items():
                    prints, whole = _fingerprints(words, n, gram)
                    for at in np.flatnonzero(whole & _in_bloom(cells, prints)):
                        row = int(words.row[at])
                        found[row].append(
                            {
                                "start": int(at - words.bound[row]),
                                "size": n,
                                "fingerprint": int(prints[at].astype(np.int64)),
                                "words": words.text(int(at), n),
                            }
                        )
                cell = pa.struct(
                    [
                        ("start", pa.int32()),
                        ("size", pa.int32()),
                        ("fingerprint", pa.int64()),
                        ("words", pa.string()),
                    ]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        batch.column(1).slice(first, rows),
                        pa.array(np.diff(words.bound), pa.int64()),
                        pa.array(found, pa.list_(cell)),
                    ],
                    names=["doc_id", "text_key", "n_words", "found"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(of_batches, _FOUND.format(id=kind))


def overlaps(
    docs: DataFrame, items: DataFrame, size: int = SIZE, gram: int = GRAM
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their number of words, hit spans, pairs of document and item).

    Documents are told apart by ``doc_id`` and ``text_key``; repeated rows are repeated in the first table
    only. A span is ``start`` (word, from 0) and ``size``.
    """
    known = save(windows(items, size, gram), "windows")
    bloom = _bloom(known.select("size", "fingerprint").distinct())
    found = save(_candidates(docs, bloom, size, gram), "found")
    key = ["doc_id", "text_key"]
    spread = found.select(*key, F.inline("found")).distinct()
    same = ["size", "fingerprint", "words"]
    hits = save(spread.join(known.select(*same).distinct(), same), "hits")
    pairs = (
        hits.select(*key, *same).distinct().join(known, same).select(*key, "item_id").distinct()
    )
    return found.select(*key, "n_words"), hits.select(*key, "start", "size"), pairs


def report(docs: DataFrame, items: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row per document: how many of its words are hit, and by which items."""
    counted, hits, pairs = overlaps(docs, items, size, gram)
    key = ["doc_id", "text_key"]
    end = F.col("start") + F.col("size")
    before = Window.partitionBy(*key).orderBy("start", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # A document's spans in order; each adds what lies beyond the furthest end so far.
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    covered = (
        hits.withColumn("new", F.greatest(end - F.greatest(reached, F.col("start")), F.lit(0)))
        .groupBy(*key)
        .agg(F.sum("new").alias("n_hit"))
    )
    # The list of a document's items is the result asked for; it is as long as the benchmark at most.
    listed = pairs.groupBy(*key).agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items")
    )
    none = F.array().cast("array<string>")
    joined = counted
    for other in (covered, listed):
        renamed = other.withColumnsRenamed({c: f"_{c}" for c in key})
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (
            F.col("text_key") == F.col("_text_key")
        )
        joined = joined.join(renamed, same, "left").drop("_doc_id", "_text_key")
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The documents that share no window with any item, with their columns unchanged.

    Only documents that pass a filter of those to be left out are shuffled for the join that decides.
    """
    _, hits, _ = overlaps(docs, items, size, gram)
    bad = hits.select(
        F.col("doc_id").alias("__llm_id"),
        F.col("text_key").alias("__llm_key"),
        F.xxhash64("doc_id", "text_key").alias("__llm_both"),
    )
    bad = save(bad.distinct(), "bad")
    both = F.xxhash64("doc_id", F.xxhash64("text")).alias("__llm_both")
    marked = marking(docs.select("*", both), "__llm_both", key_filter(bad, "__llm_both"), "__llm_maybe")
    same = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (
        F.xxhash64("text") == F.col("__llm_key")
    )
    surely = marked.filter("not __llm_maybe").select(*docs.columns)
    maybe = marked.filter("__llm_maybe").select(*docs.columns)
    return surely.unionByName(maybe.join(bad, same, "left_anti"))


def op6_winnowing_decontamination(spark, folder):
    rows = report(tables.read(spark, folder, "documents"), tables.read(spark, folder, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SPLIT = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_SPLIT} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i : i + least(10, len(w)) - 1] AS words
  FROM items, LATERAL unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
docs AS (
  SELECT doc_id, {_SPLIT} AS w FROM documents),
places AS (
  SELECT doc_id, i, size, w[i : i + size - 1] AS words
  FROM docs, (SELECT DISTINCT size FROM windows), LATERAL unnest(range(1, len(w) - size + 2)) AS u(i)),
hits AS (
  SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (size, words)),
covered AS (
  SELECT doc_id, count(DISTINCT n) AS n_hit
  FROM hits, LATERAL unnest(range(i, i + size)) AS u(n) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""

QUERIES = {"op6_winnowing_decontamination": op6_winnowing_decontamination}
ORACLE = {"op6_winnowing_decontamination": _SQL}

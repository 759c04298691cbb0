"""Similarity join on sets of word n-grams: MinHash bands find candidates, full sets decide.

1. One pass over the texts gives each document the hash of its n-gram set and one hash per band.
   Documents with equal sets are one class; only a class goes on.
2. Classes meet where a band hash is equal. The number of bands is the least that finds a pair at the
   threshold with the wanted probability, given the rows of a band.
3. The classes of one band value are a bucket. Buckets of other bands with the very same members are
   dropped. A bucket of any size is dealt at random into blocks of bounded words and members, and each pair of
   blocks is a task of its own: one hot value is spread over many tasks, and no pair is written out.
4. A task compares the full sets of its classes. A pair counts in the first band it shares only. The task
   returns per class the number of linked classes and documents, and a spanning forest of the links.
5. Sums of the former are the number of links, components of the latter the groups.

The work of a task grows with the entries in which its sets differ, not with the sets: an n-gram that most
classes of a block have is counted through those that lack it.

Edge cases: a text of fewer words than n is one shorter gram; a text without words has no n-grams: it is its own
class, linked only to equal texts, and to nothing if null or empty. Repeated rows are documents of one class.
A null id is kept as a document of its own kind. No limit on links, members or lengths.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry import storage
from basketry.llm import tables
from basketry.llm.components import components
from basketry.llm.gram_sets import gram_sets, least_linked, shared_counts
from basketry.llm.key_filter import key_filter, marking, passing
from basketry.llm.words import mixed, slices
from basketry.storage import hand_over, save

WORDS, THRESHOLD, ROWS, RECALL = 5, 0.8, 5, 0.9995
#: A block of a bucket has about so many words and classes at most.
BLOCK_WORDS, BLOCK_MEMBERS = 400_000, 512

_SEEDS = np.random.default_rng(8).integers(1, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)
_SKETCH = (
    "doc_id {id}, text_key long, set_a long, set_b long, n_words long, n_grams long, bands array<long>"
)
_SCORED = "class string, linked_classes long, linked_docs long, root string"


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands that find a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def sketches(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """Per document a 128-bit hash of its n-gram set and one hash per band."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of_batches(batches):
        for batch in batches:
            for first, words in slices(batch.column(2)):
                grams, bound = gram_sets(words, n)
                count = len(bound) - 1
                filled = np.flatnonzero(np.diff(bound) > 0)
                cut = bound[:-1][filled]
                key = np.zeros((2, count), dtype=np.uint64)
                table = np.zeros((count, bands), dtype=np.uint64)
                if len(filled):
                    key[0, filled] = np.add.reduceat(mixed(grams), cut)
                    key[1, filled] = np.add.reduceat(mixed(grams ^ _SEEDS[-1]), cut)
                    for band in range(bands):
                        value = np.zeros(len(filled), dtype=np.uint64)
                        for row in range(rows):
                            seed = _SEEDS[band * rows + row]
                            # A product's high bits depend on all bits; only their order matters.
                            least = np.minimum.reduceat((grams ^ seed) * seed, cut)
                            value = mixed(value * np.uint64(31) + least)
                        table[filled, band] = value
                lists = [x if f else None for x, f in zip(table.view(np.int64), np.diff(bound) > 0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, count),
                        batch.column(1).slice(first, count),
                        pa.array(key[0].view(np.int64)),
                        pa.array(key[1].view(np.int64)),
                        pa.array(np.diff(words.bound), pa.int64()),
                        pa.array(np.diff(bound), pa.int64()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "set_a", "set_b", "n_words", "n_grams", "bands"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(of_batches, _SKETCH.format(id=kind))


def _scorer(n: int, threshold: float):
    """Links within one block, or between two, of one bucket."""

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("class").combine_chunks()
        count = table.num_rows
        text = table["text"].combine_chunks()
        grams, member = [], []
        for first, words in slices(text):
            part, bound = gram_sets(words, n)
            grams.append(part)
            member.append(first + np.repeat(np.arange(len(bound) - 1), np.diff(bound)))
        grams, member = np.concatenate(grams), np.concatenate(member)
        shared = shared_counts(grams, member, count)
        size = np.bincount(member, minlength=count)
        # (1 - 1e-12): the threshold itself counts, whatever its last binary digit.
        near = shared >= (size[:, None] + size[None, :] - shared) * (threshold * (1 - 1e-12))
        near &= np.arange(count)[:, None] < np.arange(count)[None, :]
        side = np.array(table["side"])
        if not np.array(table["within"])[0]:
            near &= side[:, None] != side[None, :]
        first, second = np.nonzero(near)
        band = int(table["band"][0].as_py())
        values = np.array(table["bands"].combine_chunks().flatten()).reshape(count, -1)
        earlier = (values[first, :band] == values[second, :band]).any(axis=1)
        first, second = first[~earlier], second[~earlier]
        copies = np.array(table["copies"])
        classes = np.zeros(count, dtype=np.int64)
        docs = np.zeros(count, dtype=np.int64)
        for a, b in ((first, second), (second, first)):
            np.add.at(classes, a, 1)
            np.add.at(docs, a, copies[b])
        root = least_linked(first, second, count)
        keep = np.flatnonzero(classes)
        name = table["class"].combine_chunks()
        return pa.table(
            {
                "class": name.take(pa.array(keep)),
                "linked_classes": pa.array(classes[keep]),
                "linked_docs": pa.array(docs[keep]),
                "root": name.take(pa.array(root[keep])),
            }
        )

    return score


def similar_classes(
    docs: DataFrame,
    n: int = WORDS,
    threshold: float = THRESHOLD,
    rows: int = ROWS,
    recall: float = RECALL,
) -> tuple[DataFrame, DataFrame]:
    """(documents with their class; classes with their links and group).

    First table: ``doc_id``, ``text_key``, ``class``. Second: ``class``, ``copies``, ``linked_classes``,
    ``linked_docs`` (documents of linked classes), ``root`` (least class of the group).
    """
    bands = bands_for(threshold, rows, recall)
    sketch = sketches(docs, n, rows, bands)
    by_set = F.concat_ws("-", F.hex("set_a"), F.hex("set_b"))
    # Without words, the text itself is the class; null or empty, the row is alone.
    wordless = F.concat(F.lit("t-"), F.hex("text_key"))
    named = save(
        sketch.withColumn("class", F.when(F.col("n_grams") > 0, by_set).otherwise(wordless)),
        "sketches",
    )
    classes = save(
        named.groupBy("class").agg(
            F.count("*").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.max("bands").alias("bands"),
            F.min(F.struct("doc_id", "text_key")).alias("least"),
        )
        .select("class", "copies", "n_words", "bands", "least.doc_id", "least.text_key"),
        "classes",
    )
    placed = classes.filter("bands is not null").select(
        "class", "n_words", F.posexplode("bands").alias("band", "value")
    )
    buckets = placed.groupBy("band", "value").agg(
        F.count("*").alias("members"),
        F.sum("n_words").alias("total"),
        F.bit_xor(F.xxhash64("class")).alias("same_a"),
        F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("same_b"),
    )
    kept = save(
        buckets.filter("members > 1")
        .groupBy("members", "total", "same_a", "same_b")
        .agg(F.min(F.struct("band", "value")).alias("bucket"))
        .select(
            "bucket.band",
            "bucket.value",
            F.greatest(
                F.ceil(F.col("total") / BLOCK_WORDS), F.ceil(F.col("members") / BLOCK_MEMBERS)
            )
            .cast("int")
            .alias("blocks"),
        ),
        "buckets",
    )
    # Most band values are those of one class alone; they are left out before the shuffle.
    bucket_key = F.xxhash64("band", "value")
    shared_values = key_filter(kept.select(bucket_key.alias("bucket")), "bucket")
    placed = passing(placed.withColumn("bucket", bucket_key), "bucket", shared_values).drop("bucket")
    # A class of block b takes part in the tasks (b, b), (b, later) and (earlier, b).
    block = F.pmod(F.xxhash64(F.lit(2), "class"), F.col("blocks")).cast("int")
    dealt = save(
        placed.join(kept, ["band", "value"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "class",
            "band",
            "value",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            F.col("block").alias("side"),
            (F.col("block") == F.col("other")).alias("within"),
        ),
        "dealt",
    )
    wanted = dealt.select("class").distinct()
    chosen = classes.join(wanted, "class").select("class", "copies", "bands", "doc_id", "text_key")
    # Texts that no bucket wants are left out before the shuffle.
    texts = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_key"),
        F.xxhash64("doc_id", F.xxhash64("text")).alias("_both"),
        "text",
    )
    needed = key_filter(chosen.select(F.xxhash64("doc_id", "text_key").alias("both")), "both")
    texts = passing(texts, "_both", needed).drop("_both")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    # Repeated rows give a class several equal texts; one is enough.
    members = chosen.join(texts, same).groupBy("class").agg(
        F.first("copies").alias("copies"),
        F.first("bands").alias("bands"),
        F.first("text").alias("text"),
    )
    scored = save(
        dealt.join(members, "class")
        .groupBy("band", "value", "low", "high")
        .applyInArrow(_scorer(n, threshold), _SCORED),
        "scored",
    )
    links = scored.groupBy("class").agg(
        F.sum("linked_classes").alias("linked_classes"), F.sum("linked_docs").alias("linked_docs")
    )
    roots = components(scored, "class", "root").withColumnRenamed("node", "class")
    summary = (
        classes.select("class", "copies")
        .join(links, "class", "left")
        .join(roots, "class", "left")
        .select(
            "class",
            "copies",
            F.coalesce("linked_classes", F.lit(0)).alias("linked_classes"),
            F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"),
            F.coalesce("root", "class").alias("root"),
        )
    )
    return named.select("doc_id", "text_key", "n_words", "class"), summary


def links_per_document(docs: DataFrame, **options) -> DataFrame:
    """One row per document: class, group, number of linked documents.

    ``copy_of`` is the least doc_id with the same n-gram set, ``group_id`` the least doc_id of the group;
    ``group_key`` tells groups apart even where ids repeat.
    Documents without words (null and empty ones too) have only equal texts as links, null and empty none.
    """
    with storage.scope(docs.sparkSession):
        return storage.hand_over(_links_per_document(docs, **options), "links_per_document")


def _links_per_document(docs: DataFrame, **options) -> DataFrame:
    named, summary = similar_classes(docs, **options)
    empty = F.xxhash64(F.lit("")) == F.col("text_key")
    null = F.xxhash64(F.lit(None).cast("string")) == F.col("text_key")
    alone = (F.col("n_words") == 0) & (empty | null)
    firsts = named.groupBy("class").agg(F.min("doc_id").alias("copy_of"))
    facts = save(summary.join(firsts, "class"), "facts")
    groups = facts.groupBy("root").agg(F.min("copy_of").alias("group_id"))
    joined = named.join(facts.join(groups, "root"), "class")
    return joined.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.when(alone, F.concat_ws("-", F.lit("e"), "doc_id", "text_key"))
        .otherwise(F.col("root"))
        .alias("group_key"),
        F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1).alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.col("linked_classes")).alias("n_linked_classes"),
        F.when(alone, F.lit(0))
        .otherwise(F.col("copies") - 1 + F.col("linked_docs"))
        .alias("n_links"),
    )


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the least (doc_id, text_key), once.

    Null and empty texts are groups of their own by id, so all of them stay, repeated rows once.
    """
    with storage.scope(docs.sparkSession):
        rows = links_per_document(docs, **options).groupBy("group_key", "doc_id", "text_key")
        times = save(rows.agg(F.count("*").alias("times")), "times")
        best = times.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
        stays = F.struct("doc_id", "text_key").eqNullSafe(F.col("best"))
        # What goes, and what is there several times; all other rows stay as they are.
        decided = times.join(best, "group_key").select(
            F.col("doc_id").alias("__llm_id"),
            F.col("text_key").alias("__llm_key"),
            F.xxhash64("doc_id", "text_key").alias("__llm_both"),
            stays.alias("__llm_stays"),
        )
        decided = hand_over(decided.filter(~stays | (F.col("times") > 1)), "decided")
    both = F.xxhash64("doc_id", F.xxhash64("text")).alias("__llm_both")
    marked = marking(docs.select("*", both), "__llm_both", key_filter(decided, "__llm_both"), "__llm_maybe")
    surely = marked.filter("not __llm_maybe").select(*docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.xxhash64("text") == F.col("__llm_key"))
    maybe = marked.filter("__llm_maybe").select(*docs.columns).join(decided, same, "left")
    once = maybe.filter("__llm_key is null").select(*docs.columns)
    more = maybe.filter("__llm_stays").dropDuplicates(["__llm_id", "__llm_key"]).select(*docs.columns)
    return surely.unionByName(once).unionByName(more)


def op8_ngram_jaccard_join(spark, folder):
    """One row per document: class, group, number of linked documents."""
    rows = links_per_document(tables.read(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        F.col("copy_of").alias("class_id"),
        "group_id",
        "n_copies",
        "n_linked_classes",
        "n_links",
    )


_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, text, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, w[i : i + 4] AS gram
  FROM docs, LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a, b, shared = x.n AND shared = y.n AS same
  FROM (SELECT g.doc_id AS a, h.doc_id AS b, count(*) AS shared
        FROM grams g JOIN grams h USING (gram) WHERE g.doc_id <> h.doc_id GROUP BY 1, 2)
  JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE shared >= 0.8 * (x.n + y.n - shared)
  UNION ALL
  SELECT p.doc_id, q.doc_id, true FROM docs p JOIN docs q USING (text)
  WHERE len(p.w) = 0 AND p.text <> '' AND p.doc_id <> q.doc_id),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
groups AS (SELECT a AS doc_id, min(b) AS group_id FROM reach GROUP BY a),
classes AS (
  SELECT docs.doc_id, least(docs.doc_id, coalesce(min(b) FILTER (WHERE same), docs.doc_id)) AS class_id,
         count(b) FILTER (WHERE same) AS n_copies, count(b) AS n_links
  FROM docs LEFT JOIN links ON docs.doc_id = a GROUP BY docs.doc_id),
others AS (
  SELECT a AS doc_id, count(DISTINCT class_id) AS n_linked_classes
  FROM links JOIN classes ON b = classes.doc_id WHERE NOT same GROUP BY a)
SELECT doc_id, class_id, group_id, n_copies, coalesce(n_linked_classes, 0) AS n_linked_classes, n_links
FROM classes JOIN groups USING (doc_id) LEFT JOIN others USING (doc_id)"""

QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
ORACLE = {"op8_ngram_jaccard_join": _SQL}

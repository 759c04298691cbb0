"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. One hash per shingle. Its high bits deal the shingles of a document into bins, and each bin keeps its least
   hash. An empty bin takes the value of the first filled bin in an order of its own, the same order in every
   document (optimal densification), so that a bin's values agree with the chance of the Jaccard similarity.
2. Consecutive bins make a band. Documents with equal sets are one class; classes meet where a band agrees.
   The number of bands is the least that finds a pair at the threshold with the wanted chance.
3. In each bucket the least class is the centre, and every other class has one candidate edge to it: a star. So a
   bucket of any size gives fewer edges than it has members. First each class is compared, on full sets, with
   the least of its centres; then with the others, as far as they are not connected yet.
4. What stars cannot tell: two classes of a bucket that are not connected, of which neither is the centre. Such
   buckets are compared exactly, block against block: the classes outside its largest group against all.
   Nothing is capped, and no pair is written out but links of a spanning forest.
5. Connected components of the links; the least document id of a component is its name.

A hot bucket is spread over tasks of bounded words and members; texts meet in the tasks, never in a bucket.

Edge cases: a document with fewer words than a shingle is one shingle; without words (null, empty, blanks) it has
no set and is linked with nothing. Repeated rows and equal sets are one class. A null id takes no part in the
least id of a component, and its row is kept. An empty table gives an empty table; only ``doc_id`` and ``text``
are looked at.
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
from basketry.llm.key_filter import key_filter, passing
from basketry.llm.words import NO_BLANKS, mixed, slices

WORDS, PERCENT, ROWS, RECALL = 2, 80, 6, 0.9999
#: A task compares about so many words and classes at most.
TASK_WORDS, TASK_MEMBERS = 400_000, 512

_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_SKETCH = "doc_id {id}, text_key long, class binary, n_words long, n_shingles long, bands array<long>"
_LINKS = "class binary, root binary"


def bands_for(percent: int, rows: int, recall: float) -> int:
    """The least number of bands that find a pair at the threshold with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def bins_of(grams: np.ndarray, row: np.ndarray, count: int, bins: int) -> tuple:
    """Least hash of each bin, ``count`` rows by ``bins``, and which bins are filled."""
    least = np.full(count * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    value = mixed(grams ^ _A)
    place = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, row * bins + place, value)
    filled = np.zeros(count * bins, dtype=bool)
    filled[row * bins + place] = True
    return least.reshape(count, bins), filled.reshape(count, bins)


def probes(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others, the same for all documents."""
    rng = np.random.default_rng(12)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def densified(least: np.ndarray, filled: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled bin in their order. Rows need one filled bin."""
    out = least.copy()
    row, place = np.nonzero(~filled)
    step = 0
    while len(row):
        asked = order[place, step]
        found = filled[row, asked]
        out[row[found], place[found]] = least[row[found], asked[found]]
        row, place = row[~found], place[~found]
        step += 1
    return out


def band_keys(grams: np.ndarray, bound: np.ndarray, rows: int, order: np.ndarray) -> np.ndarray:
    """A hash per band of each set; ``order`` comes from :func:`probes`, sets are not empty."""
    count, bins = len(bound) - 1, len(order)
    member = np.repeat(np.arange(count), np.diff(bound))
    least, filled = bins_of(grams, member, count, bins)
    values = densified(least, filled, order).reshape(count, bins // rows, rows)
    out = np.tile(np.arange(1, bins // rows + 1, dtype=np.uint64) * _B, (count, 1))
    for i in range(rows):
        out = mixed(out * np.uint64(31) + values[:, :, i])
    return out


def sketches(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """Per document the 128-bit name of its set and one hash per band; both null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of_batches(batches):
        order = probes(rows * bands)
        for batch in batches:
            for first, found in slices(batch.column(2), NO_BLANKS):
                grams, bound = gram_sets(found, words)
                count = len(bound) - 1
                full = np.flatnonzero(np.diff(bound))
                names, lists = [None] * count, [None] * count
                if len(full):
                    tight = np.r_[bound[:-1][full], bound[-1]]
                    pair = np.stack(
                        [np.add.reduceat(mixed(grams ^ seed), tight[:-1]) for seed in (_A, _B)], axis=1
                    )
                    for i, name in zip(full, pair):
                        names[i] = name.tobytes()
                    for i, keys in zip(full, band_keys(grams, tight, rows, order).view(np.int64)):
                        lists[i] = keys
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, count),
                        batch.column(1).slice(first, count),
                        pa.array(names, pa.binary()),
                        pa.array(np.diff(found.bound), pa.int64()),
                        pa.array(np.diff(bound), pa.int64()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "class", "n_words", "n_shingles", "bands"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(of_batches, _SKETCH.format(id=kind))


def _sets_of(column: pa.Array, words: int):
    """(grams, member) of all texts of a column."""
    grams, member = [], []
    for first, found in slices(column, NO_BLANKS):
        part, bound = gram_sets(found, words)
        grams.append(part)
        member.append(first + np.repeat(np.arange(len(bound) - 1), np.diff(bound)))
    return np.concatenate(grams), np.concatenate(member)


def _near(shared, size, other, percent: int):
    return 100 * shared >= percent * (size + other - shared)


def _star(words: int, percent: int):
    """Members of a star that are linked with its centre."""

    def score(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grams, member = _sets_of(table["text"].combine_chunks(), words)
        size = np.bincount(member, minlength=table.num_rows)
        centre = int(np.flatnonzero(table["is_centre"].to_numpy())[0])
        own = grams[member == centre]
        shared = np.bincount(member[np.isin(grams, own)], minlength=table.num_rows)
        near = _near(shared, size, len(own), percent)
        near[centre] = False
        name = table["class"].combine_chunks()
        linked = pa.array(np.flatnonzero(near))
        return pa.table(
            {"class": name.take(linked), "root": pa.array([name[centre].as_py()] * len(linked), pa.binary())}
        )

    return score


def _blocks(words: int, percent: int):
    """Links between classes of different groups, one side of a bucket's grid against the other."""

    def score(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        count = table.num_rows
        grams, member = _sets_of(table["text"].combine_chunks(), words)
        size = np.bincount(member, minlength=count)
        shared = shared_counts(grams, member, count)
        near = _near(shared, size[:, None], size[None, :], percent)
        side = np.array(table["side"])
        group = np.unique(np.array(table["root"].to_pylist(), dtype=object), return_inverse=True)[1]
        near &= (side[:, None] == 0) & (side[None, :] == 1) & (group[:, None] != group[None, :])
        first, second = np.nonzero(near)
        root = least_linked(first, second, count)
        linked = np.flatnonzero(root != np.arange(count))
        name = table["class"].combine_chunks()
        return pa.table({"class": name.take(pa.array(linked)), "root": name.take(pa.array(root[linked]))})

    return score


def _compared(edges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among candidate edges (class, centre), each star cut into tasks of bounded size."""
    sized = edges.join(texts.select("class", "n_words"), "class")
    stars = sized.groupBy("centre").agg(F.count("*").alias("many"), F.sum("n_words").alias("total"))
    shards = F.greatest(
        F.ceil(F.col("many") / TASK_MEMBERS), F.ceil(F.col("total") / TASK_WORDS), F.lit(1)
    ).cast("int")
    stars = stars.select("centre", shards.alias("shards"))
    rows = sized.join(stars, "centre").select(
        "class",
        "centre",
        F.pmod(F.xxhash64("class"), F.col("shards")).cast("int").alias("shard"),
        F.lit(False).alias("is_centre"),
    )
    heads = stars.select(
        F.col("centre").alias("class"),
        "centre",
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.lit(True).alias("is_centre"),
    )
    return (
        rows.unionByName(heads)
        .join(texts.select("class", "text"), "class")
        .groupBy("centre", "shard")
        .applyInArrow(_star(words, percent), _LINKS)
    )


def _rooted(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The classes with the root of their group so far, their own name at first."""
    if roots is None:
        return classes.withColumn("root", F.col("class"))
    named = roots.select(F.col("node").alias("class"), F.col("root"))
    return classes.join(named, "class", "left").withColumn("root", F.coalesce("root", "class"))


def _open_buckets(placed: DataFrame, words: int, percent: int, texts: DataFrame) -> DataFrame:
    """Links in buckets that hold several groups; placed: (value, centre, class, root)."""
    groups = placed.groupBy("value", "root").agg(
        F.count("*").alias("members"),
        F.sum("n_words").alias("words"),
        F.bit_xor(F.xxhash64("class")).alias("same_a"),
        F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("same_b"),
        # The centre has been compared with all: as a group of its own it needs no task.
        F.max((F.col("class") == F.col("centre")).cast("int")).alias("has_centre"),
    )
    apart = F.sum(F.when((F.col("has_centre") == 1) & (F.col("members") == 1), 0).otherwise(1))
    buckets = (
        groups.groupBy("value")
        .agg(
            apart.alias("apart"),
            F.max(F.struct("members", "root", "words")).alias("major"),
            F.sum("members").alias("members"),
            F.sum("words").alias("words"),
            F.bit_xor("same_a").alias("same_a"),
            F.bit_xor("same_b").alias("same_b"),
        )
        .filter("apart > 1")
        # Buckets of several bands with the very same members are one.
        .groupBy("members", "words", "same_a", "same_b")
        .agg(F.min("value").alias("value"), F.min("major").alias("major"))
    )

    def blocks(members, total):
        return F.greatest(F.ceil(members / (TASK_MEMBERS // 2)), F.ceil(total * 2 / TASK_WORDS)).cast("int")

    buckets = buckets.select(
        "value",
        F.col("major.root").alias("major"),
        blocks(
            F.col("members") - F.col("major.members"), F.col("words") - F.col("major.words")
        ).alias("rows"),
        blocks(F.col("members"), F.col("words")).alias("columns"),
    )
    dealt = placed.select("value", "class", "root").join(buckets, "value")
    one, two = F.xxhash64(F.lit(2), "class"), F.xxhash64(F.lit(3), "class")
    rest = dealt.filter(F.col("root") != F.col("major")).select(
        "value",
        "class",
        "root",
        F.pmod(one, F.col("rows")).cast("int").alias("low"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("high"),
        F.lit(0).alias("side"),
    )
    all_ = dealt.select(
        "value",
        "class",
        "root",
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("low"),
        F.pmod(two, F.col("columns")).cast("int").alias("high"),
        F.lit(1).alias("side"),
    )
    return (
        rest.unionByName(all_)
        .join(texts.select("class", "text"), "class")
        .groupBy("value", "low", "high")
        .applyInArrow(_blocks(words, percent), _LINKS)
    )


def _groups(docs: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """(class, component_id) of all classes, from the sketches of the documents."""
    classes = storage.save(
        named.filter("class is not null")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.first("n_words").alias("n_words"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.min(F.struct("doc_id", "text_key")).alias("at"),
        ),
        "classes",
    )
    placed = classes.select("class", "n_words", "n_shingles", F.explode("bands").alias("value"))
    stars = (
        placed.groupBy("value")
        .agg(F.count("*").alias("many"), F.min(F.struct("class", "n_shingles")).alias("centre"))
        .filter("many > 1")
        .select("value", F.col("centre.class").alias("centre"), F.col("centre.n_shingles").alias("c"))
    )
    met = storage.save(placed.join(stars, "value"), "met")
    # Sets whose sizes differ too much cannot reach the threshold.
    alike = 100 * F.least("n_shingles", "c") >= percent * F.greatest("n_shingles", "c")
    edges = met.filter((F.col("class") != F.col("centre")) & alike).select("class", "centre").distinct()
    edges = storage.save(edges, "edges")
    texts = storage.save(_texts(docs, classes, met.select("class").distinct()), "texts")
    nearest = edges.groupBy("class").agg(F.min("centre").alias("centre"))
    links = storage.save(_compared(nearest, texts, words, percent), "links")
    roots = components(links, "class", "root")
    # The other edges of the stars, between what is not connected yet.
    ends = _rooted(_rooted(edges, roots).withColumnsRenamed({"root": "a", "class": "x", "centre": "class"}), roots)
    left = ends.filter("a <> root").select(F.col("x").alias("class"), F.col("class").alias("centre"))
    left = left.join(nearest, ["class", "centre"], "left_anti")
    links = storage.save(links.union(_compared(left, texts, words, percent)), "links")
    roots = components(links, "class", "root")
    found = storage.save(_open_buckets(_rooted(met, roots), words, percent, texts), "links")
    if not found.isEmpty():
        roots = components(links.union(found), "class", "root")
    rooted = _rooted(classes.select("class", "least_id"), roots)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("class", "component_id")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, n_words, text) of the wanted classes; other texts are left out before the shuffle."""
    places = classes.join(wanted, "class").select("class", "n_words", "at.doc_id", "at.text_key")
    places = storage.save(
        places.withColumn("key", F.xxhash64("doc_id", "text_key")), "places"
    )
    texts = docs.select(
        F.xxhash64("doc_id", F.xxhash64("text")).alias("key"),
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_key"),
        "text",
    )
    texts = passing(texts, "key", key_filter(places, "key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    # Repeated rows give a class several equal texts; one is enough.
    return (
        places.join(texts.drop("key"), same)
        .groupBy("class")
        .agg(F.first("n_words").alias("n_words"), F.first("text").alias("text"))
    )


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    rows: int = ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` / 100 or
    more; ``component_id`` is the least doc_id that a document is linked with, directly or not. ``kept`` is
    true for the documents that bear their component's id.
    """
    spark = docs.sparkSession
    with storage.scope(spark):
        bands = bands_for(percent, rows, recall)
        named = storage.save(sketches(docs, words, rows, bands), "sketches")
        groups = _groups(docs, named, words, percent)
        joined = named.select("doc_id", "text_key", "n_shingles", "class").join(groups, "class", "left")
        own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        out = joined.select("doc_id", "text_key", "n_shingles", own.alias("component_id")).withColumn(
            "kept", F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull()
        )
        return storage.hand_over(out, "near_duplicates")


def op12_near_dedup(spark, folder):
    """One row per document: size of its set, the least id of its component, whether it stays."""
    found = near_duplicates(tables.read(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, w[i : i + 1] AS gram
  FROM docs, LATERAL unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a, b
  FROM (SELECT g.doc_id AS a, h.doc_id AS b, count(*) AS shared
        FROM grams g JOIN grams h USING (gram) WHERE g.doc_id <> h.doc_id GROUP BY 1, 2)
  JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN sizes USING (doc_id)"""

QUERIES = {"op12_near_dedup": op12_near_dedup}
ORACLE = {"op12_near_dedup": _SQL}

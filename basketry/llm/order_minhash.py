"""Order MinHash fingerprints with built-in SQL functions only.

A text's k-mers are its runs of ``K`` words (a shorter text is one k-mer). The i-th occurrence of a k-mer counts
as an element of its own. Each element's hash gives it a place in one of ``TUPLES`` x ``LENGTH`` cells and a
rank there; the least element of each cell is selected (one permutation, dealt into cells, instead of one
permutation per tuple). A tuple with an empty cell takes the ``LENGTH`` least elements of the whole text under a
permutation of its own instead, so every tuple of a text with as many elements has ``LENGTH`` of them. The
selected k-mers of one tuple are put in text order and hashed together, so a tuple changes if words change and
also if they change places. The likeness of two fingerprints is the share of equal tuples among those that
either has.

All of it happens inside a row, on sorted arrays of 64-bit numbers: no row per k-mer is made. Only ``edits`` moves
texts: once, to buckets of neighbouring ids.

Edge cases: null counts as empty; an empty text has one k-mer of no words; texts of any length (up to 2^28
words); equal texts have equal fingerprints; repeated rows are documents of their own; equal ids follow each other by
text; null ids come last; an empty table gives no rows; other columns are not looked at.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm import tables

K, TUPLES, LENGTH = 3, 64, 2
#: About so many documents make a bucket of neighbours, and there are so many buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16
_PLACE = 28  # bits for the position of a k-mer
_PLACES = (1 << _PLACE) - 1


def _let(value, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _packed(hash_, place) -> Column:
    """The high bits of a hash and a position in one number that sorts by the former."""
    return hash_.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(place.cast("bigint"))


def _high(number) -> Column:
    return F.shiftright(number, _PLACE)


def _selected(ranked, cells: int, bits: int) -> Column:
    """The least number of each cell (its leading bits), in signed order; all ones stand for none."""
    rest = (1 << (64 - bits)) - 1
    none = [((cell << (64 - bits)) | rest) for cell in range(cells)]
    none = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint") for x in none])

    def first_of_cell(numbers):
        def is_first(x, i):
            return (i == 0) | (
                F.shiftright(x, 64 - bits) != F.shiftright(F.get(numbers, i - 1), 64 - bits)
            )

        return F.filter(numbers, is_first)

    return _let(F.sort_array(F.concat(ranked, none)), first_of_cell)


def fingerprint(text, k: int = K, tuples: int = TUPLES, length: int = LENGTH) -> Column:
    """Array of ``tuples`` numbers below 2^32; null where the text has no element for a tuple."""
    cells = tuples * length
    bits = (cells - 1).bit_length()
    if 1 << bits != cells:
        raise ValueError("tuples x length must be a power of two")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != "")

    def of_hashes(hashes):
        places = F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))

    def ranked(ordered):
        steps = F.array(*[F.lit(1 << b) for b in range(_PLACE - 1, -1, -1)])

        def rank(x, i):
            def same(j):
                return (j >= 0) & (_high(F.get(ordered, j)) == _high(x))

            # Equal k-mers lie side by side; how many lie before this one, found by halving.
            before = F.aggregate(
                steps, F.lit(0), lambda d, s: F.when(same(i - d - s), d + s).otherwise(d)
            )
            number = F.when(same(i - 1), before).otherwise(F.lit(0))
            return _packed(F.xxhash64(_high(x), number), x.bitwiseAND(F.lit(_PLACES)))

        return F.transform(ordered, rank)

    def of_grams(grams):
        ordered = F.sort_array(F.transform(grams, lambda g, i: _packed(g, i)))
        return _let(
            _let(ordered, ranked),
            lambda elements: _let(
                _selected(elements, cells, bits), lambda chosen: in_order(grams, elements, chosen)
            ),
        )

    def least_of_all(elements, number):
        """Places of the least elements of the whole text under the permutation of this tuple."""

        def rank(x):
            return _packed(F.xxhash64(_high(x), number), x.bitwiseAND(F.lit(_PLACES)))

        least = F.slice(F.sort_array(F.transform(elements, rank)), 1, length)
        return F.transform(least, lambda x: x.bitwiseAND(F.lit(_PLACES)))

    def in_order(grams, elements, chosen):
        def one(number):
            low = number * length
            cells = [F.get(chosen, low + j).bitwiseAND(F.lit(_PLACES)) for j in range(length)]
            places = F.array_sort(
                F.when(F.greatest(*cells) < _PLACES, F.array(*cells)).otherwise(
                    least_of_all(elements, number)
                )
            )

            def hashed(places):
                kmers = [F.get(grams, F.get(places, F.lit(j)).cast("int")) for j in range(length)]
                code = F.xxhash64(*kmers).bitwiseAND(F.lit(0xFFFFFFFF))
                return F.when(kmers[0].isNotNull(), code)

            return _let(places, hashed)

        return F.transform(F.sequence(F.lit(0), F.lit(tuples - 1)), one)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashes, lambda h: _let(of_hashes(h), of_grams))


def written(print_) -> Column:
    """A fingerprint as text: eight hex digits a tuple, dashes for none."""
    cell = lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 8, "0"), F.lit("-" * 8))
    return F.array_join(F.transform(print_, cell), "")


def likeness(left, right) -> Column:
    """Share of equal tuples among those that either fingerprint has, 0 to 1."""
    equal = F.zip_with(left, right, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    there = F.zip_with(left, right, lambda a, b: (a.isNotNull() | b.isNotNull()).cast("int"))

    def total(x):
        return F.aggregate(x, F.lit(0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(total(equal).cast("double"), total(there)), F.lit(0.0))


def _with_buckets(docs: DataFrame) -> DataFrame:
    """``docs`` dealt into buckets of neighbouring ids (0: the least), with the first document of the next bucket.

    Bounds come from a hash sample of the ids: at most 20 ids a bucket reach the driver. Rows that were
    added have ``_ghost``.
    """
    ids = docs.select("doc_id")
    count = ids.count()
    buckets = max(1, min(MOST_BUCKETS, -(-count // BUCKET_ROWS)))
    every = max(1, count // (20 * buckets))
    seen = sorted(
        row[0]
        for row in ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        .filter("doc_id is not null")
        .distinct()
        .limit(40 * buckets)
        .collect()
    )
    step = max(1, len(seen) // buckets)
    bounds = seen[step::step][: buckets - 1]
    kind = docs.schema["doc_id"].dataType
    if bounds:
        steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
        held = F.array(*[F.lit(b).cast(kind) for b in bounds])
        bucket = _let(
            held,
            lambda held: F.aggregate(
                steps,
                F.lit(0),
                lambda at, s: F.when(F.get(held, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at),
            ),
        )
    else:
        bucket = F.lit(0)
    placed = docs.withColumn("_bucket", bucket)
    heads = (
        placed.groupBy("_bucket")
        .agg(F.max("doc_id").alias("_head"))
        # One row a bucket: the bucket whose documents come before this one's, the least after the first.
        .withColumn("_before", F.lead("_bucket").over(Window.orderBy("_bucket")))
        .withColumn("_least", F.min("_bucket").over(Window.partitionBy()))
        .select("_head", F.coalesce("_before", "_least").alias("_to"))
    )
    ghosts = (
        docs.join(heads, F.col("doc_id").eqNullSafe(F.col("_head")))
        .groupBy("doc_id", "_to")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("_to").alias("_bucket"), F.lit(True).alias("_ghost"))
    )
    return placed.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the beginning of the next document.

    Documents follow each other by descending doc_id, the first after the last.
    """
    rows = _with_buckets(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    # A bucket's ghost comes after all its documents.
    order = Window.partitionBy("_bucket").orderBy(
        "_ghost", F.col("doc_id").desc_nulls_last(), "text"
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring("_next", F.lit(1), half),
    )
    return (
        rows.withColumn("_next", F.lead("text").over(order))
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited", F.when(~F.col("_ghost"), edited))
        .withColumn("print", fingerprint(F.col("text")))
        .withColumn("edited_print", F.when(~F.col("_ghost"), fingerprint(F.col("edited"))))
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .select("doc_id", "_bucket", "_ghost", "text", "n_chars", "edited_sha256", "print", "edited_print")
        .withColumn("next_print", F.lead("print").over(order))
        .filter(~F.col("_ghost"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            written(F.col("print")).alias("fingerprint"),
            written(F.col("edited_print")).alias("edited_fingerprint"),
            likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
            likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )
    )


def op2_order_minhash(spark, folder):
    return edits(tables.read(spark, folder, "documents"))


QUERIES = {"op2_order_minhash": op2_order_minhash}

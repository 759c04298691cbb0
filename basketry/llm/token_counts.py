"""Token counts from one exact histogram of encoded lengths.

Documents are encoded where they are read and counted there by length, so a row per task and length is all that
is shuffled. Sums over all shorter and all longer lengths then answer, for every context limit, how many
documents fit, how many tokens there are, how many are left when longer documents are cut, and which
length a quantile has. The sums run over cells of ``CELL`` lengths and within cells, never over one sorted whole.

Edge cases: a null or empty text has length 0 and is counted; repeated rows count each; an empty table has an
empty histogram (``totals`` gives zeros, ``quantiles`` no rows); other columns are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm import tables
from basketry.llm.encoding import ids_of
from basketry.storage import save

CELL = 1024


def histogram(docs: DataFrame, path: str | None = None, end: int = 0) -> DataFrame:
    """(length, n_docs), a row per different encoded length; ``end`` is added to every length."""

    def of_batches(batches):
        for batch in batches:
            for _, texts in ids_of(batch.column(0), path):
                sizes = np.array([len(x) for x in texts], dtype=np.int64) + end
                length, count = np.unique(sizes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(length), pa.array(count)], names=["length", "n_docs"]
                )

    counted = docs.select("text").mapInArrow(of_batches, "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """For every length in the histogram, taken as a context limit:

    ``docs_within`` and ``tokens_within`` of documents not longer, ``docs_over`` and ``tokens_over`` of longer ones,
    ``truncated_tokens`` if longer ones are cut to the limit, ``lost_tokens`` that the cut loses, ``quantile`` (share of
    documents not longer). Between two of its lengths, ``truncated_at`` has the value for any limit.
    """
    cell = F.floor(F.col("length") / CELL).alias("cell")
    tokens = F.col("length") * F.col("n_docs")
    per_cell = counts.groupBy(cell).agg(
        F.sum("n_docs").alias("cell_docs"), F.sum(tokens).alias("cell_tokens")
    )
    # A row per 1024 lengths: as many as the longest document has thousands of tokens, at most.
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    outside = per_cell.select(
        "cell",
        *[
            F.coalesce(F.sum(f"cell_{what}").over(rows), F.lit(0)).alias(f"{name}_{what}")
            for what in ("docs", "tokens")
            for name, rows in (("earlier", earlier), ("later", later))
        ],
    )
    up_to = Window.partitionBy("cell").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("cell").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    none = F.lit(0)
    return (
        counts.withColumn("cell", F.floor(F.col("length") / CELL))
        .join(outside, "cell")
        .select(
            "length",
            "n_docs",
            (F.col("earlier_docs") + F.sum("n_docs").over(up_to)).alias("docs_within"),
            (F.col("earlier_tokens") + F.sum(tokens).over(up_to)).alias("tokens_within"),
            (F.col("later_docs") + F.coalesce(F.sum("n_docs").over(beyond), none)).alias("docs_over"),
            (F.col("later_tokens") + F.coalesce(F.sum(tokens).over(beyond), none)).alias("tokens_over"),
        )
        .withColumn(
            "truncated_tokens", F.col("tokens_within") + F.col("length") * F.col("docs_over")
        )
        .withColumn("lost_tokens", F.col("tokens_over") - F.col("length") * F.col("docs_over"))
        .withColumn(
            "quantile", F.col("docs_within") / (F.col("docs_within") + F.col("docs_over"))
        )
    )


def totals(counts: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, shortest, longest."""
    return counts.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("n_tokens"),
        F.min("length").alias("shortest"),
        F.max("length").alias("longest"),
    )


def quantiles(counts: DataFrame, shares) -> DataFrame:
    """(share, length): the least length that this share of the documents does not exceed."""
    known = limits(counts)
    least = [
        F.struct(
            F.lit(float(s)).alias("share"),
            F.min(F.when(F.col("quantile") >= float(s), F.col("length"))).alias("length"),
        )
        for s in shares
    ]
    rows = known.agg(F.array(*least).alias("rows")).select(F.inline("rows"))
    return rows.filter("length is not null")


def truncated_at(counts: DataFrame, context_limits) -> DataFrame:
    """(limit, n_tokens, n_cut): tokens and cut documents if documents are cut to each of these limits."""
    sums = []
    for limit in context_limits:
        longer = F.col("length") > int(limit)
        sums.append(
            F.struct(
                F.lit(int(limit)).alias("limit"),
                F.sum(F.least("length", F.lit(int(limit))) * F.col("n_docs")).alias("n_tokens"),
                F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("n_cut"),
            )
        )
    return counts.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def op4_length_histogram(spark, folder):
    return limits(save(histogram(tables.read(spark, folder, "documents")), "lengths"))


QUERIES = {"op4_length_histogram": op4_length_histogram}

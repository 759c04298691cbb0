"""The product side: categories, labels, model numbers, first-seen hierarchy."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import category_label
from basketry.operators.positions import with_position
from basketry.schemas import CATEGORY_KEYS, PRODUCT_KEYS, UNCATEGORISED


def _one_per_key(categories: DataFrame) -> DataFrame:
    """The category list is keyed by (family, subfamily); a repeated key must not multiply rows."""
    chosen = F.max(F.struct("category1", "category2")).alias("c")
    return categories.groupBy(*CATEGORY_KEYS).agg(chosen).select(*CATEGORY_KEYS, "c.*")


def categorise(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Add category1 and category2 by (family, subfamily), 'X' where the list has no entry.

    No broadcast is forced: the planner broadcasts the list when its size allows, and otherwise
    joins by key with skewed partitions split at run time.
    """
    joined = df.join(_one_per_key(categories), CATEGORY_KEYS, "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(UNCATEGORISED)) for c in ("category1", "category2")}
    )


def drop_uncategorised(df: DataFrame) -> DataFrame:
    return df.filter(F.col("category1") != UNCATEGORISED)


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("CAT1", category_label(F.col("category1")))


def model_ids(products: DataFrame) -> DataFrame:
    """Number the distinct (family, subfamily, name) from 1 in sort order."""
    distinct = products.select(*PRODUCT_KEYS).dropna().distinct()
    return with_position(distinct, PRODUCT_KEYS, "model_id")


def product_table(purchases: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per categorised product, with everything that depends on the product alone."""
    distinct = purchases.select(*PRODUCT_KEYS).dropna().distinct()
    known = drop_uncategorised(categorise(distinct, categories))
    return with_label(with_position(known, PRODUCT_KEYS, "model_id"))


def first_hierarchy(purchases: DataFrame) -> DataFrame:
    """Family and subfamily of each product's earliest purchase."""
    earliest = F.min(
        F.struct("transaction_date", "transaction_id", "prod_family", "prod_subfamily")
    ).alias("e")
    return purchases.groupBy("prod_name").agg(earliest).select(
        "prod_name", "e.prod_family", "e.prod_subfamily"
    )

"""Row filters of the ingest, in the order they are applied."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import differs_from, lacks_words
from basketry.schemas import EXCLUDED_WORDS, NOT_A_PRODUCT, RECENCY_CUTOFF


def exclude_words(df: DataFrame, words=EXCLUDED_WORDS, column: str = "prod_name") -> DataFrame:
    return df.filter(lacks_words(F.col(column), words))


def exclude_value(
    df: DataFrame, value: str = NOT_A_PRODUCT, column: str = "prod_name"
) -> DataFrame:
    return df.filter(differs_from(F.col(column), value))


def drop_missing(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def order_counts(df: DataFrame, key: str) -> DataFrame:
    """Distinct orders per customer or product. Spark pre-aggregates on (key, order) first, so a
    key with a large share of the rows is spread over the cluster."""
    return df.groupBy(key).agg(F.count_distinct("transaction_id").alias("n_orders"))


def keep_active_customers(df: DataFrame, min_orders: int = 6) -> DataFrame:
    active = order_counts(df, "cont_id").filter(F.col("n_orders") >= min_orders)
    return df.join(active, "cont_id", "left_semi")


def keep_supported_products(df: DataFrame, min_orders: int = 75) -> DataFrame:
    supported = order_counts(df, "prod_name").filter(F.col("n_orders") >= min_orders)
    return df.join(supported, "prod_name", "left_semi")


def last_sales(df: DataFrame) -> DataFrame:
    return df.groupBy("prod_name").agg(F.max("transaction_date").alias("last_date"))


def keep_recent_products(df: DataFrame, cutoff: str = RECENCY_CUTOFF) -> DataFrame:
    recent = last_sales(df).filter(F.col("last_date") > F.lit(cutoff).cast("timestamp_ntz"))
    return df.join(recent, "prod_name", "left_semi")


def keep_selling_products(
    df: DataFrame, min_orders: int = 75, cutoff: str = RECENCY_CUTOFF
) -> DataFrame:
    """Support and recency in one pass: both are per-product facts and neither changes the other."""
    return df.join(selling_products(df, min_orders, cutoff), "prod_name", "left_semi")


def selling_products(
    df: DataFrame, min_orders: int = 75, cutoff: str = RECENCY_CUTOFF
) -> DataFrame:
    """Names of the products that are supported and recent."""
    return (
        df.groupBy("prod_name")
        .agg(
            F.count_distinct("transaction_id").alias("n_orders"),
            F.max("transaction_date").alias("last_date"),
        )
        .filter(F.col("n_orders") >= min_orders)
        .filter(F.col("last_date") > F.lit(cutoff).cast("timestamp_ntz"))
        .select("prod_name")
    )


def drop_copies(df: DataFrame) -> DataFrame:
    """Distinct rows. Copies collapse before the shuffle, in the map-side aggregate."""
    return df.dropDuplicates()

"""Customer x product weights in long form: an absent pair is a zero."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.functions import min_max
from basketry.storage import save


def purchase_counts(purchases: DataFrame, keep_nan: bool = False) -> DataFrame:
    """Purchase rows per customer and product; the literal name ``nan`` is no product unless kept."""
    named = purchases.filter(F.col("prod_name").isNotNull())
    if not keep_nan:
        named = named.filter(F.col("prod_name") != "nan")
    return named.groupBy("cont_id", "prod_name").agg(F.count("*").alias("cnt"))


def with_quantity(purchases: DataFrame) -> DataFrame:
    """Put the size of its (customer, product) group on every row.

    An aggregate joined back, not a window: a group of any size is counted map-side and the join
    may split it. Every row stays; one without a customer or a product has no quantity.
    """
    counts = purchase_counts(purchases, keep_nan=True).withColumnRenamed("cnt", "qty")
    return purchases.join(counts.filter("cont_id is not null"), ["cont_id", "prod_name"], "left")


def column_bounds(counts: DataFrame) -> DataFrame:
    """Least and largest count of each product; the least is 0 unless every customer bought it."""
    n_customers = counts.agg(F.count_distinct("cont_id")).scalar()
    return (
        counts.groupBy("prod_name")
        .agg(
            F.min("cnt").alias("low"),
            F.max("cnt").alias("high"),
            F.count("*").alias("buyers"),
        )
        .select(
            "prod_name",
            F.when(F.col("buyers") == n_customers, F.col("low"))
            .otherwise(F.lit(0))
            .cast("long")
            .alias("low"),
            "high",
        )
    )


def min_max_weights(purchases: DataFrame) -> DataFrame:
    """Counts rescaled to 0..1 per product.

    The bounds are those of ``column_bounds``. They are found beside the counts, of which a product has one a customer,
    so that the counts are shuffled once by product and the weights are written product by product.
    """
    counts = save(purchase_counts(purchases), "counts")
    n_customers = counts.agg(F.count_distinct("cont_id")).scalar()
    own = Window.partitionBy("prod_name")
    cnt, low, high = (
        c.cast("double") for c in (F.col("cnt"), F.min("cnt").over(own), F.max("cnt").over(own))
    )
    least = F.when(F.count("*").over(own) == n_customers, low).otherwise(F.lit(0.0))
    weights = counts.select("cont_id", "prod_name", min_max(cnt, least, high).alias("weight"))
    return save(weights, "weights")


def quantity_weights(purchases: DataFrame, weight: str = "count_sq") -> DataFrame:
    """Item weights: ``count_sq`` sums the group size over the group's rows, ``count`` does not. Written once, as models
    read them many times."""
    cnt = F.col("cnt").cast("double")
    value = {"count_sq": cnt * cnt, "count": cnt}[weight]
    counts = purchase_counts(purchases, keep_nan=True)
    return save(counts.select("cont_id", "prod_name", value.alias("weight")), "weights")


def row_norms(weights: DataFrame, key: str = "cont_id") -> DataFrame:
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def wide_counts(counts: DataFrame, products) -> DataFrame:
    """Zero-filled columns for a short list of products, for display."""
    pivoted = counts.groupBy("cont_id").pivot("prod_name", list(products)).agg(F.sum("cnt"))
    return pivoted.na.fill(0, list(products))


def seed_products(weights: DataFrame) -> DataFrame:
    """Each customer's most bought product, the first by name among equals."""
    best = Window.partitionBy("cont_id").orderBy(F.desc("weight"), "prod_name")
    return (
        weights.withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= 1)
        .select("cont_id", "prod_name")
    )

"""Business rules over recommended products."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.schemas import CORE_CATEGORIES, EMPTY_SLOT, WIDER_CATEGORIES
from basketry.storage import save


def category_gate(recommended: DataFrame) -> DataFrame:
    """Keep the core categories where a customer has all three, otherwise accessories as well.

    The customers that have all three are counted on distinct pairs, which Spark combines before the shuffle, so a
    list of any length is never in one task.
    """
    rows = save(recommended, "recommended")
    core = F.col("category1").isin(*CORE_CATEGORIES)
    complete = (
        rows.filter(core)
        .groupBy(F.col("cont_id").alias("_customer"))
        .agg(F.count_distinct("category1").alias("_n"))
        .filter(F.col("_n") == len(CORE_CATEGORIES))
        .select("_customer")
    )
    joined = rows.filter(F.col("category1").isin(*WIDER_CATEGORIES)).join(
        complete, F.col("cont_id").eqNullSafe(F.col("_customer")), "left"
    )
    return joined.filter(core | F.col("_customer").isNull()).drop("_customer")


def _order(sort_by_category: bool):
    tail = ["rank", "prod_name", "model_id"]
    return [F.desc("category1"), *tail] if sort_by_category else tail


def first_per_group(
    recommended: DataFrame, group: str, n: int = 1, sort_by_category: bool = True
) -> DataFrame:
    """First ``n`` products per customer and group, in serving order."""
    order = Window.partitionBy("cont_id", group).orderBy(*_order(sort_by_category))
    return (
        recommended.withColumn("group_rank", F.row_number().over(order))
        .filter(F.col("group_rank") <= n)
    )


def first_rows(
    recommended: DataFrame, group: str, n: int = 3, sort_by_category: bool = True
) -> DataFrame:
    """First ``n`` purchase rows per customer and group: a product fills as many places as it has
    rows. Adds ``places``, the number of the n places this product takes."""
    order = (
        Window.partitionBy("cont_id", group)
        .orderBy(*_order(sort_by_category))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    taken = F.coalesce(F.sum("n_rows").over(order), F.lit(0))
    return (
        recommended.withColumn("_taken", taken)
        .filter(F.col("_taken") < n)
        .withColumn("places", F.least(F.col("n_rows"), n - F.col("_taken")))
        .drop("_taken")
    )


def unrolled(placed: DataFrame) -> DataFrame:
    """One row per place."""
    places = F.sequence(F.lit(1).cast("long"), F.col("places"))
    return placed.withColumn("place", F.explode(places))


def listed(recommended: DataFrame, sort_by_category: bool = True) -> DataFrame:
    """Number a customer's final list."""
    places = ["place"] if "place" in recommended.columns else []
    order = Window.partitionBy("cont_id").orderBy(*_order(sort_by_category), *places)
    return recommended.withColumn("position", F.row_number().over(order))


def wide_recommendations(
    ranked: DataFrame, customers: DataFrame, slots: int = 5, prefix: str = "recommendation_"
) -> DataFrame:
    """One row per customer with the first ``slots`` products, a blank where there is none."""
    first = ranked.filter(F.col("position") <= slots)
    columns = [
        F.max(F.when(F.col("position") == i, F.col("prod_name"))).alias(f"{prefix}{i}")
        for i in range(1, slots + 1)
    ]
    filled = customers.join(first.groupBy("cont_id").agg(*columns), "cont_id", "left")
    return filled.na.fill(EMPTY_SLOT, [f"{prefix}{i}" for i in range(1, slots + 1)])

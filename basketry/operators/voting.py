"""From neighbours to ranked products."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.positions import with_group_position
from basketry.operators.split import split_rows


def target_counts(purchases: DataFrame, orders: DataFrame) -> DataFrame:
    """How often each product stands in each customer's target orders."""
    return (
        split_rows(purchases, orders, "target")
        .groupBy(F.col("cont_id").alias("neighbor_id"), "prod_name")
        .agg(F.count("*").alias("cnt"))
    )


def votes(neighbors: DataFrame, targets: DataFrame, vote: str = "last") -> DataFrame:
    """Score every product that some neighbour has in its target.

    ``last``: the farthest neighbour having the product decides; ``sum``: their counts add up. What a customer's
    neighbours bought, k lists at most, is dealt out by the customer: few pairs repeat, so that summing up before the
    shuffle saves little, and the ranking of a customer's products needs no second one.
    """
    score = {"last": F.max_by("cnt", "neighbor_rank"), "sum": F.sum("cnt")}[vote]
    return (
        neighbors.select("cont_id", "neighbor_id", "neighbor_rank")
        .join(targets, "neighbor_id")
        .repartition("cont_id")
        .groupBy("cont_id", "prod_name")
        .agg(score.alias("score"), F.min("neighbor_rank").alias("first_rank"))
    )


def best_products(scored: DataFrame, num_recs: int = 5) -> DataFrame:
    """The ``num_recs`` best per customer: score, then nearest supporter, then name."""
    order = Window.partitionBy("cont_id").orderBy(F.desc("score"), "first_rank", "prod_name")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= num_recs)
        .select("cont_id", "prod_name", "score", "rank")
    )


def unseen_neighbors(
    seeds: DataFrame,
    item_neighbors: DataFrame,
    history: DataFrame,
    order: str = "name",
    num_recs: int | None = None,
) -> DataFrame:
    """Products near a customer's seeds that are not in the customer's history, ranked.

    ``order``: "name" ranks by product name, "distance" by the nearest seed. ``num_recs`` keeps the
    first so many of each customer, a limit that Spark applies before the shuffle. Without it, whole
    lists are numbered by a range sort, so one customer may own any share of the rows.
    """
    near = (
        seeds.join(item_neighbors, "prod_name")
        .groupBy("cont_id", F.col("neighbor_id").alias("prod_name"))
        .agg(F.min("dist").alias("dist"))
    )
    fresh = near.join(
        history.select("cont_id", "prod_name").distinct(), ["cont_id", "prod_name"], "left_anti"
    )
    keys = ["prod_name"] if order == "name" else ["dist", "prod_name"]
    if num_recs is None:
        ranked = with_group_position(fresh, ["cont_id"], keys, "rank")
    else:
        rank = F.row_number().over(Window.partitionBy("cont_id").orderBy(*keys))
        ranked = fresh.withColumn("rank", rank).filter(F.col("rank") <= num_recs)
    return ranked.select("cont_id", "prod_name", "dist", "rank")


def product_variants(purchases: DataFrame) -> DataFrame:
    """One row per distinct product description, with the number of purchase rows behind it."""
    return purchases.groupBy(
        "prod_name", "prod_family", "prod_subfamily", "category1", "category2", "CAT1", "model_id"
    ).agg(F.count("*").alias("n_rows"))


def recommended_variants(predictions: DataFrame, variants: DataFrame) -> DataFrame:
    """Predictions with their product descriptions.

    Every purchase row of a product carries the same description, so a row per description and the
    number of rows it stands for say all that later steps need, without a copy of each row per client.
    """
    return predictions.select("cont_id", "prod_name", "rank").join(variants, "prod_name")

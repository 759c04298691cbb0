"""Recommendations for every customer in one table."""

from pyspark.sql import DataFrame

from basketry.operators import ranking
from basketry.plans.recommend import gated


def all_recommendations(
    predictions: DataFrame,
    rows: DataFrame,
    customers: DataFrame,
    per_product: int = 1,
    prefix: str = "recommendation_",
) -> DataFrame:
    """Five places per customer, side by side, at most ``per_product`` rows of a product.

    With one row per product the five are different products. With more, a product that was bought
    often fills several places.
    """
    placed = ranking.first_rows(gated(predictions, rows), "prod_name", per_product)
    ranked = ranking.listed(ranking.unrolled(placed))
    return ranking.wide_recommendations(ranked, customers, prefix=prefix)

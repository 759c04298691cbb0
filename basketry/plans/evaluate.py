"""How many shown products customers had bought."""

from pyspark.sql import DataFrame

from basketry.operators import evaluation, ranking, split
from basketry.plans.recommend import gated
from basketry.sources.tables import without_suggestions


def evaluate_by_customers(
    predictions: DataFrame,
    rows: DataFrame,
    train: DataFrame,
    per_category: int = 3,
    relevant: str = "history",
    unit: str = "products",
) -> DataFrame:
    """Training customers; a shown product counts once (``unit="rows"``: every row does)."""
    mine = predictions.join(train, "cont_id", "left_semi")
    shown = ranking.first_rows(gated(mine, rows), "CAT1", per_category)
    wanted = rows if relevant == "history" else _targets(rows)
    wanted = wanted.join(train, "cont_id", "left_semi")
    return evaluation.hit_counts(shown, wanted, unit, unit)


def evaluate_by_products(
    predictions: DataFrame,
    rows: DataFrame,
    per_category: int = 3,
    relevant: str = "target",
    unit: str = "rows",
) -> DataFrame:
    """Every customer; hits and relevant products count by row (``unit="products"``: once each)."""
    shown = ranking.first_rows(gated(predictions, rows), "CAT1", per_category)
    wanted = _targets(rows) if relevant == "target" else rows
    return evaluation.hit_counts(shown, wanted, unit, unit)


def _targets(rows):
    own = without_suggestions(rows)
    return split.split_rows(own, split.split_orders(own), "target")

"""Recommendations for a set of customers: by similar customers or by similar products."""

from pyspark.sql import DataFrame

from basketry.operators import features, neighbors, ranking, split, voting
from basketry.operators.cleaning import exclude_words
from basketry.schemas import EXCLUDED_WORDS
from basketry.sources.tables import without_suggestions
from basketry.storage import save


def serving_rows(
    purchases: DataFrame, include_suggestions: bool = True, words=EXCLUDED_WORDS
) -> DataFrame:
    """The rows that models are made from."""
    rows = exclude_words(purchases, words)
    return rows if include_suggestions else without_suggestions(rows)


def by_customers(
    rows: DataFrame,
    clients: DataFrame | None = None,
    num_recs: int = 5,
    k: int = 10,
    min_orders: int = 1,
    metric: str = "cosine",
    vote: str = "last",
    features_from: str = "all",
    split_by: str = "id",
    include_self: bool = True,
) -> DataFrame:
    """Ranked products per customer: cont_id, prod_name, score, rank.

    Neighbours come from customers with at least ``min_orders`` orders. ``features_from="history"``
    describes them by their history alone, which keeps targets out of the features.
    """
    orders = split.split_orders(rows, split_by)
    nearest = customer_neighbors(rows, orders, clients, k, min_orders, metric, features_from, include_self)
    return from_neighbors(nearest, voting.target_counts(rows, orders), num_recs, vote)


def from_neighbors(nearest: DataFrame, targets: DataFrame, num_recs: int = 5, vote: str = "last") -> DataFrame:
    """Ranked products per customer, from neighbours that are known and what those bought later."""
    return voting.best_products(voting.votes(nearest, targets, vote), num_recs)


def customer_neighbors(
    rows: DataFrame,
    orders: DataFrame,
    clients: DataFrame | None = None,
    k: int = 10,
    min_orders: int = 1,
    metric: str = "cosine",
    features_from: str = "all",
    include_self: bool = True,
) -> DataFrame:
    """The k nearest customers: cont_id, neighbor_id, dist, neighbor_rank."""
    weights = features.min_max_weights(rows)
    base = weights
    train = split.train_customers(rows, min_orders) if min_orders > 1 else None
    if features_from == "history":
        # The bounds are those of the customers that take part.
        past = split.split_rows(rows, orders, "history")
        if train is not None:
            past = past.join(train, "cont_id", "left_semi")
        base = features.min_max_weights(past)
    elif train is not None:
        base = save(base.join(train, "cont_id", "left_semi"), "base")
    queries = None if base is weights else weights
    if clients is not None:
        queries = save(weights.join(clients, "cont_id", "left_semi"), "asked")
    return getattr(neighbors, f"{metric}_neighbors")(
        base, k=k, queries=queries, include_self=include_self
    )


def by_products(
    rows: DataFrame,
    clients: DataFrame | None = None,
    k: int = 10,
    weight: str = "count_sq",
    seed: str = "top1",
    order: str = "name",
    num_recs: int | None = None,
) -> DataFrame:
    """Unseen products nearest to what a customer bought: cont_id, prod_name, dist, rank.

    ``seed="top1"`` starts from the most bought product only, ``"all"`` from every bought product.
    ``num_recs`` keeps the first so many per customer; by default all are ranked.
    """
    weights = features.quantity_weights(rows, weight)
    mine = weights if clients is None else weights.join(clients, "cont_id", "left_semi")
    seeds = features.seed_products(mine) if seed == "top1" else mine.select("cont_id", "prod_name")
    asked = save(weights.join(seeds.select("prod_name").distinct(), "prod_name", "left_semi"), "asked")
    nearest = neighbors.cosine_neighbors(
        weights, k=k, queries=asked, id_col="prod_name", feature_col="cont_id"
    )
    past = split.split_rows(rows, split.split_orders(without_suggestions(rows)), "history")
    return voting.unseen_neighbors(seeds, nearest, past, order, num_recs)


def gated(predictions: DataFrame, rows: DataFrame) -> DataFrame:
    """Predictions with product descriptions, after the category gate."""
    variants = voting.product_variants(rows)
    return ranking.category_gate(voting.recommended_variants(predictions, variants))


def serve(predictions: DataFrame, rows: DataFrame, sort_by_category: bool = True) -> DataFrame:
    """What a customer is shown: the first product of each label, as a numbered list."""
    first = ranking.first_per_group(gated(predictions, rows), "CAT1", 1, sort_by_category)
    return ranking.listed(first, sort_by_category).select(
        "cont_id", "position", "CAT1", "category1", "prod_family", "prod_subfamily",
        "prod_name", "model_id",
    )

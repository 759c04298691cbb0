"""Customers of the model, and the history/target split of their orders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.cleaning import order_counts
from basketry.operators.positions import paged_lists, with_group_position


def customers(purchases: DataFrame) -> DataFrame:
    return purchases.select("cont_id").distinct()


def train_customers(purchases: DataFrame, min_orders: int = 1) -> DataFrame:
    counts = order_counts(purchases, "cont_id")
    return counts.filter(F.col("n_orders") >= min_orders).select("cont_id")


def held_out_customers(purchases: DataFrame, min_orders: int = 1) -> DataFrame:
    return customers(purchases).join(
        train_customers(purchases, min_orders), "cont_id", "left_anti"
    )


def set_sizes(purchases: DataFrame, min_orders: int = 1) -> DataFrame:
    """How many customers there are in all, in training, and in test."""
    is_train = F.col("n_orders") >= min_orders
    return order_counts(purchases, "cont_id").agg(
        F.count("*").alias("n_all"),
        F.count_if(is_train).alias("n_train"),
        F.count_if(~is_train).alias("n_test"),
    )


def random_customer(purchases: DataFrame, seed: int = 42) -> DataFrame:
    """One customer, drawn by the order of seeded digests, so that a seed always gives the same."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "cont_id"))
    return customers(purchases).orderBy(draw, "cont_id").limit(1)


def split_orders(purchases: DataFrame, by: str = "id") -> DataFrame:
    """Number each customer's orders; the first two thirds are history, the rest target.

    ``by``: "id" sorts orders by id, "date" by their first date and then id.
    """
    if by == "date":
        orders = purchases.groupBy("cont_id", "transaction_id").agg(
            F.min("transaction_date").alias("order_date")
        )
        order = ["order_date", "transaction_id"]
    else:
        orders = purchases.select("cont_id", "transaction_id").distinct()
        order = ["transaction_id"]
    numbered = with_group_position(orders, ["cont_id"], order, "order_no", "n_orders")
    in_history = F.col("order_no") <= F.expr("(2 * n_orders) div 3")
    return numbered.select(
        "cont_id",
        "transaction_id",
        "order_no",
        "n_orders",
        F.when(in_history, "history").otherwise("target").alias("part"),
    )


def split_rows(purchases: DataFrame, orders: DataFrame, part: str) -> DataFrame:
    """Purchase rows of one part of the split, always within the customer."""
    wanted = orders.filter(F.col("part") == part).select("cont_id", "transaction_id")
    return purchases.join(wanted, ["cont_id", "transaction_id"], "left_semi")


def product_lists(purchases: DataFrame, orders: DataFrame, page_size: int = 1000) -> DataFrame:
    """History and target product names per customer as lists, repeats included."""
    rows = purchases.join(
        orders.select("cont_id", "transaction_id", "part", "order_no"),
        ["cont_id", "transaction_id"],
    )
    return paged_lists(
        rows, ["cont_id", "part"], "prod_name", ["order_no", "prod_name"], page_size, "products"
    )

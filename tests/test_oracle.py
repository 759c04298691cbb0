"""Queries against the same in SQL, at the smallest scale; verification.compare runs them all."""

import os

import pytest

from verification.compare import compare, database
from verification.oracle import ORACLE
from verification.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "dedupe_rows", "ingest_purchases", "ingest_menu", "order_split", "user_knn_neighbors",
    "item_knn_neighbors", "euclid_knn_neighbors", "user_knn_by_family", "recommend_user",
    "recommend_item", "all_recos_wide", "eval_user", "eval_item", "feedback_rows",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", CHOSEN)
def test_equal_to_sql(spark, name):
    assert compare(spark, database(FOLDER), FOLDER, name) is None


# Rows left after each cleaning step, counted on the tables independently.
@pytest.mark.parametrize(
    "name, count",
    [
        ("scan_purchases_csv", 6000), ("active_customers", 5765), ("supported_products", 4733),
        ("recent_products", 3949), ("dedupe_rows", 3909), ("ingest_purchases", 3460),
        ("without_feedback", 2206),
    ],
)
def test_row_counts(spark, name, count):
    assert QUERIES[name](spark, FOLDER).count() == count


def test_item_evaluation_with_feedback_equals_sql(spark):
    assert compare(spark, database(FOLDER), FOLDER, "eval_item_with_feedback") is None

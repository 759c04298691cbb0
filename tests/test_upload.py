"""One plan for both tables of an upload, against the two made apart."""

import datetime
import random

from basketry.plans import ingest
from basketry.schemas import CATEGORY_KEYS, RAW_PURCHASES

OLD, NEW = datetime.datetime(2014, 1, 1), datetime.datetime(2016, 1, 1)


def bag(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_both_tables_equal_those_made_apart(rows):
    rng, data = random.Random(2), []
    for i in range(1500):
        family, subfamily = rng.choice(["F", "G", None]), rng.choice(["S", "T", None, None])
        name = rng.choice([f"p{rng.randrange(12)}", "SERVICES", None])
        when = rng.choice([OLD, NEW]) if name not in ("p1", "p2") else OLD
        customer = rng.choice([f"c{rng.randrange(60)}", None])
        data.append((customer, f"t{rng.randrange(400)}", when, str(i % 3), family, subfamily, name))
    raw = rows(data + data[:50], RAW_PURCHASES)
    categories = rows(
        [("F", "S", "L", "L/1"), ("F", "T", "D", "D/1"), ("G", "S", "A", "A/1")],
        ", ".join(f"{c} string" for c in [*CATEGORY_KEYS, "category1", "category2"]),
    )
    sizes = []
    for customers, products in ((1, 1), (10, 33), (14, 40), (99, 1)):
        limits = {"min_customer_orders": customers, "min_product_orders": products}
        purchases, menu = ingest.upload(raw, categories, **limits)
        assert bag(purchases) == bag(ingest.purchase_table(raw, categories, **limits))
        assert bag(menu) == bag(ingest.menu_table(raw, categories, **limits))
        sizes.append((purchases.count(), menu.count()))
    assert sizes[0][0] > 20 and sizes[0][1] > 0 and sizes[-1] == (0, 0)


def test_an_empty_log(rows):
    categories = rows([], "prod_family string, prod_subfamily string, category1 string, category2 string")
    purchases, menu = ingest.upload(rows([], RAW_PURCHASES), categories)
    assert purchases.count() == 0 and menu.count() == 0


def test_product_thresholds_are_worked_out_once(spark):
    """The rows that sell are read twice; neither reading counts the products' orders again."""
    raw = spark.createDataFrame(
        [("c1", f"t{i}", datetime.datetime(2024, 1, 1), "p", "F", "S", name) for i in range(3) for name in ("A", "B")]
        + [("c1", "t0", datetime.datetime(2024, 1, 1), "p", "F", "S", "C")],
        RAW_PURCHASES,
    )
    rows = ingest._selling(raw, min_customer_orders=1, min_product_orders=2, cutoff="2020-01-01")
    assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.prod_name for r in rows.collect()) == ["A"] * 3 + ["B"] * 3

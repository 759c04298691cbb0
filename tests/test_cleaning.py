import datetime

import pytest

from basketry.operators import catalog, cleaning
from basketry.plans import ingest

RAW = """cont_id string, transaction_id string, transaction_date timestamp_ntz, prod_id string,
         prod_family string, prod_subfamily string, prod_name string"""
CATS = "category1 string, category2 string, prod_family string, prod_subfamily string"
DAY = datetime.datetime


def purchase(client, order, name, family="F", sub="S", day=DAY(2016, 1, 1)):
    return (client, order, day, "1", family, sub, name)


def regular(client, orders, name, **kw):
    return [purchase(client, f"{client}-{name}-{i}", name, **kw) for i in range(orders)]


@pytest.fixture
def cats(rows):
    return rows([("L", "L/1", "F", "S"), ("A", "A/1", "F", "."), ("D", "D/1", "G", "S")], CATS)


def names(df):
    return sorted({r.prod_name for r in df.collect()}, key=str)


def test_word_filter_ignores_case_and_drops_null(rows):
    data = [purchase("c", "t", n) for n in ("Spare part", "Customer SERVICE", None, "sofa", "nano")]
    assert names(cleaning.exclude_words(rows(data, RAW))) == ["nano", "sofa"]


def test_value_filter_keeps_null(rows):
    data = [purchase("c", "t", n) for n in ("SERVICES", None, "services")]
    assert names(cleaning.exclude_value(rows(data, RAW))) == [None, "services"]


def test_active_customer_threshold(rows):
    data = regular("five", 5, "p") + regular("six", 6, "p") + [purchase("five", "five-p-0", "q")]
    kept = cleaning.keep_active_customers(rows(data, RAW), 6)
    assert {r.cont_id for r in kept.collect()} == {"six"}


def test_support_is_counted_after_the_customer_filter(rows):
    data = regular("c1", 6, "p") + regular("c2", 3, "q") + regular("c1", 2, "q")
    kept = ingest.clean(rows(data, RAW), 6, 3, "2015-04-23")
    assert names(kept) == ["p"]


def test_recency_uses_the_newest_sale_and_excludes_the_cutoff_day(rows):
    cut, after, old = DAY(2015, 4, 23), DAY(2015, 4, 24), DAY(2014, 1, 1)
    data = [
        purchase("c", "t1", "on", day=cut),
        purchase("c", "t2", "after", day=after),
        purchase("c", "t3", "newest first", day=after),
        purchase("c", "t4", "newest first", day=old),
    ]
    assert names(cleaning.keep_recent_products(rows(data, RAW))) == ["after", "newest first"]


def test_combined_product_filter_equals_the_two_in_sequence(rows):
    data = (
        regular("c", 4, "many new") + regular("c", 2, "few new")
        + regular("c", 4, "many old", day=DAY(2014, 1, 1))
    )
    df = rows(data, RAW)
    in_sequence = cleaning.keep_recent_products(cleaning.keep_supported_products(df, 3))
    assert names(cleaning.keep_selling_products(df, 3)) == names(in_sequence) == ["many new"]


def test_ingest_covers_every_reason_to_leave(rows, cats):
    data = (
        regular("c", 6, "sofa") + regular("c", 6, "nan table", sub=".")
        + regular("c", 6, "no family", family=None) + regular("c", 6, "no sub", sub=None)
        + regular("c", 6, None) + regular("c", 6, "SERVICES")
        + regular("c", 6, "unmapped", family="Z") + [purchase("c", "c-sofa-0", "sofa")]
    )
    got = ingest.purchase_table(rows(data, RAW), cats, min_product_orders=6).collect()
    assert len(got) == 12  # the copy is gone
    by_name = {r.prod_name: (r.model_id, r.category1, r.category2, r.CAT1) for r in got}
    assert by_name == {
        "nan table": (1, "A", "A/1", "ACCESSORIES"),
        "sofa": (2, "L", "L/1", "LIVING ROOM"),
    }


def test_menu_filters_nulls_before_the_thresholds(rows, cats):
    # Two of the six orders have no subfamily: enough for the purchase table, not for the menu.
    data = regular("c", 4, "sofa") + [purchase("c", f"n{i}", "sofa", sub=None) for i in range(2)]
    df = rows(data, RAW)
    assert ingest.purchase_table(df, cats, min_product_orders=1).count() == 4
    assert ingest.menu_table(df, cats, min_product_orders=1).count() == 0


def test_menu_takes_the_earliest_hierarchy(rows, cats):
    data = regular("c", 6, "sofa", family="G") + [
        purchase("c", "first", "sofa", day=DAY(2010, 1, 1))
    ]
    menu = ingest.menu_table(rows(data, RAW), cats, min_product_orders=1).collect()
    assert [tuple(r) for r in menu] == [("LIVING ROOM", "F", "S", "sofa")]


def test_unknown_category_code_has_no_label(rows):
    got = catalog.with_label(rows([("L",), ("Q",)], "category1 string")).collect()
    assert {r.category1: r.CAT1 for r in got} == {"L": "LIVING ROOM", "Q": None}


def test_repeated_category_key_does_not_multiply_rows(rows):
    cats = rows([("A", "A/1", "F", "S"), ("L", "L/1", "F", "S")], CATS)
    got = catalog.categorise(rows([purchase("c", "t", "p")], RAW), cats)
    assert got.count() == 1

"""Stored models, and neighbour lists brought up to date, against models fitted anew."""

import random

import pytest

from basketry.operators import features, neighbors, split
from basketry.plans import model_store, recommend

SCHEMA = "cont_id string, transaction_id string, transaction_date timestamp, prod_name string"


def log(seed, customers=40, products=25):
    rng = random.Random(seed)
    out = []
    for c in range(customers):
        for t in range(rng.randint(1, 5)):
            for p in {int(rng.paretovariate(0.7)) % products for _ in range(rng.randint(1, 4))}:
                out.append((f"c{c:02}", f"t{c}-{t}", None, f"p{p:02}"))
    return out


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def product_lists(weights, k=4):
    return neighbors.cosine_neighbors(weights, k=k, id_col="prod_name", feature_col="cont_id")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refitted_lists_are_those_of_a_rebuild(rows, seed):
    rng, before = random.Random(seed), log(seed)
    # Rows are added, for known and new products and customers, and others go, a whole product with them.
    gone = f"p{rng.randrange(25):02}"
    after = [r for r in before if r[3] != gone and rng.random() > 0.02]
    after += [("c99", "new", None, "p01"), ("c03", "new", None, "p77"), ("c03", "new", None, "p02")]
    old, new = (features.quantity_weights(rows(data, SCHEMA)) for data in (before, after))
    changed = model_store.changed_products(old, new)
    got = neighbors.refitted(product_lists(old), changed, new, 4, "prod_name", "cont_id")
    assert bag(got.select("prod_name", "neighbor_id", "dist", "neighbor_rank")) == bag(
        product_lists(new).select("prod_name", "neighbor_id", "dist", "neighbor_rank")
    )


def test_nothing_changed_renews_nothing(rows):
    weights = features.quantity_weights(rows(log(4), SCHEMA))
    changed = model_store.changed_products(weights, weights)
    assert changed.count() == 0
    lists = product_lists(weights)
    assert neighbors.renewed(lists, changed, "prod_name").count() == 0
    assert bag(neighbors.refitted(lists, changed, weights, 4, "prod_name", "cont_id")) == bag(lists)


def test_a_stored_model_compares_nothing(spark, rows, tmp_path):
    data = rows(log(5), SCHEMA)
    store = model_store.ModelStore(spark, str(tmp_path))
    with pytest.raises(model_store.StaleModel):
        store.customers(data)
    want = bag(recommend.by_customers(data))
    assert bag(store.customers(data, refit=True).recommend()) == want
    model = store.customers(data)
    assert bag(model.recommend()) == want
    plan = model.recommend()._jdf.queryExecution().optimizedPlan().toString()
    # One join, of lists and targets on the neighbour; products are only grouped by.
    assert plan.count("Join ") == 1 and "neighbor_id" in plan.split("Join ")[1].split("\n")[0]
    one = spark.createDataFrame([("c03",), ("c03",), ("none",)], "cont_id string")
    assert bag(model.recommend(one)) == [r for r in want if r[0] == "c03"]


def test_a_changed_log_or_parameter_is_refused_or_refitted(spark, rows, tmp_path):
    data = rows(log(6), SCHEMA)
    store = model_store.ModelStore(spark, str(tmp_path))
    store.customers(data, refit=True)
    shuffled = rows(random.Random(1).sample(log(6), len(log(6))), SCHEMA).select(*reversed(data.columns))
    assert store.customers(shuffled).neighbors.count() > 0
    more = rows(log(6) + log(6)[:1], SCHEMA)
    for other, params in ((more, {}), (data, {"k": 3}), (data, {"split_by": "date"})):
        with pytest.raises(model_store.StaleModel):
            store.customers(other, **params)
    assert bag(store.customers(data, refit=True, k=3).recommend()) == bag(recommend.by_customers(data, k=3))


def test_products_from_the_store(spark, rows, tmp_path):
    data = rows(log(7), SCHEMA)
    store = model_store.ModelStore(spark, str(tmp_path))
    model = store.products(data, refit=True)
    assert bag(model.recommend()) == bag(recommend.by_products(data))
    fed = rows(log(7) + [("c01", "suggestion", None, "p03"), ("c02", "suggestion", None, "p09")], SCHEMA)
    after = store.products_after(model, fed)
    assert bag(after.recommend(seed="all", order="distance", num_recs=3)) == bag(
        recommend.by_products(fed, seed="all", order="distance", num_recs=3)
    )
    assert bag(store.products(fed).recommend()) == bag(after.recommend())


def test_a_model_that_was_broken_off_is_none(spark, rows, tmp_path):
    data = rows(log(8), SCHEMA)
    store = model_store.ModelStore(spark, str(tmp_path))
    orders = split.split_orders(data)
    folder = store._folder("customers", data, split_by="id")
    recommend.customer_neighbors(data, orders).write.parquet(f"{folder}/neighbors")
    with pytest.raises(model_store.StaleModel):
        store.customers(data)
    assert store.customers(data, refit=True).targets.count() > 0


def test_models_search_written_tables(spark, rows, tmp_path, monkeypatch):
    """Weights and the parts of them that are searched after feedback are read often, so each is written once."""
    seen, prepare = [], neighbors._prepare

    def noted(metric, base, queries, *args):
        seen.extend(side for side in (base, queries) if side is not None)
        return prepare(metric, base, queries, *args)

    monkeypatch.setattr(neighbors, "_prepare", noted)
    store = model_store.ModelStore(spark, str(tmp_path))
    before = store.products(rows(log(9), SCHEMA), refit=True, k=3)
    store.products_after(before, rows(log(9)[:-3], SCHEMA), k=3)
    assert len(seen) == 5
    for side in seen:
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan

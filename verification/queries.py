"""Every operator and plan as a query over the driver's tables. See ``oracle`` for the same in SQL."""

from pyspark.sql import functions as F

from basketry.operators import (
    catalog,
    cleaning,
    evaluation,
    features,
    feedback,
    menu,
    neighbors,
    ranking,
    split,
    voting,
)
from basketry.plans import batch, evaluate, ingest, model_store, recommend
from basketry.sources import files, star_schema, tables
from basketry.storage import new_path, save

THRESHOLDS = {
    "min_customer_orders": star_schema.MIN_CUSTOMER_ORDERS,
    "min_product_orders": star_schema.MIN_PRODUCT_ORDERS,
    "cutoff": star_schema.CUTOFF,
}
NOW = "2024-06-01 12:00:00"
SPLIT_MIN_ORDERS = 8

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _raw(spark, d):
    return star_schema.purchases(spark, d)


def _active(spark, d):
    return cleaning.keep_active_customers(_raw(spark, d), star_schema.MIN_CUSTOMER_ORDERS)


def _supported(spark, d):
    return cleaning.keep_supported_products(_active(spark, d), star_schema.MIN_PRODUCT_ORDERS)


def _kept_raw(spark, d):
    """The raw log, which ingest reads for the customers' orders and again for the rows: joined once."""
    return save(_raw(spark, d), "raw")


def _named_raw(spark, d):
    """What neighbours are made from of the raw log, which they read for orders, histories and counts: joined once."""
    return save(_raw(spark, d).select("cont_id", "transaction_id", "prod_name"), "raw")


def _inbox(spark, d, raw=None):
    raw = raw or _kept_raw(spark, d)
    return ingest.purchase_table(raw, star_schema.categories(spark, d), **THRESHOLDS)


def _rows(spark, d, raw=None):
    """Serving rows without suggestions, kept since every plan below reads them several times."""
    rows = recommend.serving_rows(_inbox(spark, d, raw), words=star_schema.EXCLUDED_WORDS)
    return save(rows, "serving")


def _suggestions(spark, d, rows):
    return feedback.suggestion_rows(star_schema.feedback_requests(spark, d), rows, NOW)


def _with_feedback(spark, d, rows):
    return save(tables.with_suggestions(rows, _suggestions(spark, d, rows)), "with_feedback")


def _user_picks(spark, d, num_recs=5, **options):
    rows = _rows(spark, d)
    return recommend.by_customers(rows, num_recs=num_recs, **options), rows


def _item_picks(spark, d, **options):
    rows = _rows(spark, d)
    return recommend.by_products(rows, **options), rows


def _kept(picks):
    predictions, rows = picks
    return save(predictions, "predictions"), rows


def _votes(spark, d, vote):
    rows = _rows(spark, d)
    nearest = neighbors.cosine_neighbors(features.min_max_weights(rows))
    targets = voting.target_counts(rows, split.split_orders(rows))
    return voting.best_products(voting.votes(nearest, targets, vote), 10)


def _joined(column):
    return F.array_join(column, "|")


# Sources and sinks


@query
def scan_purchases_csv(spark, d):
    path = new_path(spark, "purchases_csv")
    files.write_csv(_raw(spark, d), path)
    return files.read_purchases_csv(spark, path)


@query
def scan_categories_csv(spark, d):
    path = new_path(spark, "categories_csv")
    source = star_schema.categories(spark, d)
    files.write_csv(
        source.withColumnsRenamed(
            {"prod_family": "famille_intitule", "prod_subfamily": "sous_famille_intitule"}
        ),
        path,
    )
    return files.read_categories_csv(spark, path)


@query
def purchases_table_scan(spark, d):
    data = tables.Dataset(spark, new_path(spark, "dataset"))
    raw, cats = save(_raw(spark, d), "raw"), star_schema.categories(spark, d)
    data.create(
        ingest.purchase_table(raw, cats, **THRESHOLDS), ingest.menu_table(raw, cats, **THRESHOLDS)
    )
    return data.purchases()


@query
def menu_table_scan(spark, d):
    """Creates a data set, replaces it under other thresholds, and reads the menu."""
    data = tables.Dataset(spark, new_path(spark, "dataset"))
    # Read by three tables and written twice: joined once.
    raw, cats = save(_raw(spark, d), "raw"), star_schema.categories(spark, d)
    inbox = save(ingest.purchase_table(raw, cats, **THRESHOLDS), "inbox")
    data.create(inbox, ingest.menu_table(raw, cats, **{**THRESHOLDS, "min_product_orders": 30}))
    data.replace(inbox, ingest.menu_table(raw, cats, **THRESHOLDS))
    return data.menu()


@query
def all_recos_csv(spark, d):
    path = new_path(spark, "all_recos_csv")
    files.write_csv(all_recos_wide(spark, d), path)
    return files.read_recommendations_csv(spark, path)


@query
def dated_csv_export(spark, d):
    folder = new_path(spark, "export")
    path = files.export_dated_csv(
        ingest.menu_table(_raw(spark, d), star_schema.categories(spark, d), **THRESHOLDS),
        folder, "2024-06-01",
    )
    rows = spark.read.option("header", True).schema(
        "CAT1 string, prod_family string, prod_subfamily string, prod_name string"
    ).csv(path)
    folder_name = F.element_at(F.split(F.url_decode(F.input_file_name()), "/"), -2)
    return rows.withColumn("file_name", folder_name)


# Cleaning


@query
def clean_exclude_text(spark, d):
    return cleaning.exclude_words(_raw(spark, d), star_schema.EXCLUDED_WORDS)


@query
def clean_exclude_exact(spark, d):
    return cleaning.exclude_value(_raw(spark, d), "STANDARD", "prod_subfamily")


@query
def drop_missing_rows(spark, d):
    subfamily = F.when(F.col("prod_subfamily") != "STANDARD", F.col("prod_subfamily"))
    raw = _raw(spark, d).withColumn("prod_subfamily", subfamily)
    return cleaning.drop_missing(raw, ["prod_family", "prod_subfamily", "prod_name"])


@query
def active_customers(spark, d):
    return _active(spark, d)


@query
def supported_products(spark, d):
    return _supported(spark, d)


@query
def recent_products(spark, d):
    return cleaning.keep_recent_products(_supported(spark, d), star_schema.CUTOFF)


@query
def last_sale_dates(spark, d):
    return cleaning.last_sales(_raw(spark, d))


@query
def order_counts(spark, d):
    return cleaning.order_counts(_raw(spark, d), "prod_name")


@query
def dedupe_rows(spark, d):
    return ingest.clean(_raw(spark, d), **THRESHOLDS)


# Catalogue and ingest


@query
def categorize(spark, d):
    return catalog.categorise(_raw(spark, d), star_schema.categories(spark, d))


@query
def drop_uncategorized(spark, d):
    return catalog.drop_uncategorised(categorize(spark, d))


@query
def category_labels(spark, d):
    return catalog.with_label(categorize(spark, d)).select("prod_name", "category1", "CAT1").distinct()


@query
def model_ids(spark, d):
    return catalog.model_ids(_raw(spark, d))


@query
def first_hierarchy(spark, d):
    return catalog.first_hierarchy(_raw(spark, d))


@query
def ingest_purchases(spark, d):
    return _inbox(spark, d)


@query
def ingest_menu(spark, d, raw=None):
    return ingest.menu_table(raw or _raw(spark, d), star_schema.categories(spark, d), **THRESHOLDS)


@query
def upload_purchases(spark, d):
    """The purchase table of the plan that makes both tables."""
    return ingest.upload(_raw(spark, d), star_schema.categories(spark, d), **THRESHOLDS)[0]


@query
def upload_menu(spark, d):
    """The menu of the plan that makes both tables."""
    return ingest.upload(_raw(spark, d), star_schema.categories(spark, d), **THRESHOLDS)[1]


# Menu, history, lookup


@query
def menu_by_subfamily(spark, d):
    lists = menu.products_by_subfamily(ingest_menu(spark, d), page_size=20)
    return lists.withColumn("prod_names", _joined("prod_names"))


@query
def menu_by_family(spark, d):
    lists = menu.subfamilies_by_family(ingest_menu(spark, d))
    return lists.withColumn("prod_subfamilies", _joined("prod_subfamilies"))


@query
def menu_head(spark, d):
    return menu.menu_head(ingest_menu(spark, d))


@query
def customer_history(spark, d):
    """History pages of every client who sent a suggestion, suggestions included."""
    rows = _rows(spark, d)
    clients = star_schema.feedback_requests(spark, d).select(F.col("client_id").alias("cont_id"))
    return menu.history_page(_with_feedback(spark, d, rows), clients)


@query
def product_lookup(spark, d):
    rows = _rows(spark, d)
    asked = _suggestions(spark, d, rows).select("model_id")
    return feedback.products_by_model(rows, asked)


# Features and split


@query
def purchase_counts(spark, d):
    return features.purchase_counts(_raw(spark, d))


@query
def item_qty(spark, d):
    return features.with_quantity(_raw(spark, d))


@query
def item_weights(spark, d):
    return features.quantity_weights(_raw(spark, d))


@query
def column_min_max(spark, d):
    return features.column_bounds(features.purchase_counts(_raw(spark, d)))


@query
def minmax_features(spark, d):
    return features.min_max_weights(_raw(spark, d))


@query
def row_norms(spark, d):
    norms = features.row_norms(features.min_max_weights(_raw(spark, d)))
    return norms.withColumn("norm", F.round("norm", 8))


@query
def seed_products(spark, d):
    return features.seed_products(features.quantity_weights(_raw(spark, d)))


@query
def wide_counts(spark, d):
    """Counts per customer and product family, one column for each of the 25 families."""
    rows = _raw(spark, d).withColumn("prod_name", F.col("prod_family"))
    names = [f"Brand#{i}" for i in range(1, 26)]
    return features.wide_counts(features.purchase_counts(rows), names)


@query
def order_split(spark, d):
    return split.split_orders(_raw(spark, d))


@query
def order_split_by_date(spark, d):
    return split.split_orders(_raw(spark, d), by="date")


@query
def split_lists(spark, d):
    raw = _raw(spark, d)
    lists = split.product_lists(raw, split.split_orders(raw), page_size=50)
    return lists.withColumn("products", _joined("products"))


@query
def train_customers(spark, d):
    return split.train_customers(_raw(spark, d), SPLIT_MIN_ORDERS)


@query
def test_customers(spark, d):
    return split.held_out_customers(_raw(spark, d), SPLIT_MIN_ORDERS)


@query
def set_sizes(spark, d):
    return split.set_sizes(_raw(spark, d), SPLIT_MIN_ORDERS)


@query
def random_customer(spark, d):
    return split.random_customer(_raw(spark, d), seed=42)


# Neighbours, over the whole unfiltered log


@query
def user_knn_neighbors(spark, d):
    return neighbors.cosine_neighbors(features.min_max_weights(_raw(spark, d)))


@query
def item_knn_neighbors(spark, d):
    return neighbors.cosine_neighbors(
        features.quantity_weights(_raw(spark, d)), id_col="prod_name", feature_col="cont_id"
    )


@query
def euclid_knn_neighbors(spark, d):
    return neighbors.euclidean_neighbors(features.min_max_weights(_raw(spark, d)))


@query
def user_knn_by_family(spark, d):
    """Customers by product family: a few features that nearly everybody has."""
    rows = _raw(spark, d).withColumn("prod_name", F.col("prod_family"))
    return neighbors.cosine_neighbors(features.min_max_weights(rows), hot_degree=100)


@query
def user_knn_by_family_pivots(spark, d):
    """The same by the metric partition, which larger data would use."""
    rows = _raw(spark, d).withColumn("prod_name", F.col("prod_family"))
    return neighbors.cosine_neighbors(features.min_max_weights(rows), hot_degree=100, by="features")


@query
def user_knn_joined(spark, d):
    """Neighbours by joins on the products, which larger data would use."""
    return neighbors.cosine_neighbors(features.min_max_weights(_raw(spark, d)), by="features")


@query
def user_knn_history_without_self(spark, d):
    """Customers against the histories of the others."""
    raw = _named_raw(spark, d)
    past = split.split_rows(raw, split.split_orders(raw), "history")
    return neighbors.cosine_neighbors(
        features.min_max_weights(past), queries=features.min_max_weights(raw), include_self=False
    )


# Recommendations, over the ingested and cleaned log


@query
def vote_last(spark, d):
    return _votes(spark, d, "last")


@query
def vote_sum(spark, d):
    return _votes(spark, d, "sum")


@query
def target_counts(spark, d):
    raw = _raw(spark, d)
    return voting.target_counts(raw, split.split_orders(raw))


@query
def recommendation_products(spark, d):
    predictions, rows = _user_picks(spark, d)
    return voting.recommended_variants(predictions, voting.product_variants(rows))


@query
def recommend_user(spark, d):
    return recommend.serve(*_user_picks(spark, d))


@query
def recommend_user_unsorted(spark, d):
    return recommend.serve(*_user_picks(spark, d), sort_by_category=False)


@query
def recommend_user_with_feedback(spark, d):
    rows = _with_feedback(spark, d, _rows(spark, d))
    return recommend.serve(recommend.by_customers(rows), rows)


@query
def recommend_item_with_feedback(spark, d):
    return recommend.by_products(_with_feedback(spark, d, _rows(spark, d)))


@query
def eval_user_with_feedback(spark, d):
    rows = _with_feedback(spark, d, _rows(spark, d))
    predictions = save(recommend.by_customers(rows), "predictions")
    return evaluate.evaluate_by_customers(predictions, rows, split.train_customers(rows, 1))


@query
def eval_item_with_feedback(spark, d):
    rows = _with_feedback(spark, d, _rows(spark, d))
    predictions = save(recommend.by_products(rows), "predictions")
    return evaluate.evaluate_by_products(predictions, rows)


@query
def recommend_euclid(spark, d):
    """The older variant: Euclidean, described by history, summed votes, ten products."""
    return recommend.by_customers(
        _rows(spark, d), num_recs=10, metric="euclidean", vote="sum", features_from="history",
        min_orders=5,
    )


@query
def recommend_item(spark, d):
    predictions, _ = _item_picks(spark, d)
    return predictions


@query
def recommend_item_all_seeds(spark, d):
    predictions, _ = _item_picks(spark, d, seed="all", order="distance", weight="count")
    return predictions


@query
def serve_item(spark, d):
    return recommend.serve(*_item_picks(spark, d))


@query
def category_gate(spark, d):
    return recommend.gated(*_user_picks(spark, d, num_recs=8)).select(
        "cont_id", "prod_name", "category1", "CAT1", "rank"
    )


@query
def top_per_category(spark, d):
    shown = ranking.first_rows(recommend.gated(*_user_picks(spark, d)), "CAT1", 3)
    return shown.select("cont_id", "CAT1", "prod_name", "rank", "places")


@query
def top_per_product(spark, d):
    first = ranking.first_per_group(recommend.gated(*_user_picks(spark, d, num_recs=8)), "prod_name")
    return ranking.listed(first).select("cont_id", "prod_name", "position")


@query
def all_recos_wide(spark, d):
    predictions, rows = _user_picks(spark, d, num_recs=8)
    return batch.all_recommendations(predictions, rows, split.customers(rows))


@query
def all_recos_wide_item(spark, d):
    predictions, rows = _item_picks(spark, d)
    return batch.all_recommendations(
        predictions, rows, split.customers(rows), per_product=5, prefix="prod_name"
    )


@query
def all_recos_item_csv(spark, d):
    """The item variant's table with its own column names, written as CSV and read back."""
    path = new_path(spark, "recos")
    files.write_csv(all_recos_wide_item(spark, d), path)
    return files.read_recommendations_csv(spark, path, prefix="prod_name")


@query
def eval_user(spark, d):
    predictions, rows = _kept(_user_picks(spark, d))
    return evaluate.evaluate_by_customers(predictions, rows, split.train_customers(rows, 1))


@query
def eval_item(spark, d):
    predictions, rows = _kept(_item_picks(spark, d))
    return evaluate.evaluate_by_products(predictions, rows)


@query
def hit_counts(spark, d):
    """Each customer's target orders held against the history, by row."""
    raw = _raw(spark, d)
    orders = save(split.split_orders(raw), "orders")
    past = split.split_rows(raw, orders, "history").withColumn("places", F.lit(1).cast("long"))
    return evaluation.hit_counts(past, split.split_rows(raw, orders, "target"), "rows", "rows")


# Stored models


@query
def recommend_user_stored(spark, d):
    """Fitted into a store, then read from it for all customers."""
    rows = _rows(spark, d)
    store = model_store.ModelStore(spark, new_path(spark, "models"))
    store.customers(rows, refit=True)
    return store.customers(rows).recommend()


def _product_models(spark, d):
    """The stored model before feedback, and the same brought up to date with it."""
    rows = _rows(spark, d)
    fed = _with_feedback(spark, d, rows)
    store = model_store.ModelStore(spark, new_path(spark, "models"))
    before = store.products(rows, refit=True)
    return before, store.products_after(before, fed)


@query
def refit_delta(spark, d):
    """Product neighbours after feedback, of which only those are worked out anew that can change."""
    return _product_models(spark, d)[1].neighbors


@query
def refit_affected(spark, d):
    """How many products feedback changes, and how many neighbour lists that makes anew."""
    before, after = _product_models(spark, d)
    changed = save(model_store.changed_products(before.weights, after.weights), "changed")
    stale = neighbors.renewed(before.neighbors, changed, "prod_name")
    return stale.agg(F.count("*").alias("n_renewed")).select(
        changed.agg(F.count("*")).scalar().alias("n_changed"), "n_renewed"
    )


@query
def recommend_item_refitted(spark, d):
    """Recommendations by the product model after feedback, for all customers."""
    return _product_models(spark, d)[1].recommend()


# Feedback


@query
def feedback_rows(spark, d):
    return _suggestions(spark, d, _rows(spark, d))


@query
def feedback_rows_weighted(spark, d):
    requests = star_schema.feedback_requests(spark, d)
    return feedback.suggestion_rows(requests, _rows(spark, d), NOW, weighted=True)


@query
def feedback_unknown_names(spark, d):
    return feedback.unknown_names(star_schema.feedback_requests(spark, d), _rows(spark, d))


@query
def purchases_with_feedback(spark, d):
    data = tables.Dataset(spark, new_path(spark, "dataset"))
    raw = _kept_raw(spark, d)
    rows = _rows(spark, d, raw)
    data.create(rows, ingest_menu(spark, d, raw))
    data.append_suggestions(_suggestions(spark, d, rows))
    return data.purchases()


@query
def reset_feedback(spark, d):
    data = tables.Dataset(spark, new_path(spark, "dataset"))
    raw = _kept_raw(spark, d)
    rows = _rows(spark, d, raw)
    data.create(rows, ingest_menu(spark, d, raw))
    data.append_suggestions(_suggestions(spark, d, rows))
    data.reset_suggestions()
    return data.purchases()


@query
def without_feedback(spark, d):
    return tables.without_suggestions(_with_feedback(spark, d, _rows(spark, d)))

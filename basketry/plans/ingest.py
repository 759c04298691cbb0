"""Raw purchases and the category list to the purchase table and the product menu."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import catalog, cleaning
from basketry.schemas import MENU, PRODUCT_KEYS, PURCHASES, RECENCY_CUTOFF
from basketry.storage import save


def clean(
    raw: DataFrame,
    min_customer_orders: int = 6,
    min_product_orders: int = 75,
    cutoff: str = RECENCY_CUTOFF,
    required=("prod_family",),
) -> DataFrame:
    """Thresholds in sequence, each on what the one before left, then distinct rows."""
    return cleaning.drop_copies(_selling(raw, min_customer_orders, min_product_orders, cutoff, required))


def _selling(raw, min_customer_orders=6, min_product_orders=75, cutoff=RECENCY_CUTOFF, required=("prod_family",)):
    rows = cleaning.exclude_value(cleaning.drop_missing(raw, required))
    # Both product thresholds and the rows they filter come from this; the raw scan ends here.
    rows = save(cleaning.keep_active_customers(rows, min_customer_orders), "active")
    # The rows are read twice, for the products and for the purchases; the thresholds are worked out once.
    selling = save(cleaning.selling_products(rows, min_product_orders, cutoff), "selling")
    return rows.join(selling, "prod_name", "left_semi")


def purchase_table(raw: DataFrame, categories: DataFrame, **thresholds) -> DataFrame:
    """Everything a product alone decides is worked out on the distinct products and joined once."""
    return _described(_selling(raw, **thresholds), categories)


def _described(rows: DataFrame, categories: DataFrame) -> DataFrame:
    products = catalog.product_table(rows, categories)
    return cleaning.drop_copies(rows).join(products, PRODUCT_KEYS).select(*PURCHASES.fieldNames())


def upload(
    raw: DataFrame,
    categories: DataFrame,
    min_customer_orders: int = 6,
    min_product_orders: int = 75,
    cutoff: str = RECENCY_CUTOFF,
) -> tuple[DataFrame, DataFrame]:
    """(purchase table, menu table) of one raw log, equal to the two made apart.

    The menu's thresholds count rows with a full hierarchy only. Both counts come from one aggregate over customers
    and one over products, which read a few columns; the wide rows are written once, with a flag for the menu.
    """
    whole = F.lit(True)
    for key in PRODUCT_KEYS:
        whole = whole & F.col(key).isNotNull()
    rows = cleaning.exclude_value(cleaning.drop_missing(raw, ["prod_family"])).withColumn("_whole", whole)
    order = F.col("transaction_id")
    customers = (
        rows.groupBy("cont_id")
        .agg(
            F.count_distinct(order).alias("_n"),
            F.count_distinct(F.when(F.col("_whole"), order)).alias("_n_menu"),
        )
        .filter(F.col("_n") >= min_customer_orders)
        .select("cont_id", (F.col("_n_menu") >= min_customer_orders).alias("_active"))
    )
    joined = rows.join(customers, "cont_id").withColumn("_menu", F.col("_whole") & F.col("_active"))
    active = save(joined.drop("_whole", "_active"), "active")
    last = F.lit(cutoff).cast("timestamp_ntz")

    def selling(count, date):
        return (F.col(count) >= min_product_orders) & F.coalesce(F.col(date) > last, F.lit(False))

    products = (
        active.groupBy("prod_name")
        .agg(
            F.count_distinct(order).alias("_n"),
            F.max("transaction_date").alias("_last"),
            F.count_distinct(F.when(F.col("_menu"), order)).alias("_n_menu"),
            F.max(F.when(F.col("_menu"), F.col("transaction_date"))).alias("_last_menu"),
        )
        .select("prod_name", selling("_n", "_last").alias("_sells"), selling("_n_menu", "_last_menu").alias("_shown"))
    )
    columns = [c for c in active.columns if c != "_menu"]
    bought = active.join(products.filter("_sells"), "prod_name", "left_semi").select(*columns)
    shown = active.filter("_menu").join(products.filter("_shown"), "prod_name", "left_semi").select(*columns)
    return _described(bought, categories), _menu(shown, categories)


def menu_table(raw: DataFrame, categories: DataFrame, **thresholds) -> DataFrame:
    """One row per product. Rows without a full hierarchy leave before the thresholds here."""
    return _menu(_selling(raw, required=PRODUCT_KEYS, **thresholds), categories)


def _menu(rows: DataFrame, categories: DataFrame) -> DataFrame:
    known = catalog.drop_uncategorised(
        catalog.categorise(catalog.first_hierarchy(rows), categories)
    )
    return catalog.with_label(known).select(*MENU.fieldNames())

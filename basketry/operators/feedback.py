"""Suggestions made by clients, turned into purchase rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.schemas import SUGGESTION
from basketry.storage import save

_DESCRIPTION = [
    "prod_family", "prod_subfamily", "prod_name", "CAT1", "category1", "category2", "model_id",
]


def product_lookup(purchases: DataFrame) -> DataFrame:
    """Distinct product descriptions."""
    return purchases.select(*_DESCRIPTION).distinct()


def products_by_model(purchases: DataFrame, models: DataFrame) -> DataFrame:
    """Descriptions of the products with the given model ids."""
    found = product_lookup(purchases).join(models.select("model_id").distinct(), "model_id", "left_semi")
    return found.select(
        "CAT1", "category1", "prod_family", "category2", "prod_subfamily", "prod_name", "model_id"
    )


def long_requests(wide: DataFrame) -> DataFrame:
    """Form fields suggestion1..3 to one row per suggestion; empty fields are no suggestion.

    ``form`` tells the forms of one client apart. Where the input has none, forms are numbered and
    the numbers kept in a written table, so that later steps see the same ones.
    """
    fields = [c for c in wide.columns if c.startswith("suggestion")]
    forms = wide
    if "form" not in wide.columns:
        forms = save(wide.withColumn("form", F.monotonically_increasing_id()), "forms")
    cells = F.posexplode(F.array(*fields)).alias("pos", "prod_name")
    rows = forms.select("client_id", "form", cells).withColumn("pos", F.col("pos") + 1)
    return rows.filter(F.col("prod_name").isNotNull() & (F.col("prod_name") != ""))


def suggestion_rows(
    requests: DataFrame, purchases: DataFrame, now, weighted: bool = False
) -> DataFrame:
    """Purchase rows for the products that clients named.

    A form (a client, where requests have no ``form``) gives at most as many rows as it has names,
    in model order; unknown names give none. ``purchases`` may be the product table alone. ``now`` is the timestamp to record, so that a run can
    be repeated. ``weighted`` adds qty = 1.
    """
    form = [c for c in ("client_id", "form") if c in requests.columns]
    given = requests.groupBy(*form).agg(F.count("*").alias("n_given"))
    named = requests.select(*form, "prod_name").distinct().join(given, form)
    order = Window.partitionBy(*form).orderBy("model_id", "category1", "category2")
    matched = named.join(product_lookup(purchases), "prod_name")
    kept = matched.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= F.col("n_given"))
    recorded = now if not isinstance(now, str) else F.lit(now)
    rows = kept.select(
        F.col("client_id").alias("cont_id"),
        F.lit(SUGGESTION).alias("transaction_id"),
        recorded.cast("timestamp_ntz").alias("transaction_date"),
        F.lit(None).cast("string").alias("prod_id"),
        *_DESCRIPTION,
    )
    return rows.withColumn("qty", F.lit(1)) if weighted else rows


def unknown_names(requests: DataFrame, purchases: DataFrame) -> DataFrame:
    """Requested names that match no product."""
    return requests.join(product_lookup(purchases), "prod_name", "left_anti")

"""What a client can browse: the product menu and a customer's own history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators.positions import paged_lists


def products_by_subfamily(menu: DataFrame, page_size: int = 1000) -> DataFrame:
    """Sorted product names of each subfamily, as lists of bounded length."""
    names = menu.select("prod_subfamily", "prod_name").distinct()
    return paged_lists(names, ["prod_subfamily"], "prod_name", page_size=page_size, name="prod_names")


def subfamilies_by_family(menu: DataFrame, page_size: int = 1000) -> DataFrame:
    """Sorted subfamilies of each (label, family), as lists of bounded length."""
    names = menu.select("CAT1", "prod_family", "prod_subfamily").distinct()
    return paged_lists(
        names, ["CAT1", "prod_family"], "prod_subfamily", page_size=page_size, name="prod_subfamilies"
    )


def menu_head(menu: DataFrame, subfamilies: int = 3, products: int = 3) -> DataFrame:
    """The part of the menu that is shown: first subfamilies per family, first products of each.

    Products come from the subfamily wherever it occurs, as a subfamily's list does.
    """
    by_family = Window.partitionBy("CAT1", "prod_family").orderBy("prod_subfamily")
    by_subfamily = Window.partitionBy("prod_subfamily").orderBy("prod_name")
    families = (
        menu.select("CAT1", "prod_family", "prod_subfamily")
        .distinct()
        .withColumn("subfamily_no", F.row_number().over(by_family))
        .filter(F.col("subfamily_no") <= subfamilies)
    )
    names = (
        menu.select("prod_subfamily", "prod_name")
        .distinct()
        .withColumn("product_no", F.row_number().over(by_subfamily))
        .filter(F.col("product_no") <= products)
    )
    return families.join(names, "prod_subfamily")


def history(purchases: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """All rows of the given customers (of everyone by default), suggestions included."""
    return purchases if clients is None else purchases.join(clients, "cont_id", "left_semi")


def history_page(purchases: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """History with display names, by customer and date."""
    return (
        history(purchases, clients)
        .orderBy("cont_id", "transaction_date", "transaction_id", "prod_name")
        .select(
            "cont_id",
            F.col("transaction_date").alias("ORDER DATE"),
            F.col("prod_family").alias("FAMILY"),
            F.col("prod_subfamily").alias("SUB-FAMILY"),
            F.col("prod_name").alias("MODEL"),
            F.col("model_id").alias("MODEL ID"),
            F.col("transaction_id").alias("ORDER #"),
        )
    )

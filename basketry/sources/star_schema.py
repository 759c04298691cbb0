"""Reads an order star schema (orders, lineitem, part, events) as purchase-log inputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Category code by part type. STANDARD is left out, so some products stay uncategorised.
TYPE_CODES = {"ECONOMY": "L", "LARGE": "D", "MEDIUM": "B", "PROMO": "A", "SMALL": "O"}

MIN_CUSTOMER_ORDERS = 6
MIN_PRODUCT_ORDERS = 25
CUTOFF = "2001-04-01"
EXCLUDED_WORDS = ("old", "gizmo")


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _product_name():
    return F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    lines = _read(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    orders = _read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = _read(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").cast("string").alias("cont_id"),
            F.col("o_orderkey").cast("string").alias("transaction_id"),
            F.col("o_orderdate").alias("transaction_date"),
            F.col("l_partkey").cast("string").alias("prod_id"),
            F.col("p_brand").alias("prod_family"),
            F.col("p_type").alias("prod_subfamily"),
            _product_name().alias("prod_name"),
        )
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for pair in TYPE_CODES.items() for x in pair])
    return (
        _read(spark, folder, "part")
        .filter(F.col("p_type").isin(*TYPE_CODES))
        .select(
            codes[F.col("p_type")].alias("category1"),
            F.concat_ws("/", codes[F.col("p_type")], "p_brand").alias("category2"),
            F.col("p_brand").alias("prod_family"),
            F.col("p_type").alias("prod_subfamily"),
        )
        .distinct()
    )


def feedback_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Suggested products, from all purchase events, in long form: forms of three, in the events' order."""
    parts = _read(spark, folder, "part")
    part_count = parts.agg(F.count("*")).scalar()
    first = Window.partitionBy("client_id").orderBy("event_id")
    asked = (
        _read(spark, folder, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").cast("string").alias("client_id"),
            "event_id",
            F.pmod("event_id", part_count).alias("p_partkey"),
        )
        .withColumn("_n", F.row_number().over(first) - 1)
        .withColumn("form", F.floor(F.col("_n") / 3))
        .withColumn("pos", F.col("_n") % 3 + 1)
    )
    return asked.join(parts.select("p_partkey", "p_name"), "p_partkey").select(
        "client_id", "form", "pos", _product_name().alias("prod_name")
    )

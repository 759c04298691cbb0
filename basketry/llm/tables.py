"""Reading the text tables, and the fixed splits their contracts name."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def held_out(doc_id, parts: int) -> Column:
    """True where crc32 of the id, written as text, leaves the remainder 1. A null id is not held out."""
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))
    return F.coalesce(remainder == 1, F.lit(False))

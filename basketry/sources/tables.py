"""The purchase data set on disk: purchases, menu, and the suggestions beside them.

Suggestions are a data set of their own, so that recording one is an append and forgetting all of
them never rewrites the purchase history.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.schemas import MENU, PURCHASES, SUGGESTION


class Dataset:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, purchases: DataFrame, menu: DataFrame) -> None:
        """Write both tables; fails, before anything is written, where one exists."""
        for name in ("purchases", "menu"):
            if self._has(name):
                raise FileExistsError(f"{self._path(name)} already exists")
        self._write(purchases, menu, "errorifexists")

    def replace(self, purchases: DataFrame, menu: DataFrame) -> None:
        """Drop what is there, suggestions included, and write both tables."""
        self._write(purchases, menu, "overwrite")
        self.reset_suggestions()

    def _write(self, purchases, menu, mode):
        shaped(purchases, PURCHASES).write.mode(mode).parquet(self._path("purchases"))
        shaped(menu, MENU).write.mode(mode).parquet(self._path("menu"))

    def append_suggestions(self, rows: DataFrame) -> None:
        """Record rows in a folder of their own, beside those that a stream writes."""
        folder = f"{self._path('suggestions')}/rows-{uuid.uuid4().hex}"
        shaped(rows, PURCHASES).write.parquet(folder)

    def reset_suggestions(self) -> None:
        """Forget every recorded suggestion."""
        empty = self.spark.createDataFrame([], PURCHASES)
        empty.write.mode("overwrite").parquet(self._path("suggestions"))

    def purchases(self, with_suggestions: bool = True) -> DataFrame:
        bought = self.spark.read.schema(PURCHASES).parquet(self._path("purchases"))
        if not with_suggestions or not self._has("suggestions"):
            return bought
        # Every folder below holds rows of one layout.
        recorded = self.spark.read.schema(PURCHASES).option("recursiveFileLookup", True)
        return bought.unionByName(recorded.parquet(self._path("suggestions")))

    def menu(self) -> DataFrame:
        return self.spark.read.schema(MENU).parquet(self._path("menu"))

    def _has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(name))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path.getFileSystem(conf).exists(path)


def shaped(df, schema):
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def with_suggestions(purchases: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Purchases and suggestions as one table; a suggestion has no article code."""
    return purchases.unionByName(suggestions, allowMissingColumns=True)


def without_suggestions(purchases: DataFrame) -> DataFrame:
    return purchases.filter(F.col("transaction_id") != SUGGESTION)

"""Models that are fitted once and read many times.

A model is a folder: the neighbour lists and what recommendations need beside them. Its name is a fingerprint
of the rows and parameters it was made from, so a model is found only for the very log it fits; a log that has
changed is refused, or its model is refitted. Recommendations from a stored model join two tables on the
neighbour's id; nothing is compared again.
"""

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import features, neighbors, split, voting
from basketry.plans import recommend
from basketry.sources.tables import without_suggestions


class StaleModel(LookupError):
    """No model of these rows and parameters is stored."""


def fingerprint(rows: DataFrame, **params) -> str:
    """A name for rows, whatever their order, and parameters: count, sum and exclusive or of row hashes."""
    columns = sorted(rows.columns)
    hashed = rows.select(
        F.xxhash64(*columns).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")
    )
    facts = hashed.agg(F.count("*"), F.sum("a"), F.bit_xor("b")).first()
    told = json.dumps([columns, [str(x) for x in facts], sorted(params.items())])
    return hashlib.sha256(told.encode()).hexdigest()[:32]


@dataclass(frozen=True)
class CustomerModel:
    """Nearest customers, and how often each customer has each product in the target orders."""

    neighbors: DataFrame
    targets: DataFrame

    def recommend(self, clients: DataFrame | None = None, num_recs: int = 5, vote: str = "last") -> DataFrame:
        """Ranked products of these customers, or of all: cont_id, prod_name, score, rank."""
        asked = self.neighbors
        if clients is not None:
            asked = asked.join(clients.select("cont_id").distinct(), "cont_id", "left_semi")
        return recommend.from_neighbors(asked, self.targets, num_recs, vote)


@dataclass(frozen=True)
class ProductModel:
    """Nearest products, the weights they were worked out from, and what customers had."""

    neighbors: DataFrame
    weights: DataFrame
    past: DataFrame

    def recommend(
        self,
        clients: DataFrame | None = None,
        seed: str = "top1",
        order: str = "name",
        num_recs: int | None = None,
    ) -> DataFrame:
        """Unseen products nearest to what these customers, or all, bought: cont_id, prod_name, dist, rank."""
        mine = self.weights
        if clients is not None:
            mine = mine.join(clients.select("cont_id").distinct(), "cont_id", "left_semi")
        seeds = features.seed_products(mine) if seed == "top1" else mine.select("cont_id", "prod_name")
        return voting.unseen_neighbors(seeds, self.neighbors, self.past, order, num_recs)


class ModelStore:
    """Models below a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def customers(self, rows: DataFrame, refit: bool = False, split_by: str = "id", **params) -> CustomerModel:
        """The model of ``recommend.by_customers``. Where none is stored: fitted with ``refit``, else refused."""
        folder = self._folder("customers", rows, split_by=split_by, **params)

        def fit():
            orders = split.split_orders(rows, split_by)
            return {
                "neighbors": recommend.customer_neighbors(rows, orders, **params),
                "targets": voting.target_counts(rows, orders),
            }

        return CustomerModel(**self._tables(folder, refit, fit))

    def products(self, rows: DataFrame, refit: bool = False, weight: str = "count_sq", k: int = 10) -> ProductModel:
        """The model of ``recommend.by_products``, for all products."""
        folder = self._folder("products", rows, weight=weight, k=k)

        def fit():
            weights = features.quantity_weights(rows, weight)
            return self._product_tables(rows, weights, _product_neighbors(weights, k))

        return ProductModel(**self._tables(folder, refit, fit))

    def products_after(
        self, model: ProductModel, rows: DataFrame, weight: str = "count_sq", k: int = 10
    ) -> ProductModel:
        """The model of ``rows``, from that of a log to which or from which rows were added or taken.

        Only lists that a product with other weights than before can change are worked out anew.
        """
        folder = self._folder("products", rows, weight=weight, k=k)

        def fit():
            weights = features.quantity_weights(rows, weight)
            lists = neighbors.refitted(
                model.neighbors,
                changed_products(model.weights, weights),
                weights,
                k,
                id_col="prod_name",
                feature_col="cont_id",
            )
            return self._product_tables(rows, weights, lists)

        return ProductModel(**self._tables(folder, True, fit))

    def _product_tables(self, rows, weights, lists):
        past = split.split_rows(rows, split.split_orders(without_suggestions(rows)), "history")
        return {
            "neighbors": lists,
            "weights": weights,
            "past": past.select("cont_id", "prod_name").distinct(),
        }

    def _folder(self, kind, rows, **params):
        return f"{self.root}/{kind}-{fingerprint(rows, **params)}"

    def _tables(self, folder, refit, fit):
        if not self._complete(folder):
            if not refit:
                raise StaleModel(f"no model of these rows and parameters in {self.root}")
            names = []
            for name, table in fit().items():
                table.write.mode("overwrite").parquet(f"{folder}/{name}")
                names.append((name,))
            # Written last: a model that was broken off is not taken for one.
            self.spark.createDataFrame(names, "name string").write.mode("overwrite").parquet(f"{folder}/complete")
        names = [r.name for r in self.spark.read.parquet(f"{folder}/complete").collect()]
        return {name: self.spark.read.parquet(f"{folder}/{name}") for name in names}

    def _complete(self, folder):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/complete/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def changed_products(before: DataFrame, after: DataFrame) -> DataFrame:
    """Products whose vector is not the same in both: one pass over all weights, combined by product."""

    def signed(weights, sign):
        return weights.select("prod_name", "cont_id", "weight", F.lit(sign).alias("sign"))

    cells = signed(before, 1).unionByName(signed(after, -1))
    differing = cells.groupBy("prod_name", "cont_id", "weight").agg(F.sum("sign").alias("n")).filter("n <> 0")
    return differing.select("prod_name").distinct()


def _product_neighbors(weights, k):
    return neighbors.cosine_neighbors(weights, k=k, id_col="prod_name", feature_col="cont_id")

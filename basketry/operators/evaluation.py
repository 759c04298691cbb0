"""Hit counts of shown products against what customers bought."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_counts(
    shown: DataFrame, relevant: DataFrame, hits: str = "products", relevant_unit: str = "products"
) -> DataFrame:
    """Global counts and the two ratios.

    ``shown`` has cont_id, prod_name and ``places`` (how many recommended rows a product stands for).
    ``hits`` counts a shown product once per customer ("products") or once per place ("rows");
    ``relevant_unit`` counts relevant products likewise.

    ``hits_per_relevant`` is what is commonly called recall and ``hits_per_recommended`` precision;
    the names avoid the question.
    """
    wanted = relevant.groupBy("cont_id", "prod_name").agg(F.count("*").alias("n"))
    offered = shown.groupBy("cont_id", "prod_name").agg(F.sum("places").alias("places"))
    one = F.lit(1).cast("long")
    hit = F.col("places") if hits == "rows" else one
    needed = F.col("n") if relevant_unit == "rows" else one
    # Each side is counted on its own; only hits are joined, on keys that are unique on both sides.
    n_recommended = offered.agg(F.coalesce(F.sum("places"), F.lit(0))).scalar()
    n_relevant = wanted.agg(F.coalesce(F.sum(needed), F.lit(0))).scalar()
    totals = (
        offered.join(wanted, ["cont_id", "prod_name"])
        .agg(F.coalesce(F.sum(hit), F.lit(0)).alias("hits"))
        .select("hits", n_recommended.alias("n_recommended"), n_relevant.alias("n_relevant"))
    )
    return totals.withColumns(
        {
            "hits_per_relevant": F.try_divide("hits", "n_relevant"),
            "hits_per_recommended": F.try_divide("hits", "n_recommended"),
        }
    )

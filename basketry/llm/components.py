"""Connected components of a link table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.storage import save


def components(links: DataFrame, first: str, second: str) -> DataFrame:
    """(node, root): the least node that each linked node is connected with.

    Every round, a node takes the least root among its own, its neighbours' and that of its root, so the
    distance to the least node shrinks by more than half. A node may have any number of links: they meet
    in a minimum, which Spark works out before the shuffle. Each round is a written table.
    """
    both = links.select(F.col(first).alias("node"), F.col(second).alias("other"))
    both = save(
        both.union(both.select("other", "node")).filter("node <> other").distinct(), "links"
    )
    roots = save(
        both.groupBy("node")
        .agg(F.min("other").alias("root"))
        .select("node", F.least("node", "root").alias("root")),
        "roots",
    )
    while True:
        near = both.join(roots.withColumnRenamed("node", "other"), "other").select("node", "root")
        met = roots.withColumnRenamed("root", "was").join(
            near.groupBy("node").agg(F.min("root").alias("near")), "node"
        )
        new = F.least("was", "near")
        # What a node has learned is told to the root it had, too.
        told = met.select("node", new.alias("root")).union(met.select("was", new))
        learned = save(told.groupBy("node").agg(F.min("root").alias("root")), "roots")
        top = learned.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = save(learned.join(top, "root").select("node", F.col("top").alias("root")), "roots")
        was = roots.withColumnRenamed("root", "was")
        changed = after.join(was, "node").filter("root <> was").limit(1).count()
        roots = after
        if not changed:
            return roots

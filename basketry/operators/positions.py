"""Numbering rows of a large sorted set, in one group or many, without a one-task window.

A window over a huge group sorts that group in a single task. Here the rows are range-sorted across
the cluster first, so a group of any size is spread over many tasks; only one row per partition is
needed to turn local numbers into global ones.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.storage import save

# monotonically_increasing_id keeps the partition number above bit 33.
_PARTITION_SHIFT = 33


def with_position(df: DataFrame, order, name: str = "position") -> DataFrame:
    """Add 1..N in the given order, which must be total."""
    sorted_rows = save(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "sorted"
    )
    part = F.shiftright("_slot", _PARTITION_SHIFT)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sorted partition: bounded by the number of partitions, not by the data.
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    local = F.col("_slot") - F.shiftleft(part, _PARTITION_SHIFT)
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local + 1)
        .drop("_part", "_slot", "_start")
    )


def with_group_position(
    df: DataFrame, group, order, name: str = "position", size: str | None = None
) -> DataFrame:
    """Add 1..n inside each group (and n itself, as ``size``). Null is a group like any other."""
    placed = with_position(df, [*group, *order], "_position")
    firsts = placed.groupBy(*group).agg(
        F.min("_position").alias("_first"),
        F.count("*").alias(size or "_size"),
    )
    renamed = firsts.withColumnsRenamed({g: f"_group_{g}" for g in group})
    same = reduce(
        lambda left, right: left & right,
        [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group],
    )
    numbered = placed.join(renamed, same).withColumn(
        name, F.col("_position") - F.col("_first") + 1
    )
    return numbered.drop("_position", "_first", "_size", *[f"_group_{g}" for g in group])


def paged_lists(
    df: DataFrame, group, value: str, order=None, page_size: int = 1000, name: str | None = None
) -> DataFrame:
    """Ordered list of a group's values, cut into pages of at most ``page_size`` values.

    All values are kept; a group no longer than a page is one row, as a plain list would be.
    """
    order = list(order or [value])
    columns = list(dict.fromkeys([*group, *order, value]))
    numbered = with_group_position(df.select(*columns), group, order)
    page = F.floor((F.col("position") - 1) / page_size) + 1
    return (
        numbered.withColumn("page", page)
        .groupBy(*group, "page")
        .agg(F.array_sort(F.collect_list(F.struct("position", value))).alias("_cells"))
        .select(*group, "page", F.col(f"_cells.{value}").alias(name or value))
    )

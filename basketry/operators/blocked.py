"""All pairs of bounded blocks: a sparse matrix product of which only the k best of each row leave a task.

The ids of both sides are dealt into blocks of bounded rows and entries. The tasks form a grid, one for each pair of a
query block and a base block; a vector, one row with its entries, is copied once along its row or column of the grid. So what is shuffled is
entries x blocks of the other side, N x sqrt(tasks) in all, and k rows per query and block on the way back. No
pair of ids is ever a row. This suits features that many ids have; a join on the features suits sparse ones.
``worth_it`` compares what both would move.
"""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.block_scores import Scorer, Vectors
from basketry.storage import save

#: A block is scored in strips of ``BLOCK_ROWS`` base ids. It has more ids, up to ``WIDE_ROWS``, where there are many,
#: as the copies grow with the number of blocks; ``BLOCKS`` on a side are enough tasks.
BLOCK_ROWS, WIDE_ROWS, BLOCK_ENTRIES, BLOCKS = 4096, 65_536, 2_000_000, 12
FIRST_ROWS = 512
#: An entry that is copied is a row of six numbers; a pair is a number and a weight in a list.
_PAIR_COST = 0.3

_SCORED = "q long, n long, gap double"


@dataclass(frozen=True)
class Grid:
    """Blocks of the query side and of the base side, and the entries that are copied between tasks."""

    rows: int
    columns: int
    cells: int


def _blocks(ids: int, entries: int) -> int:
    wide = max(1, -(-ids // WIDE_ROWS), -(-entries // BLOCK_ENTRIES))
    return max(wide, min(-(-ids // BLOCK_ROWS), BLOCKS))


def grid_of(problem) -> Grid:
    """Sized by counting ids and entries of both sides."""

    def size(side):
        return side.agg(F.count_distinct("idx").alias("ids"), F.count("*").alias("entries")).first()

    base = size(problem.base)
    asked = base if problem.symmetric else size(problem.queries)
    rows, columns = _blocks(asked.ids, asked.entries), _blocks(base.ids, base.entries)
    return Grid(rows, columns, asked.entries * columns + base.entries * rows)


def worth_it(grid: Grid, pairs: int) -> bool:
    """Whether copying entries moves less than the pairs that meet over all features."""
    return grid.cells <= _PAIR_COST * pairs


def block_candidates(problem, grid: Grid) -> DataFrame:
    """The ``keep`` nearest of each query in every base block, among those that share a feature: q, n, gap."""
    features = problem.base.select("feature").distinct()
    numbered = save(features.withColumn("fid", F.monotonically_increasing_id()), "features")

    def vectors(side):
        return save(packed(side.join(numbered, "feature")), "vectors")

    def copies(rows, own, own_blocks, other, other_blocks):
        block = F.pmod(F.xxhash64("idx"), F.lit(own_blocks)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        # Named afresh: both sides of the cogroup may come from the same tables.
        named = [F.col(c).alias(c) for c in ("idx", "sq", "cells")]
        copied = rows.select(block.alias(own), each.alias(other), *named)
        return copied.repartition(grid.rows * grid.columns, "row", "column")

    b_rows = vectors(problem.base)
    q_rows = b_rows if problem.symmetric else vectors(problem.queries)
    asked = copies(q_rows, "row", grid.rows, "column", grid.columns)
    offered = copies(b_rows, "column", grid.columns, "row", grid.rows)
    keep, metric = problem.keep, problem.metric

    def score(queries: pa.Table, base: pa.Table) -> pa.Table:
        return best_of_strips(Vectors.of(queries), Vectors.of(base), keep, metric)

    return (
        asked.groupBy("row", "column")
        .cogroup(offered.groupBy("row", "column"))
        .applyInArrow(score, _SCORED)
    )


def packed(entries: DataFrame, *carried: str) -> DataFrame:
    """A row for each vector of (idx, sq, fid, w), its entries as ``cells``, with the columns it has besides."""
    cells = F.array_sort(F.collect_list(F.struct("fid", "w"))).alias("cells")
    return entries.groupBy("idx", "sq", *carried).agg(cells)


def best_of_strips(queries: Vectors, base: Vectors, keep: int, metric: str) -> pa.Table:
    """The ``keep`` nearest of each query in a block, one strip of base ids after the other."""
    scorer = Scorer(queries, base, keep, metric)
    # A few first: what they give tells most of the others apart.
    ends = [min(FIRST_ROWS, BLOCK_ROWS), *range(BLOCK_ROWS, len(base.ids), BLOCK_ROWS), len(base.ids)]
    for low, high in zip([0, *ends], ends):
        scorer.scan(low, min(high, len(base.ids)))
    return pa.table(dict(zip("q n gap".split(), scorer.nearest())))

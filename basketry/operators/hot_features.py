"""Candidates that involve hot features, found without writing out a hot feature's pairs.

For a query a and a base id b write a.b = T + H, T over rare and H over hot features. Two sets of
candidates are enough:

1. Pairs with T > 0. The rare join lists them all. H is added exactly, but only where it can matter:
   H <= |a_hot| |b_hot|, so a pair is let go when even that bound leaves it behind the k-th best
   distance the query already has.
2. Pairs with T = 0. Such a pair is scored by H alone. If it belongs to the k nearest, it is also
   among the k nearest when *all* ids are scored by H alone, because counting T could only bring the
   others nearer. So the k best by H are kept, block by block.

Copies are scored once. Ids whose hot parts are equal form a group; the group's smallest ids stand
for it on the base side, and all its members receive the result on the query side.

Base groups are put to the nearest of a few pivots, chosen farthest-first from a bounded sample, and cut into
shards of bounded size by their distance to it. With D the distance of two hot parts,

    gap = (|a|^2 - |a_hot|^2) / 2 + (|b|^2 - |b_hot|^2) / 2 + D^2 / 2

and the triangle inequality bounds D from below by how far the query's distance to a pivot lies outside the range
of a shard's. Every query meets the likeliest shard of its pivot first; after that it visits only shards whose
best case can still beat its k-th best distance. Which shards a block of queries has to visit at all is found by a join
on the pivot; a list of all shards is nowhere in one row. Blocks and shards that lie side by side are dealt into parts
of bounded size, and a task takes a part of either kind that have a visit between them: a vector is copied once a part
of the other side, not once a visit. Within the task each query is held against each shard by the bound again.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.operators import blocked
from basketry.operators.block_scores import Scorer, Vectors
from basketry.operators.neighbors import Problem, distance, gap_of, rare_dots, top_candidates
from basketry.operators.positions import with_group_position, with_position
from basketry.storage import save

_SHARD_ROWS = 4096
_SHARD_ENTRIES = 2_000_000
_CELLS = 2_000_000
#: Pivots, and ids and entries of the sample from which they are chosen, at most.
_PIVOTS, _SAMPLE_ROWS, _SAMPLE_ENTRIES = 256, 1024, 500_000
_CLUSTER_SHIFT, _CLASS_SHIFT = 46, 40
#: Blocks that lie side by side in a task, at most.
_BLOCKS_A_PART = 32
_DENSE_FEATURES = 256
# A cell of a matrix product costs about this much less than one met through an index.
_DENSE_GAIN = 30
# Room for the rounding of distances when a bound is compared with one.
_SLACK = 2e-8

_SCORED = "q long, n long, gap double"


def hot_candidates(problem: Problem, hot: DataFrame, tasks: int) -> DataFrame:
    """Candidate pairs with their gaps: q, n, gap."""
    base_hot = save(problem.base.join(hot, "feature"), "hot_base")
    query_hot = (
        base_hot if problem.symmetric else save(problem.queries.join(hot, "feature"), "hot_query")
    )
    shared = _rare_pairs(problem, hot, base_hot, query_hot, tasks)
    alone = _hot_only(problem, base_hot, query_hot)
    return shared.unionByName(alone).groupBy("q", "n").agg(F.min("gap").alias("gap"))


def _hot_norms(entries: DataFrame) -> DataFrame:
    return entries.groupBy("idx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("hot_norm"))


def _rare_pairs(problem, hot, base_hot, query_hot, tasks):
    def rare(entries, hot_entries):
        return (
            entries.join(hot.select("feature"), "feature", "left_anti")
            .join(_hot_norms(hot_entries), "idx", "left")
            .na.fill(0.0, ["hot_norm"])
        )

    base = rare(problem.base, base_hot)
    queries = base if problem.symmetric else rare(problem.queries, query_hot)
    dots = save(
        rare_dots(problem, queries, base, tasks, "hot_norm").select(
            "q",
            "n",
            gap_of(problem.metric).alias("gap"),
            (F.col("q_hot_norm") * F.col("n_hot_norm")).alias("room"),
        ),
        "rare_pairs",
    )
    complete = dots.filter(F.col("room") == 0).select("q", "n", "gap")
    reached = (
        top_candidates(dots, problem.metric, problem.keep)
        .filter(F.col("neighbor_rank") == problem.keep)
        .select("q", F.col("dist").alias("reached"))
    )
    best_case = distance(F.col("gap") - F.col("room"), problem.metric)
    open_pairs = (
        dots.filter(F.col("room") > 0)
        .join(reached, "q", "left")
        .filter(F.col("reached").isNull() | (best_case <= F.col("reached") + _SLACK))
    )
    products = (
        open_pairs.select("q", "n")
        .join(query_hot.select(F.col("idx").alias("q"), "fid", F.col("w").alias("qw")), "q")
        .join(base_hot.select(F.col("idx").alias("n"), "fid", F.col("w").alias("nw")), ["n", "fid"])
        .select("q", "n", (-F.col("qw") * F.col("nw")).alias("gap"))
    )
    # The rare gap once, minus every hot product: a sum that combines map-side.
    completed = open_pairs.select("q", "n", "gap").unionByName(products)
    completed = completed.groupBy("q", "n").agg(F.sum("gap").alias("gap"))
    return complete.unionByName(completed)


def _groups(entries: DataFrame) -> DataFrame:
    """idx -> rep, the smallest idx with the same hot part, told by a 128-bit fingerprint."""
    prints = entries.groupBy("idx", "sq").agg(
        F.bit_xor(F.xxhash64("fid", "w")).alias("p1"),
        F.bit_xor(F.xxhash64("w", "fid", F.lit(1))).alias("p2"),
        F.count("*").alias("n_entries"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("hot_norm"),
    )
    same = ["p1", "p2", "n_entries", "sq"]
    reps = prints.groupBy(*same).agg(F.min("idx").alias("rep"))
    return save(prints.join(reps, same).select("idx", "rep", "sq", "n_entries", "hot_norm"), "groups")


@dataclass(frozen=True)
class Pivots:
    """Hot parts of some base ids: entries (row, fid, w), sorted fids, and squared lengths."""

    row: np.ndarray
    fid: np.ndarray
    w: np.ndarray
    fids: np.ndarray
    square: np.ndarray

    def distances(self, entries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(sorted ids, distance of each to every pivot) of hot parts in long form."""
        ids, row = np.unique(entries["idx"].to_numpy(), return_inverse=True)
        w = entries["w"].to_numpy()
        square = np.bincount(row, w * w, minlength=len(ids))
        known = np.isin(entries["fid"].to_numpy(), self.fids)
        place = np.searchsorted(self.fids, entries["fid"].to_numpy()[known])
        order = np.argsort(self.fid, kind="stable")
        out = np.empty((len(ids), len(self.square)))
        step = max(1, _CELLS // len(self.square))
        mine, w = row[known], w[known]
        by_row = np.argsort(mine, kind="stable")
        mine, place, w = mine[by_row], place[by_row], w[by_row]
        for low in range(0, len(ids), step):
            high = min(low + step, len(ids))
            here = slice(*np.searchsorted(mine, (low, high)))
            dots = _dots(
                (mine[here] - low, place[here], w[here], high - low),
                (
                    self.row[order],
                    np.searchsorted(self.fids, self.fid[order]),
                    self.w[order],
                    len(self.square),
                ),
                len(self.fids),
            )
            out[low:high] = square[low:high, None] + self.square - 2 * dots
        return ids, np.sqrt(np.maximum(out, 0.0))

    def distances_of(self, vectors: Vectors) -> np.ndarray:
        """The distance of each row to every pivot; no row is empty."""
        return self.distances(pd.DataFrame({"idx": vectors.row, "fid": vectors.fid, "w": vectors.w}))[1]


def _pivots(entries: DataFrame, reps: DataFrame) -> Pivots | None:
    """Farthest-first: each pivot is the sampled id farthest from those before it."""
    facts = reps.agg(F.count("*").alias("n"), F.max("n_entries").alias("widest")).first()
    if not facts.n:
        return None
    most = max(1, min(_SAMPLE_ROWS, _SAMPLE_ENTRIES // facts.widest))
    sample = reps.select(F.col("rep").alias("idx")).orderBy(F.xxhash64("idx"), "idx").limit(most)
    # At most _SAMPLE_ENTRIES rows, whatever the data.
    table = entries.join(sample, "idx").select("idx", "fid", "w").toPandas()
    ids, row = np.unique(table["idx"].to_numpy(), return_inverse=True)
    fids, column = np.unique(table["fid"].to_numpy(), return_inverse=True)
    w = table["w"].to_numpy()
    square = np.bincount(row, w * w, minlength=len(ids))
    wanted = min(_PIVOTS, len(ids), max(1, 2 * -(-facts.n // _SHARD_ROWS)))
    chosen, nearest = [int(np.argmin(square))], np.full(len(ids), np.inf)
    while True:
        last = row == chosen[-1]
        own = np.zeros(len(fids))
        own[column[last]] = w[last]
        away = square + square[chosen[-1]] - 2 * np.bincount(row, w * own[column], minlength=len(ids))
        nearest = np.minimum(nearest, away)
        if len(chosen) == wanted or nearest.max() <= 1e-12:
            break
        chosen.append(int(np.argmax(nearest)))
    kept = np.isin(row, chosen)
    # Entries by the number of their pivot in order of choice.
    order = np.argsort(chosen)
    rows = order[np.searchsorted(np.sort(chosen), row[kept])]
    used = np.unique(table["fid"].to_numpy()[kept])
    return Pivots(rows, table["fid"].to_numpy()[kept], w[kept], used, square[chosen])


def _nearest_pivots(entries: DataFrame, reps: DataFrame, pivots: Pivots, sizes, keep: int) -> DataFrame:
    """(rep, cluster, away): the nearest pivots of each id that together have ``keep`` ids; one without ``sizes``."""
    part = F.pmod(F.xxhash64("idx"), F.lit(_parts_of(reps))).cast("int")

    def nearest(table: pd.DataFrame) -> pd.DataFrame:
        ids, away = pivots.distances(table)
        order = np.argsort(away, axis=1, kind="stable")[:, : 1 if sizes is None else keep]
        before = np.zeros(order.shape)
        if sizes is not None:
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
        r, c = np.nonzero(before < keep)
        best = order[r, c]
        return pd.DataFrame({"rep": ids[r], "cluster": best, "away": away[r, best]})

    return (
        entries.join(reps.select(F.col("rep").alias("idx")), "idx")
        .groupBy(part.alias("part"))
        .applyInPandas(nearest, "rep long, cluster long, away double")
    )


def _parts_of(reps: DataFrame) -> int:
    """Parts of bounded rows and entries."""
    facts = reps.agg(F.count("*").alias("n"), F.sum("n_entries").alias("entries")).first()
    return max(1, -(-facts.n // _SHARD_ROWS), -(-(facts.entries or 0) // _SHARD_ENTRIES))


def _placed(entries: DataFrame, groups: DataFrame, pivots: Pivots) -> DataFrame:
    """Representatives with their block: a range of distances to one pivot.

    Blocks are cut inside classes of similar vector length, so that a block is bounded both in rows
    and in entries, however uneven the lengths are.
    """
    reps = groups.filter(F.col("idx") == F.col("rep")).drop("idx")
    sized = reps.join(_nearest_pivots(entries, reps, pivots, None, 1), "rep").withColumn(
        "size_class", F.floor(F.log2("n_entries")).cast("long")
    )
    placed = with_group_position(sized, ["cluster", "size_class"], ["away", "rep"])
    fitting = F.floor(_SHARD_ENTRIES / F.pow(F.lit(2.0), F.col("size_class") + 1))
    rows = F.greatest(F.lit(1), F.least(F.lit(_SHARD_ROWS), fitting))
    number = F.floor((F.col("position") - 1) / rows)
    block = F.shiftleft("cluster", _CLUSTER_SHIFT) + F.shiftleft("size_class", _CLASS_SHIFT) + number
    rare = F.greatest((F.col("sq") - F.col("hot_norm") * F.col("hot_norm")) / 2, F.lit(0.0))
    return save(placed.withColumns({"block": block, "rare": rare}), "placed")


def _hot_only(problem: Problem, base_hot: DataFrame, query_hot: DataFrame) -> DataFrame:
    base_groups = _groups(base_hot)
    query_groups = base_groups if problem.symmetric else _groups(query_hot)
    pivots = _pivots(base_hot, base_groups.filter(F.col("idx") == F.col("rep")))
    if pivots is None:
        return problem.base.select(
            F.col("idx").alias("q"), F.col("idx").alias("n"), F.col("sq").alias("gap")
        ).limit(0)
    base_placed = _placed(base_hot, base_groups, pivots)
    asked = base_placed if problem.symmetric else _placed(query_hot, query_groups, pivots)
    shards = save(
        base_placed.groupBy("cluster", F.col("block").alias("shard")).agg(
            F.min("away").alias("least"), F.max("away").alias("most"), F.min("rare").alias("rare")
        ),
        "shards",
    )

    def cells(entries, placed):
        own = placed.select(F.col("rep").alias("idx"), "block", "cluster", "away", "rare")
        carried = ["block", "cluster", "away", "rare"]
        rows = entries.join(own, "idx").select("idx", "fid", "w", "sq", *carried)
        return save(blocked.packed(rows, *carried), "cells")

    base_cells = cells(base_hot, base_placed)
    query_cells = base_cells if problem.symmetric else cells(query_hot, asked)

    # One row per pivot, _PIVOTS at most.
    counted = base_placed.groupBy("cluster").agg(F.count("*").alias("n")).collect()
    sizes = np.zeros(len(pivots.square), dtype=np.int64)
    for row in counted:
        sizes[row.cluster] = row.n
    near = _nearest_pivots(query_hot, asked, pivots, sizes, problem.keep)
    first_visit = save(_first_visits(asked, near, shards), "first_visits")
    best = save(_score(problem, query_cells, base_cells, first_visit), "first_shard")
    facing = save(_facing(problem, query_cells, first_visit, best), "facing")
    visits = save(_further_visits(problem, facing, shards, pivots), "visits")
    best = best.unionByName(_score_visits(problem, facing, base_cells, visits, pivots))
    best = top_candidates(best, problem.metric, problem.keep).select("q", "n", "gap")

    members = _smallest_members(base_groups, problem.keep).withColumnRenamed("rep", "n")
    found = best.join(members, "n").select("q", F.col("idx").alias("n"), "gap")
    found = top_candidates(found, problem.metric, problem.keep)
    found = found.select(F.col("q").alias("rep"), "n", "gap")
    receivers = query_groups.select("rep", F.col("idx").alias("q"))
    return found.join(receivers, "rep").select("q", "n", "gap")


def _outside(away):
    """How far a distance to a pivot lies outside a shard's range of distances, rounding allowed for."""
    gap = F.greatest(away - F.col("most"), F.col("least") - away)
    return F.greatest(gap - 1e-7 * (1 + away + F.col("most")), F.lit(0.0))


def _first_visits(asked: DataFrame, near: DataFrame, shards: DataFrame) -> DataFrame:
    """Of the shards of the nearest pivots, those whose range a query is nearest to: rep, q_block, shard."""
    own = asked.select("rep", F.col("block").alias("q_block"))
    return (
        near.withColumnRenamed("away", "mine")
        .join(own, "rep")
        .join(shards, "cluster")
        .groupBy("rep", "q_block", "cluster")
        .agg(F.min_by("shard", F.struct(_outside(F.col("mine")), "shard")).alias("shard"))
        .select("rep", "q_block", "shard")
    )


def _smallest_members(groups, keep):
    order = Window.partitionBy("rep").orderBy("idx")
    numbered = groups.select("rep", "idx").withColumn("_n", F.row_number().over(order))
    return numbered.filter(F.col("_n") <= keep).drop("_n")


def _facing(problem, query_cells, first_visit, best):
    """The queries' rows with the distance of the k-th best they have, ``reached``, and the shards they have ``seen``."""
    reached = top_candidates(best, problem.metric, problem.keep).groupBy(F.col("q").alias("idx")).agg(
        # Without k neighbours yet, every shard is worth a visit.
        F.when(F.count("*") >= problem.keep, F.max("dist")).alias("reached")
    )
    # As many as pivots it took to find k ids, so k at most.
    seen = first_visit.groupBy(F.col("rep").alias("idx")).agg(F.collect_list("shard").alias("seen"))
    return (
        query_cells.join(reached, "idx", "left")
        .join(seen, "idx", "left")
        .na.fill(float("inf"), ["reached"])
    )


def _further_visits(problem, facing, shards, pivots):
    """The shards that some query of a block has to visit: q_block, shard."""
    metric = problem.metric
    whole = shards.groupBy("cluster").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.min("rare").alias("rare")
    ).toPandas()

    def near(table: pa.Table) -> pa.Table:
        """Of the queries of a block to which the shards of a pivot are open, what is the widest."""
        away = pivots.distances_of(Vectors.of(table))[:, whole["cluster"].to_numpy()]
        rare, reached = (table.column(c).to_numpy()[:, None] for c in ("rare", "reached"))
        gap = rare + _least_gap(away, *(whole[c].to_numpy() for c in ("least", "most", "rare")))
        open_ = (gap if metric == "cosine" else np.sqrt(2 * gap)) <= reached + 2 * _SLACK
        some = np.flatnonzero(open_.any(axis=0))

        def widest(values, pick, other):
            return pick(np.where(open_, values, other), axis=0)[some]

        return pa.table({
            "q_block": np.full(len(some), table.column("block")[0].as_py()),
            "cluster": whole["cluster"].to_numpy()[some].astype(np.int64),
            "low": widest(away, np.min, np.inf),
            "high": widest(away, np.max, -np.inf),
            "own_rare": widest(rare, np.min, np.inf),
            "reached": widest(reached, np.max, -np.inf),
        })

    open_pivots = facing.groupBy("block").applyInArrow(
        near, "q_block long, cluster long, low double, high double, own_rare double, reached double"
    )
    gap = F.greatest(F.col("low") - F.col("most"), F.col("least") - F.col("high"))
    outside = F.greatest(gap - 1e-7 * (1 + F.col("high") + F.col("most")), F.lit(0.0))
    nearest = distance(F.col("own_rare") + F.col("rare") + outside * outside / 2, metric)
    return (
        open_pivots.join(shards, "cluster")
        .filter(nearest <= F.col("reached") + _SLACK)
        .select("q_block", "shard")
    )


def _least_gap(away, least, most, rare):
    """What a shard adds to the gap of a query at least, by the query's distance to the shard's pivot."""
    beyond = np.maximum(away - most, least - away) - 1e-7 * (1 + away + most)
    return rare + np.maximum(beyond, 0.0) ** 2 / 2


def _parts(rows: DataFrame) -> DataFrame:
    """block, part: blocks that lie side by side, together of bounded ids and entries."""
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.size("cells")).alias("entries"))
    numbered = save(with_position(blocks, ["block"], "number"), "parts")
    facts = numbered.agg(
        F.count("*").alias("blocks"), F.avg("n").alias("n"), F.max("entries").alias("entries")
    ).first()
    each = min(
        -(-facts.blocks // blocked.BLOCKS), _BLOCKS_A_PART, int(blocked.WIDE_ROWS / facts.n),
        blocked.BLOCK_ENTRIES // facts.entries,
    )
    return numbered.select("block", F.floor((F.col("number") - 1) / max(1, each)).alias("part"))


def _score_visits(problem, facing, base_cells, visits, pivots):
    """Score the visits, part by part, keeping the best of each query in a part of the shards."""
    base_parts = _parts(base_cells)
    parts = base_parts if problem.symmetric else _parts(facing)
    rows, columns = (
        p.select(F.col("block").alias(block), F.col("part").alias(part))
        for p, block, part in ((parts, "q_block", "row"), (base_parts, "shard", "column"))
    )
    tasks = save(visits.join(rows, "q_block").join(columns, "shard").select("row", "column").distinct(), "tasks")
    # A task each: they are large by what they compute and not by what they read.
    count = max(1, tasks.count())

    def copies(side, own, block, part, carried):
        names = ["idx", "sq", "cells", "block", "rare", *carried]
        dealt = side.join(own.withColumnRenamed(block, "block"), "block").join(tasks, part)
        # Named afresh: both sides of the cogroup may come from the same tables.
        dealt = dealt.select("row", "column", *[F.col(c).alias(c) for c in names])
        return dealt.repartition(count, "row", "column")

    asked = copies(facing, rows, "q_block", "row", ["reached", "seen"])
    offered = copies(base_cells, columns, "shard", "column", ["cluster", "away"])
    keep, metric = problem.keep, problem.metric

    def score(queries: pa.Table, base: pa.Table) -> pa.Table:
        return _best_of_parts(queries, base, pivots, keep, metric)

    return (
        asked.groupBy("row", "column")
        .cogroup(offered.groupBy("row", "column"))
        .applyInArrow(score, _SCORED)
    )


def _best_of_parts(queries: pa.Table, base: pa.Table, pivots: Pivots, keep: int, metric: str) -> pa.Table:
    queries, base = (side.sort_by([("block", "ascending"), ("idx", "ascending")]) for side in (queries, base))
    reached = queries.column("reached").to_numpy()
    limit = reached if metric == "cosine" else reached * reached / 2
    scorer = Scorer(Vectors.of(queries), Vectors.of(base), keep, metric, limit)
    own_rare = queries.column("rare").to_numpy()
    seen = queries.column("seen").combine_chunks()
    seen_row = np.repeat(np.arange(len(seen)), seen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    seen = seen.flatten().to_numpy()
    away, rare = base.column("away").to_numpy(), base.column("rare").to_numpy()
    shards = [
        (shard, low, high, base.column("cluster")[low].as_py(), away[low:high].min(), away[low:high].max(),
         rare[low:high].min())
        for shard, low, high in _spans(base.column("block").to_numpy())
    ]
    for _, q_low, q_high in _spans(queries.column("block").to_numpy()):
        mine = pivots.distances_of(scorer.queries.part(q_low, q_high))
        bounds = [own_rare[q_low:q_high] + _least_gap(mine[:, c], *facts) for _, _, _, c, *facts in shards]
        # The likeliest first: what they give rules out others.
        for i in np.argsort([bound.mean() for bound in bounds], kind="stable"):
            shard, low, high = shards[i][:3]
            rows = np.arange(q_low, q_high)
            open_ = bounds[i] <= scorer.reach(rows)
            before = seen_row[seen == shard]
            open_[before[(before >= q_low) & (before < q_high)] - q_low] = False
            if open_.any():
                scorer.scan(low, high, rows[open_])
    return pa.table(dict(zip(("q", "n", "gap"), scorer.nearest())))


def _spans(blocks: np.ndarray):
    """(block, first row, row after the last) of each block of sorted rows."""
    firsts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
    return zip(blocks[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(blocks)])


def _score(problem, query_cells, base_cells, visits):
    """Score query blocks against the shards they visit, keeping the best of each."""
    own = visits.select(F.col("rep").alias("idx"), "q_block", "shard")
    asked = query_cells.join(own, "idx")
    tasks = visits.select("q_block", "shard").distinct()
    offered = base_cells.withColumnRenamed("block", "shard").join(tasks, "shard")
    # Named afresh: both sides of the cogroup may come from the same tables.
    columns = [F.col(c).alias(c) for c in ("q_block", "shard", "idx", "sq", "cells")]
    keep, metric = problem.keep, problem.metric

    def score(queries: pa.Table, base: pa.Table) -> pa.Table:
        return blocked.best_of_strips(Vectors.of(queries), Vectors.of(base), keep, metric)

    return (
        asked.select(*columns)
        .groupBy("q_block", "shard")
        .cogroup(offered.select(*columns).groupBy("q_block", "shard"))
        .applyInArrow(score, _SCORED)
    )


def best_of_block(queries: pd.DataFrame, base: pd.DataFrame, keep: int, metric: str) -> pd.DataFrame:
    """The ``keep`` nearest base ids of each query in one block, given as entries, by hot features alone."""
    scorer = Scorer(_vectors(queries), _vectors(base), keep, metric)
    scorer.scan(0, len(scorer.base.ids))
    return pd.DataFrame(dict(zip(("q", "n", "gap"), scorer.nearest())))


def _vectors(entries: pd.DataFrame) -> Vectors:
    ids, first, row = np.unique(entries["idx"].to_numpy(), return_index=True, return_inverse=True)
    by_row = np.argsort(row, kind="stable")
    fid, w = entries["fid"].to_numpy()[by_row], entries["w"].to_numpy()[by_row]
    return Vectors(ids, entries["sq"].to_numpy()[first], row[by_row], fid, w)


def _dots(queries, base, n_features):
    """Dot products of two sets of sparse rows as a full matrix, by whichever way is less work."""
    row, f_q, w_q, n_rows = queries
    column, f_n, w_n, n_columns = base
    dots = np.zeros((n_rows, n_columns))
    meetings = np.bincount(f_q, minlength=n_features) @ np.bincount(f_n, minlength=n_features)
    if n_rows * n_columns * n_features < _DENSE_GAIN * meetings:
        for low in range(0, n_features, _DENSE_FEATURES):
            width = min(_DENSE_FEATURES, n_features - low)
            left, right = np.zeros((n_rows, width)), np.zeros((n_columns, width))
            for matrix, i, f, w in ((left, row, f_q, w_q), (right, column, f_n, w_n)):
                here = (f >= low) & (f < low + width)
                matrix[i[here], f[here] - low] = w[here]
            dots += left @ right.T
        return dots
    spans = np.searchsorted(f_n, np.arange(n_features + 1))
    by_feature = np.argsort(f_q, kind="stable")
    starts = np.searchsorted(f_q[by_feature], np.arange(n_features + 1))
    for f in np.unique(f_q):
        own = by_feature[starts[f] : starts[f + 1]]
        there = slice(spans[f], spans[f + 1])
        dots[row[own][:, None], column[there]] += w_q[own][:, None] * w_n[there]
    return dots

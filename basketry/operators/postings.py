"""Dot products over features that few ids have, complete for a query before anything leaves its task.

The base ids of a feature, at most ``hot_degree`` of them, are collected as one list. A copy of the list goes to every
query that has the feature, packed (``Packing``), since these copies are most of what is shuffled; a task holds all lists of its queries, adds up the products, some
queries at a time, and lets go of all but the ``keep`` nearest of each. So a pair of ids is a number in an array and
never a row: it is neither shuffled again to be summed up nor sorted to be ranked.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a task is to meet, and pairs whose lists it holds before they are added up.
_PAIRS_PER_TASK, _HELD = 4_000_000, 8_000_000
#: Bits for the place of a pair and for the query in a chunk that is added up at once: with 32 for the id, 63.
_PLACE_BITS, _QUERY_BITS = 17, 14

#: Different numbers that are sent as two bytes each.
_CODES = 1 << 16

_SCORED = "q long, n long, gap double"


def posting_candidates(problem, known: dict[str, DataFrame | None], pairs: float) -> DataFrame:
    """The ``keep`` nearest of each query among those that share a feature: q, n, gap.

    On a feature that both sides have, either has at most a bounded number of ids. ``known`` names these features for
    the sides (``queries``, ``base``) of which most entries have others; with none, all entries of a side are dealt.
    """
    euclidean = problem.metric == "euclidean"
    # Numbers of ids are dense, so 32 bits do for them in the lists.
    listed = [F.col("idx").cast("int").alias("n"), "w", *(["sq"] if euclidean else [])]
    tasks = 1 + int(pairs) // _PAIRS_PER_TASK

    def dealt(side):
        rows = getattr(problem, side)
        if not problem.symmetric:
            rows = rows.filter(F.col("feature").isNotNull())
        if known.get(side) is not None:
            rows = rows.join(known[side], "feature", "left_semi")
        return rows.repartition(tasks, "feature") if tasks > 1 else rows

    packing = Packing.of(problem.base, listed[1:])

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        return packing.packed(lists)

    offered = dealt("base").groupBy("feature").agg(F.collect_list(F.struct(*listed)).alias("base"))
    # A step of its own, before the lists are copied: Python sees each once.
    offered = offered.select("feature", "base", pack("base").alias("packed"))
    if problem.symmetric:
        met = offered.select("packed", F.inline("base"))
    else:
        offered = offered.select("feature", "packed")
        met = dealt("queries").select("feature", *listed).join(offered, "feature")
    met = met.select(
        F.col("n").alias("q"), F.col("w").alias("q_w"), *([F.col("sq").alias("q_sq")] if euclidean else []), "packed"
    )
    keep, metric = problem.keep, problem.metric

    def nearest(batches):
        held = _Held(keep, metric)
        for batch in batches:
            held.add(packing.unpacked(batch))
        yield from held.nearest()

    return met.repartition(tasks, "q").mapInArrow(nearest, _SCORED)


@dataclass(frozen=True)
class Packing:
    """Lists of (n, numbers) as bytes. Ids are sorted and sent as differences; numbers of which there are few are sent as
    codes of two bytes, the frequent ones first, others as they are. A list holds the first bytes of all its values, then the
    second ones and so on, so that those that are nearly always zero compress well."""

    codes: dict[str, np.ndarray | None]  # by column: the numbers in the order of their codes

    @staticmethod
    def of(entries: DataFrame, columns) -> "Packing":
        counted = entries.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()

        def known(column):
            if counted[column] > _CODES * 0.9:
                return None
            # Few enough by the estimate; as many as there are codes, and one, at most.
            found = entries.groupBy(column).count().orderBy(F.desc("count"), column).limit(_CODES + 1).collect()
            return np.array([row[0] for row in found], dtype=float) if len(found) <= _CODES else None

        return Packing({c: known(c) for c in columns})

    def packed(self, lists: pa.Array) -> pa.Array:
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, *numbers = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
        row = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((ids, row))
        ids = ids[order].astype(np.int64)
        differences = np.diff(ids, prepend=0)
        first = (np.cumsum(counts) - counts)[counts > 0]
        differences[first] = ids[first]
        planes = [_bytes(differences.astype("<u4"))]
        for values, known in zip(numbers, self.codes.values()):
            values = values[order]
            if known is not None:
                by_value = np.argsort(known)
                values = by_value[np.searchsorted(known[by_value], values)].astype("<u2")
            planes.append(_bytes(values))
        planes = np.hstack(planes)
        out = np.empty(planes.size, dtype=np.uint8)
        for plane, at in enumerate(_places(counts, planes.shape[1])):
            out[at] = planes[:, plane]
        offsets = np.append(0, np.cumsum(counts * planes.shape[1])).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])

    def unpacked(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The lists as columns ``n``, ``n_w`` and, if squares are sent, ``n_sq``."""
        lists = batch.column("packed")
        sizes = [4, *(2 if known is not None else 8 for known in self.codes.values())]
        ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        counts = np.diff(ends) // sum(sizes)
        found = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        planes = np.empty((counts.sum(), sum(sizes)), dtype=np.uint8)
        for plane, at in enumerate(_places(counts, sum(sizes))):
            planes[:, plane] = found[at]
        parts = np.split(planes, np.cumsum(sizes)[:-1], axis=1)
        ids = np.cumsum(np.ascontiguousarray(parts[0]).view("<u4")[:, 0].astype(np.int64))
        # The differences run on from list to list; each starts anew.
        starts = np.cumsum(counts) - counts
        before = np.append(0, ids)[starts]
        columns = {"n": (ids - np.repeat(before, counts)).astype(np.int32)}
        for part, (name, known) in zip(parts[1:], self.codes.items()):
            part = np.ascontiguousarray(part)
            columns[f"n_{name}"] = part.view("<f8")[:, 0] if known is None else known[part.view("<u2")[:, 0]]
        offsets = np.append(starts, counts.sum()).astype(np.int32)
        rest = {c: batch.column(c) for c in batch.schema.names if c != "packed"}
        return pa.record_batch(rest | {c: pa.ListArray.from_arrays(offsets, v) for c, v in columns.items()})


def _bytes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)


def _places(counts: np.ndarray, planes: int):
    """Where each byte of the values stands in the lists, one byte of all values after the other."""
    starts = np.cumsum(counts) - counts
    size = np.repeat(counts, counts)
    at = np.arange(len(size)) + np.repeat((planes - 1) * starts, counts)
    for _ in range(planes):
        yield at
        at = at + size


class _Held:
    """Lists of base ids that queries meet. A part is (key, dot) and, for Euclidean distances, half the squares' sum:
    one row a pair, in the order of the key, which is the query's number above the base id's."""

    def __init__(self, keep: int, metric: str):
        self.keep, self.metric = keep, metric
        self.batches, self.held = [], 0
        self.parts, self.size, self.merged = [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        """One batch of (q, q_w, n, n_w) and, for Euclidean distances, (q_sq, n_sq)."""
        lists = batch.column("n")
        rows = [lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("q").to_numpy()]
        cells = [lists.flatten().to_numpy(), batch.column("n_w").flatten().to_numpy()]
        rows.append(batch.column("q_w").to_numpy())
        if self.metric == "euclidean":
            rows.append(batch.column("q_sq").to_numpy())
            cells.append(batch.column("n_sq").flatten().to_numpy())
        self.batches.append((rows, cells))
        self.held += len(cells[0])
        if self.held >= _HELD:
            self._sum()
            # What is merged already is not taken up again until as much has come.
            if self.size >= _HELD + 2 * self.merged:
                self._merge()

    def _sum(self) -> None:
        for part in self._chunks():
            self.parts.append(part)
            self.size += len(part[0])

    def _chunks(self):
        """The lists that are held, added up: parts of whole queries in their order, as far as they are held."""
        batches, self.batches, self.held = self.batches, [], 0
        if not batches:
            return
        counts, q, *values = (np.concatenate(column) for column in zip(*(rows for rows, _ in batches)))
        cells = [np.concatenate(column) for column in zip(*(cells for _, cells in batches))]
        del batches
        starts = np.cumsum(counts) - counts
        order = np.argsort(q, kind="stable")
        counts, q, starts = counts[order], q[order].astype(np.int64), starts[order]
        values = [value[order] for value in values]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rows_to = np.append(first[1:], len(q))
        pairs_to = np.cumsum(counts)[rows_to - 1]
        low = 0
        while low < len(first):
            before = pairs_to[low - 1] if low else 0
            # Whole queries up to the bound, one at least.
            high = int(np.searchsorted(pairs_to, before + (1 << _PLACE_BITS), side="right"))
            high = max(low + 1, min(high, low + (1 << _QUERY_BITS)))
            rows = slice(first[low], rows_to[high - 1])
            low = high
            mine, total = counts[rows], int(counts[rows].sum())
            if not total:
                continue
            ends = np.cumsum(mine)
            place = np.arange(total)
            at = np.repeat(starts[rows] - (ends - mine), mine) + place
            asked, numbers = np.repeat(q[rows], mine), cells[0][at].astype(np.int64)
            key = (asked << 32) | numbers
            if total <= 1 << _PLACE_BITS:
                # The place is sorted along with the key, which is faster than sorting places by it.
                within = np.repeat(np.cumsum(np.diff(q[rows], prepend=q[rows][0]) > 0), mine)
                packed = (((within << 32) | numbers) << _PLACE_BITS) | place
                packed.sort()
                order = packed & ((1 << _PLACE_BITS) - 1)
            else:
                order = np.argsort(key, kind="stable")
            part = [key, np.repeat(values[0][rows], mine) * cells[1][at]]
            if self.metric == "euclidean":
                part.append((np.repeat(values[1][rows], mine) + cells[2][at]) / 2)
            yield _added(part, order)

    def _merge(self) -> None:
        if len(self.parts) > 1:
            whole = [np.concatenate(column) for column in zip(*self.parts)]
            self.parts = [_added(whole, np.argsort(whole[0], kind="stable"))]
        self.size = self.merged = len(self.parts[0][0]) if self.parts else 0

    def nearest(self):
        """The ``keep`` nearest of each query by (distance, id), in batches."""
        if self.parts:
            self._sum()
            self._merge()
            parts, self.parts = self.parts, []
        else:
            parts = self._chunks()
        found = [self._nearest(*part) for part in parts]
        if found:
            q, n, gap = (np.concatenate(column) for column in zip(*found))
            yield from pa.table({"q": q, "n": n, "gap": gap}).to_batches(max_chunksize=65_536)

    def _nearest(self, key, dot, half=1.0):
        gap = half - dot
        clean = np.floor(np.maximum(gap, 0.0) * 1e12 + 0.5) / 1e12
        dist = clean if self.metric == "cosine" else np.sqrt(2.0 * clean)
        dist = np.floor(dist * 1e8 + 0.5) / 1e8
        q = key >> 32
        near = np.flatnonzero(self._near(q, dist))
        # A stable sort: among equals the pairs stay in the order of their ids.
        order = near[np.lexsort((dist[near], q[near]))]
        mine = q[order]
        order = order[np.arange(len(mine)) - np.searchsorted(mine, mine) < self.keep]
        return q[order], key[order] & 0xFFFFFFFF, gap[order]

    def _near(self, q: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Whether a pair is no farther than the ``keep``-th of its query; all pairs of a query with few."""
        near = np.ones(len(q), dtype=bool)
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        ends = np.append(starts[1:], len(q))
        many = ends - starts > 8 * self.keep
        for low, high in zip(starts[many].tolist(), ends[many].tolist()):
            mine = dist[low:high]
            near[low:high] = mine <= np.partition(mine, self.keep - 1)[self.keep - 1]
        return near


def _added(part, order):
    """Pairs with their products added up, in the given order, which is that of their keys."""
    key, dot, *half = (column[order] for column in part)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return [key[first], np.add.reduceat(dot, first), *[column[first] for column in half]]

"""The nearest of a block of vectors in another block, for tasks that hold both.

Most pairs are told apart by a matrix product in single precision: a pair is looked at again, in double precision, only
if it could belong to the ``keep`` nearest of its query, with room for what single precision can be wrong by.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Cells of one matrix of scores, and of the vectors written out as a matrix; wider ones are scored through an index.
_TILE, _DENSE_CELLS = 1 << 19, 8_000_000
#: Pairs that are looked at again at once, at most and, whatever the number of queries, at least.
_PAIRS, _FEW_PAIRS = 2_000_000, 50_000


@dataclass(frozen=True)
class Vectors:
    """Sparse rows: ids and squared lengths, and of each entry the row (in order), the feature and the weight."""

    ids: np.ndarray
    sq: np.ndarray
    row: np.ndarray
    fid: np.ndarray
    w: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> "Vectors":
        """Rows of (idx, sq, cells), as ``blocked.packed`` makes them."""
        cells = table.column("cells").combine_chunks()
        counts = cells.value_lengths().to_numpy(zero_copy_only=False)
        fid, w = cells.flatten().flatten()
        return Vectors(
            table.column("idx").to_numpy(), table.column("sq").to_numpy(),
            np.repeat(np.arange(len(counts)), counts), fid.to_numpy(), w.to_numpy(),
        )

    def part(self, low: int, high: int) -> "Vectors":
        here = slice(*np.searchsorted(self.row, (low, high)))
        return Vectors(self.ids[low:high], self.sq[low:high], self.row[here] - low, self.fid[here], self.w[here])


def rounded_distance(gap: np.ndarray, metric: str) -> np.ndarray:
    """Distances on the grid that ranking uses, as ``neighbors.distance`` in tasks."""
    clean = np.floor(np.maximum(gap, 0.0) * 1e12 + 0.5) / 1e12
    dist = clean if metric == "cosine" else np.sqrt(2.0 * clean)
    return np.floor(dist * 1e8 + 0.5) / 1e8


class Scorer:
    """The ``keep`` nearest of each query among the base rows that are scanned; ties go to the smaller id.

    ``limit``: gaps beyond which a pair is not wanted, a number a query.
    """

    def __init__(self, queries: Vectors, base: Vectors, keep: int, metric: str, limit=None):
        self.queries, self.base, self.keep, self.metric = queries, base, keep, metric
        shape = (len(queries.ids), keep)
        self.n, self.gap, self.dist = np.full(shape, -1), np.full(shape, np.inf), np.full(shape, np.inf)
        self.limit = np.full(shape[0], np.inf) if limit is None else limit.astype(float)
        self.fids = np.intersect1d(queries.fid, base.fid)
        self.left, self.right = self._known(queries), self._known(base)
        self.kept, self.size = [], 0
        self.most = min(_PAIRS, max(_FEW_PAIRS, shape[0] * keep // 2))
        self.dense = self._written_out()

    def _known(self, side: Vectors):
        """(row, place of the feature, weight) of the entries on features of both sides, by row."""
        here = np.isin(side.fid, self.fids)
        return side.row[here], np.searchsorted(self.fids, side.fid[here]), side.w[here]

    def _written_out(self):
        """Both sides as matrices in single and double precision, or None where an index is less work."""
        from basketry.operators import hot_features

        (_, f_q, w_q), (_, f_n, w_n) = self.left, self.right
        rows, columns, width = len(self.queries.ids), len(self.base.ids), len(self.fids)
        if not width:
            return None
        meetings = np.bincount(f_q, minlength=width) @ np.bincount(f_n, minlength=width)
        if (rows + columns) * width > _DENSE_CELLS or rows * columns * width >= hot_features._DENSE_GAIN * meetings:
            return None
        sides = []
        scale = max(w_q.max(), w_n.max())
        # Products of weights so far apart would vanish in single precision.
        if not np.isfinite(scale) or min(w_q.min(), w_n.min()) < 1e-12 * scale:
            return None
        for (row, f, w), count in ((self.left, rows), (self.right, columns)):
            exact = np.zeros((count, width))
            exact[row, f] = w
            sides.append((exact, (exact / scale).astype(np.float32)))
        self.scale = scale * scale
        return sides

    def scan(self, low: int, high: int, rows: np.ndarray | None = None) -> None:
        """Meet the base rows from ``low`` to ``high``: all queries, or those numbered ``rows``."""
        from basketry.operators import hot_features

        if high <= low or not len(self.fids):
            return
        rows = np.arange(len(self.queries.ids)) if rows is None else rows
        half = self.base.sq[low:high] / 2
        step = max(1, min(_TILE, hot_features._CELLS) // (high - low))
        for first in range(0, len(rows), step):
            own = rows[first : first + step]
            r, c, dot = self._likely(own, low, high, half)
            self.kept.append((own[r], c + low, dot))
            self.size += len(r)
            if self.size > self.most:
                self._take()

    def _likely(self, own, low, high, half):
        """(query, column, dot product if it is exact) of the pairs of a tile that can belong to the nearest."""
        if self.dense:
            dots = self.dense[0][1][own] @ self.dense[1][1][low:high].T
            # By how much single precision can be wrong: a dot product is at most half the sum of the squares.
            wrong = (len(self.fids) + 8) * 1.2e-7 * (self.queries.sq[own] + 2 * half.max())
            scale, half = self.scale, (half / self.scale).astype(np.float32)
        else:
            dots, wrong, scale = self._dots(own, low, high), np.zeros(len(own)), 1.0
        near = dots if self.metric == "cosine" else dots - half
        if self.metric == "cosine":
            half = half[0]
        far = self.reach(own)
        open_ = np.flatnonzero(np.isinf(far))
        if len(open_) and near.shape[1] > self.keep:
            scores = np.where(dots[open_] > 0, near[open_], -np.inf)
            last = np.partition(scores, -self.keep, axis=1)[:, -self.keep].astype(float) * scale
            if self.metric == "cosine":
                last -= half * scale
            far[open_] = _room(self.queries.sq[own[open_]] / 2 - last + wrong[open_])
        least = (self.queries.sq[own] / 2 - far - wrong) / scale
        if self.metric == "cosine":
            least = np.maximum(least + half, np.finfo(np.float32).tiny)
        # Rounded down, so that no pair is lost by the threshold itself.
        least = np.nextafter(least.astype(dots.dtype), -np.inf)[:, None] if self.dense else least[:, None]
        likely = near >= least
        if self.metric != "cosine" or not self.dense:
            likely &= dots > 0
        r, c = np.divmod(_places(likely), high - low)
        return r, c, None if self.dense else dots[r, c]

    def reach(self, own):
        """The gap up to which a pair can still be one of the nearest, or be equal to the last of them."""
        return _room(np.minimum(self.gap[own, -1], self.limit[own]))

    def _dots(self, own, low, high):
        from basketry.operators import hot_features

        row, f, w = self.left
        if len(own) == own[-1] - own[0] + 1:
            here = slice(*np.searchsorted(row, (own[0], own[-1] + 1)))
            mine = row[here] - own[0], f[here], w[here], len(own)
        else:
            here = np.isin(row, own)
            mine = np.searchsorted(own, row[here]), f[here], w[here], len(own)
        row, f, w = self.right
        here = slice(*np.searchsorted(row, (low, high)))
        by_feature = np.argsort(f[here], kind="stable")
        theirs = (row[here] - low)[by_feature], f[here][by_feature], w[here][by_feature], high - low
        return hot_features._dots(mine, theirs, len(self.fids))

    def _take(self) -> None:
        kept, self.kept, self.size = self.kept, [], 0
        if not kept:
            return
        r, c = (np.concatenate(side) for side in list(zip(*kept))[:2])
        if not len(r):
            return
        dot = self._exact(r, c) if self.dense else np.concatenate([dot for _, _, dot in kept])
        gap = (self.queries.sq[r] + self.base.sq[c]) / 2 - dot
        wanted = (dot > 0) & (gap <= self.reach(r))
        r, n, gap = r[wanted], self.base.ids[c[wanted]], gap[wanted]
        dist = rounded_distance(gap, self.metric)
        met, k = np.unique(r), self.keep
        # What the queries have already, with those that are new; places that are empty come last.
        r = np.concatenate([np.repeat(met, k), r])
        n, gap, dist = (
            np.concatenate([old[met].ravel(), new]) for old, new in ((self.n, n), (self.gap, gap), (self.dist, dist))
        )
        order = np.lexsort((n, dist, r))
        r = r[order]
        order = order[np.arange(len(r)) - np.searchsorted(r, r) < k].reshape(len(met), k)
        self.n[met], self.gap[met], self.dist[met] = n[order], gap[order], dist[order]

    def _exact(self, r, c):
        left, right = self.dense[0][0], self.dense[1][0]
        step = max(1, _DENSE_CELLS // left.shape[1])
        parts = range(0, len(r), step)
        return np.concatenate([np.einsum("ij,ij->i", left[r[i : i + step]], right[c[i : i + step]]) for i in parts])

    def nearest(self):
        """(q, n, gap) of all queries, nearest first."""
        self._take()
        row, place = np.nonzero(np.isfinite(self.dist))
        return self.queries.ids[row], self.n[row, place], self.gap[row, place]


def _room(gap):
    """With room for gaps that are larger by less than the grid of the distances."""
    return gap + 2e-8 * (1 + np.sqrt(2 * np.maximum(gap, 0.0)))


def _places(likely: np.ndarray) -> np.ndarray:
    """``flatnonzero``, of which most are False: eight at once."""
    flat = likely.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    which, bit = np.nonzero(flat.reshape(-1, 8)[some])
    return some[which] * 8 + bit

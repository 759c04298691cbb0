"""Sets of word n-grams as sorted 64-bit hashes, and what several sets have in common."""

import numpy as np

from basketry.llm.words import mixed


def gram_sets(words, n: int):
    """The different n-grams of each text, sorted; (grams, bounds). A shorter text is one gram."""
    hashes, whole = words.grams(n)
    at = np.flatnonzero(whole)
    rows, grams = words.row[at], hashes[at]
    counts = np.diff(words.bound)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        totals = []
        for row in short:
            own = words.code[words.bound[row] : words.bound[row + 1]]
            totals.append(mixed(np.cumsum(own, dtype=np.uint64) * np.uint64(len(own) + 7))[-1])
        rows = np.concatenate([rows, short])
        grams = np.concatenate([grams, np.array(totals, dtype=np.uint64)])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    rows, grams = rows[new], grams[new]
    return grams, np.searchsorted(rows, np.arange(len(words.bound)))


def shared_counts(grams: np.ndarray, member: np.ndarray, count: int) -> np.ndarray:
    """Number of common grams of all pairs of ``count`` sets, given as entries (gram, member)."""
    order = np.lexsort((member, grams))
    grams, member = grams[order], member[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(grams)])
    out = np.zeros((count, count), dtype=np.int64)
    full = sizes == count
    many = (sizes * 2 > count) & ~full
    lacking = np.zeros(count, dtype=np.int64)
    groups = []
    for start, size in zip(starts[many], sizes[many]):
        absent = np.ones(count, dtype=bool)
        absent[member[start : start + size]] = False
        absent = np.flatnonzero(absent)
        lacking[absent] += 1
        groups.append(absent)
    out += int(full.sum() + many.sum()) - lacking[:, None] - lacking[None, :]
    few = (sizes > 1) & ~many & ~full
    groups += [member[s : s + z] for s, z in zip(starts[few], sizes[few])]
    wide = [g for g in groups if len(g) > 48]
    for low in range(0, len(wide), 2048):
        part = wide[low : low + 2048]
        matrix = np.zeros((count, len(part)), dtype=np.float32)
        for i, g in enumerate(part):
            matrix[g, i] = 1
        out += (matrix @ matrix.T).astype(np.int64)
    flat = out.reshape(-1)
    by_size = {}
    for g in groups:
        if 0 < len(g) <= 48:
            by_size.setdefault(len(g), []).append(g)
    for part in by_size.values():
        part = np.array(part)
        for low in range(0, len(part), 4096):
            here = part[low : low + 4096]
            flat += np.bincount(
                (here[:, :, None] * count + here[:, None, :]).ravel(), minlength=count * count
            )
    return out


def least_linked(first, second, count: int) -> np.ndarray:
    """Least member that each of ``count`` members is linked with, directly or not."""
    root = np.arange(count)
    while True:
        before = root.copy()
        least = np.minimum(root[first], root[second])
        np.minimum.at(root, first, least)
        np.minimum.at(root, second, least)
        root = root[root]
        if (root == before).all():
            return root

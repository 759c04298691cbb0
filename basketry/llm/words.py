"""Words and word n-grams of many texts at once, with NumPy over the bytes of an Arrow column.

A-Z are lower-cased; words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. In UTF-8 every byte of a
character beyond ASCII is 0x80 or more, so the rule can be applied byte by byte.
"""

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[0x00:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False

#: Words of all bytes but white space.
NO_BLANKS = np.ones(256, dtype=bool)
NO_BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.random.default_rng(20).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = {}


def _power(base: int, length: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    if base not in _powers or len(_powers[base]) < length:
        steps = np.full(max(length, SLICE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:length]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit integers over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between each start and end."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    return mixed((total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start])


class Words:
    """The words of some texts, one after the other.

    ``start``, ``end``: bytes of a word in ``data``; ``row``: its text; ``edges``: bytes of a text; ``bound``: text i has the words
    from ``bound[i]`` to ``bound[i + 1]``; ``code``: a 64-bit hash of the word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _IN_WORD):
        data = _LOWER[raw]
        inside = in_word[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        opens[first], closes[last] = inside[first], inside[last]
        self.data, self.edges = data, offsets
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.bound = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bound))
        self.code = span_codes(data, self.start, self.end)

    def grams(self, n: int):
        """Hash of the n words from each word on, and whether they lie in one text."""
        count = len(self.code) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        out = np.zeros(count, dtype=np.uint64)
        for i in range(n):
            out += self.code[i : i + count] * _ODD[i]
        return mixed(out), self.row[:count] == self.row[n - 1 :]

    def text(self, first: int, n: int) -> str:
        """n words from this one on, separated by a blank."""
        return b" ".join(
            self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + n)
        ).decode("utf-8", "replace")


def slices(column: pa.Array, in_word: np.ndarray = _IN_WORD):
    """Pairs of (index of the first text, its Words) that cover the column; null counts as empty."""
    for first, data, offsets in raw_slices(column):
        yield first, Words(data, offsets, in_word)


def raw_slices(column: pa.Array):
    """(index of the first text, bytes, offsets) of some texts after the other; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        limit = np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right") - 1
        last = max(first + 1, min(int(limit), len(column)))
        here = offsets[first : last + 1]
        yield first, data[here[0] : here[-1]], here - here[0]
        first = last

"""Token ids of many texts with a fixed public vocabulary.

The vocabulary never joins characters across blanks and line ends, so a text's ids are those of its
blank-separated chunks in order; and it lower-cases, so a chunk of letters is looked up in lower case. A comma or
full stop after letters is a token of its own. Chunks repeat: the ids of a bounded number of them are kept,
found by the chunks' hashes with NumPy, and only new ones go through the tokenizer - runs of letters many in one
text, told apart by the mark of a word's end that their last piece has.
"""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa

from basketry.llm.words import raw_slices, span_codes

VOCABULARY = "word_bpe_49k.json"
#: Chunks kept per Python worker; when there are more, the table starts anew.
KEPT_CHUNKS = 1_000_000
_RUN = 2000
_SALT = np.uint64(0x5851F42D4C957F2D)
_encoders = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text where a text has them.
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.marks = np.concatenate([self._encode([mark])[0] for mark in ",."])
        self._restart()

    def _restart(self):
        """Codes of known chunks, sorted, with the place of their ids; the marks' ids come first."""
        self.codes = np.zeros(0, dtype=np.uint64)
        self.begin, self.size = np.zeros((2, 0), dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), len(self.marks)
        self.flat[: self.used] = self.marks

    def _encode(self, texts):
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in encoded]

    def _encode_letters(self, runs):
        """(all ids, how many each run has)."""
        ids, sizes = [], []
        for low in range(0, len(runs), _RUN):
            part = runs[low : low + _RUN]
            whole = self._encode([" ".join(part)])[0]
            stops = np.flatnonzero(self.ends_word[whole]) + 1
            if len(stops) == len(part) and stops[-1] == len(whole):
                ids.append(whole)
                sizes.append(np.diff(stops, prepend=0))
            else:
                single = self._encode(part)
                ids += single
                sizes.append(np.array([len(x) for x in single], dtype=np.int64))
        return ids, sizes

    def _learn(self, codes, letters, data, start, end):
        """Ids of new chunks: those of letters first, then the others."""
        order = np.argsort(~letters, kind="stable")
        raw = data.tobytes()
        spans = [
            raw[a:b].decode("utf-8", "replace")
            for a, b in zip(start[order].tolist(), end[order].tolist())
        ]
        runs = int(letters.sum())
        ids, sizes = self._encode_letters(spans[:runs])
        if runs < len(spans):
            single = self._encode(spans[runs:])
            ids += single
            sizes.append(np.array([len(x) for x in single], dtype=np.int64))
        joined = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
        size = np.concatenate(sizes).astype(np.int64)
        begin = self.used + np.cumsum(size) - size
        while self.used + len(joined) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(joined)] = joined
        self.used += len(joined)
        codes = np.concatenate([self.codes, codes[order]])
        sort = np.argsort(codes, kind="stable")
        self.codes = codes[sort]
        self.begin = np.concatenate([self.begin, begin])[sort]
        self.size = np.concatenate([self.size, size])[sort]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Token ids of each text of a slice of UTF-8 bytes."""
        lower = data.copy()
        lower[(data >= 65) & (data <= 90)] += 32
        # Letters: a-z and those of the Latin-1 block, which are 0xC3 and another byte.
        after = np.zeros(len(data), dtype=bool)
        after[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        lower[after & (data <= 0x9E)] += 32
        letter = ((lower >= 97) & (lower <= 122) & (data < 128)) | after
        letter[:-1] |= after[1:]
        inside = (data != 32) & (data != 10) & (data != 9) & (data != 13)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        opens[first], closes[last] = inside[first], inside[last]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        bound = np.searchsorted(start, offsets)

        other = np.concatenate([[0], np.cumsum(~letter)])
        mark = np.where(data[end - 1] == 44, 0, np.where(data[end - 1] == 46, 1, -1))
        mark[end - start < 2] = -1
        stop = np.where(mark >= 0, end - 1, end)
        letters = other[stop] == other[start]
        mark[~letters], stop[~letters] = -1, end[~letters]
        code = span_codes(lower, start, stop)
        if not letters.all():
            rest = np.flatnonzero(~letters)
            code[rest] = span_codes(data, start[rest], stop[rest]) ^ _SALT

        if len(self.codes) > KEPT_CHUNKS:
            self._restart()
        codes, one, at = np.unique(code, return_index=True, return_inverse=True)
        place = np.searchsorted(self.codes, codes)
        place[place == len(self.codes)] = 0
        known = self.codes[place] == codes if len(self.codes) else np.zeros(len(codes), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            pick = one[new]
            spelled = _spelled(lower, data, letters[pick], start[pick], stop[pick])
            self._learn(codes[new], letters[pick], spelled, start[pick], stop[pick])
            place = np.searchsorted(self.codes, codes)
        place = place[at]
        # Every chunk is its ids and, after them, those of its mark.
        begin = np.stack([self.begin[place], np.maximum(mark, 0)], axis=1).ravel()
        size = np.stack([self.size[place], (mark >= 0).astype(np.int64)], axis=1).ravel()
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(begin - (ends - size), size)]
        stops = np.concatenate([[0], ends])[2 * bound]
        return [flat[a:b] for a, b in zip(stops[:-1], stops[1:])]


def _spelled(lower, data, letters, start, end):
    """The slice in lower case, but as it was where a chunk of other characters stands."""
    if letters.all():
        return lower
    out = lower.copy()
    for a, b in zip(start[~letters].tolist(), end[~letters].tolist()):
        out[a:b] = data[a:b]
    return out


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker for this vocabulary file."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_of(column: pa.Array, path: str | None = None):
    """(index of the first text, ids of some texts) until the column is done; null counts as empty."""
    coder = encoder(path)
    for first, data, offsets in raw_slices(column):
        yield first, coder.ids(data, offsets)

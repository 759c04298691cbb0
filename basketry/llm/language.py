"""Language of a text by unigram models of word pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. A language gives every piece a probability; a word has the
probability of all ways to cut it into pieces together, which a forward pass over its bytes sums. A text has the
product over its words, and Bayes' rule with the shares of the languages gives the score.

Learning: a bounded sample (``SAMPLE`` texts a language, chosen by a hash, of at most ``SAMPLE_CHARS``
characters) goes to one task; expectation maximisation over all segmentations (forward-backward) fits the pieces
of each language, smoothed by those of all. The number of languages is that of the labels; a few of them are worked
on at a time, so memory does not grow with them but for the model itself.

Scoring: the vocabulary is a trie over bytes; all words of a slice that have not been met yet are walked
through at once with NumPy, and a worker keeps the scores of a bounded number of words.

Words are those of the other word operators (A-Z lower-cased), of any length: the sums are scaled every few bytes,
so they do not vanish. A character that the vocabulary lacks has a fixed small probability in every language.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; documents without a language teach nothing;
without any labelled document all are ``und``; a tie goes to the language that is first by name; repeated documents
get a row each; other columns are kept and not looked at.
"""

import pickle

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from basketry.llm import tables
from basketry.llm.words import slices

VOCABULARY = "piece_bpe_32k.model"
SAMPLE, SAMPLE_CHARS, HELD_OUT_PARTS = 400, 20_000, 3
_SHARDS = 64
KEPT_WORDS = 300_000
#: Sums are scaled at every so many bytes; words x bytes x languages of one pass.
_EVERY, _CELLS = 16, 1 << 21
_MARK = "▁".encode()
_UNKNOWN = 1e-7  # of a character, beside the pieces that have it
_ROUNDS, _SHARED = 4, 0.02
_loaded = {}


class Trie:
    """The pieces of a vocabulary by their bytes: ``step[node, byte]``, ``piece[node]`` (-1: none)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        children, piece = [{}], [-1]
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            node = 0
            for byte in model.id_to_piece(i).encode():
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    piece.append(-1)
                node = children[node][byte]
            piece[node] = i
        self.size = model.get_piece_size()
        self.piece = np.array(piece, dtype=np.int32)
        # How far ahead a piece, or a single character, reaches.
        self.reach = max(4, *(len(model.id_to_piece(i).encode()) for i in range(self.size)))
        used = sorted({byte for c in children for byte in c})
        self.column = np.zeros(256, dtype=np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.step = np.zeros(len(children) * self.width, dtype=np.int32)
        for node, below in enumerate(children):
            for byte, after in below.items():
                self.step[node * self.width + self.column[byte]] = after

    def matches(self, table: np.ndarray, length: np.ndarray):
        """For each start, lists of (end, words, pieces): the pieces that stand there in the words.

        ``table`` has a word per row, padded with 0; ``length`` its bytes.
        """
        columns = self.column[table]
        for start in range(int(length.max()) if len(length) else 0):
            alive = np.flatnonzero(length > start)
            node = np.zeros(len(alive), dtype=np.int32)
            found = []
            for end in range(start, table.shape[1]):
                column = columns[alive, end]
                node = self.step[node * self.width + column]
                on = (node > 0) & (column > 0) & (length[alive] > end)
                alive, node = alive[on], node[on]
                if not len(alive):
                    break
                piece = self.piece[node]
                hit = piece >= 0
                if hit.any():
                    found.append((end + 1, alive[hit], piece[hit]))
            yield start, found


def trie(path: str | None = None) -> Trie:
    """The trie of this Python worker for this vocabulary file."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = Trie(path)
    return _loaded[path]


def _char_ends(table, length):
    """Per byte position, the end of the character that begins there; 0 where none begins."""
    begins = (table & 0xC0) != 0x80
    begins &= np.arange(table.shape[1])[None, :] < length[:, None]
    size = np.where(table >= 0xF0, 4, np.where(table >= 0xE0, 3, np.where(table >= 0xC0, 2, 1)))
    end = np.minimum(np.arange(table.shape[1])[None, :] + size, length[:, None])
    return np.where(begins, end, 0)


def _scaled(values: np.ndarray) -> np.ndarray:
    """Divide (words, places, languages) in place by its greatest value a word and language; logs of those."""
    most = values.max(axis=1)
    most[most <= 0] = 1
    values /= most[:, None]
    return np.log(most)


def forward(vocabulary: Trie, table, length, chances, kept=None):
    """(log probability per word and language, alpha, its log scales by word and block of bytes, matches).

    ``chances``: (pieces, languages). ``kept``: the matches of an earlier call with these words.
    """
    count, languages = len(table), chances.shape[1]
    alpha = np.zeros((count, table.shape[1] + 1, languages))
    alpha[:, 0] = 1
    scale = np.zeros((count, table.shape[1] // _EVERY + 1, languages))
    ends = _char_ends(table, length)
    kept = list(vocabulary.matches(table, length)) if kept is None else kept
    for start, found in kept:
        if start and start % _EVERY == 0:
            logs = _scaled(alpha[:, start : start + vocabulary.reach + 1])
            scale[:, start // _EVERY :] += logs[:, None]
        rows = np.flatnonzero(ends[:, start])
        alpha[rows, ends[rows, start]] += alpha[rows, start] * _UNKNOWN
        for end, words, pieces in found:
            alpha[words, end] += alpha[words, start] * chances[pieces]
    rows = np.arange(count)
    total = np.log(np.maximum(alpha[rows, length], 1e-300)) + scale[rows, length // _EVERY]
    return total, alpha, scale, kept


def expected(vocabulary: Trie, table, length, chances, weight, kept=None):
    """Expected number of each piece in words that occur ``weight`` times each (words, languages)."""
    total, alpha, scale, kept = forward(vocabulary, table, length, chances, kept)
    rows = np.arange(len(table))
    beta = np.zeros_like(alpha)
    beta[rows, length] = 1
    behind = np.zeros_like(total)
    ends = _char_ends(table, length)
    out = np.zeros_like(chances)
    for start, found in reversed(kept):
        if (start + 1) % _EVERY == 0:
            # What a start reaches is in the scale of that start.
            behind += _scaled(beta[:, start + 1 : start + 1 + vocabulary.reach])
        factor = weight * np.exp(scale[:, start // _EVERY] + behind - total) * alpha[:, start]
        for end, words, pieces in found:
            part = chances[pieces] * beta[words, end]
            beta[words, start] += part
            np.add.at(out, pieces, factor[words] * part)
        there = np.flatnonzero(ends[:, start])
        beta[there, start] += _UNKNOWN * beta[there, ends[there, start]]
    return out


def _batches(sizes: np.ndarray, languages: int):
    """(indexes of words of similar length, languages at a time): bounded tables."""
    order = np.argsort(sizes, kind="stable")
    # Sorted by length, the last word of a batch is its widest; lengths are rounded up to powers of two.
    rounded = 1 << np.ceil(np.log2(sizes[order] + 1)).astype(np.int64)
    low = 0
    while low < len(order):
        most = max(1, _CELLS // 8 // int(rounded[low]))
        high = min(low + most, int(np.searchsorted(rounded, rounded[low], side="right")))
        at = order[low:high]
        yield at, max(1, min(languages, _CELLS // (len(at) * int(rounded[low]))))
        low = high


def _table(pieces: list[bytes]):
    """Words as rows of bytes, padded with 0, and their lengths."""
    length = np.array([len(p) for p in pieces], dtype=np.int64)
    width = int(length.max()) if len(pieces) else 0
    joined = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
    return joined.reshape(len(pieces), width), length


def learn(texts, langs, path: str | None = None):
    """(languages, log shares, chances of the pieces); None without a labelled text."""
    names = sorted({x for x in langs if x is not None})
    if not names:
        return None
    index = {name: i for i, name in enumerate(names)}
    row_lang = np.array([index[x] for x in langs])
    counts = {}
    for first, words in slices(pa.array(texts, pa.string())):
        lang = row_lang[first + words.row]
        raw = words.data.tobytes()
        for start, end, one in zip(words.start.tolist(), words.end.tolist(), lang.tolist()):
            cell = counts.setdefault(_MARK + raw[start:end], {})
            cell[one] = cell.get(one, 0) + 1
    vocabulary = trie(path)
    pieces = list(counts)
    weight = np.zeros((len(pieces), len(names)))
    for i, part in enumerate(pieces):
        for one, times in counts[part].items():
            weight[i, one] = times
    chances = np.full((vocabulary.size, len(names)), 1 / vocabulary.size)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    for _ in range(_ROUNDS):
        total = np.zeros_like(chances)
        for at, wide in _batches(sizes, len(names)):
            table, length = _table([pieces[i] for i in at])
            kept = list(vocabulary.matches(table, length))
            for one in range(0, len(names), wide):
                some = slice(one, one + wide)
                total[:, some] += expected(
                    vocabulary, table, length, chances[:, some], weight[at, some], kept
                )
        own = (total + 1e-3) / (total + 1e-3).sum(axis=0)
        every = total.sum(axis=1, keepdims=True) + 1e-2
        chances = (1 - _SHARED) * own + _SHARED * every / every.sum()
    shares = np.bincount(row_lang, minlength=len(names)) + 1.0
    return names, np.log(shares / shares.sum()), chances


class _Scorer:
    """Word scores of this worker: sorted word codes with a row of log probabilities each."""

    def __init__(self, chances, path):
        self.vocabulary, self.chances = trie(path), chances
        self._restart()

    def _restart(self):
        self.codes = np.zeros(0, dtype=np.uint64)
        self.scores = np.zeros((0, self.chances.shape[1]))

    def totals(self, words):
        """Sum of the word scores per text."""
        codes, first, at = np.unique(words.code, return_index=True, return_inverse=True)
        place = np.searchsorted(self.codes, codes)
        place[place == len(self.codes)] = 0
        known = self.codes[place] == codes if len(self.codes) else np.zeros(len(codes), bool)
        scores = np.empty((len(codes), self.chances.shape[1]))
        scores[known] = self.scores[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            scores[new] = self._score(words, first[new])
            if len(self.codes) + len(new) > KEPT_WORDS:
                self._restart()
            if len(new) <= KEPT_WORDS:
                joined = np.concatenate([self.codes, codes[new]])
                order = np.argsort(joined, kind="stable")
                self.codes = joined[order]
                self.scores = np.concatenate([self.scores, scores[new]])[order]
        out = np.zeros((len(words.bound) - 1, scores.shape[1]))
        filled = np.flatnonzero(np.diff(words.bound) > 0)
        if len(filled):
            out[filled] = np.add.reduceat(scores[at], words.bound[:-1][filled], axis=0)
        return out

    def _score(self, words, which):
        raw, languages = words.data.tobytes(), self.chances.shape[1]
        marked = [_MARK + raw[words.start[w] : words.end[w]] for w in which.tolist()]
        out = np.zeros((len(which), languages))
        for at, wide in _batches(np.array([len(p) for p in marked], dtype=np.int64), languages):
            table, length = _table([marked[i] for i in at])
            kept = None
            for one in range(0, languages, wide):
                some = slice(one, one + wide)
                found = forward(self.vocabulary, table, length, self.chances[:, some], kept)
                out[at, some], kept = found[0], found[3]
        return out


def sample(
    docs: DataFrame, parts: int = HELD_OUT_PARTS, rows: int = SAMPLE, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """At most ``rows`` texts of each language for learning: text and lang."""
    known = docs.filter(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & F.col("doc_id").isNotNull()
        & (F.length("text") <= chars)
        & ~tables.held_out("doc_id", parts)
    ).select("doc_id", "lang", "text", F.xxhash64("text").alias("key"))
    # Keys alone are ranked, first in shards of a language, so no task sees a whole language.
    by_hash = [F.xxhash64("doc_id"), "doc_id", "key"]
    shard = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(_SHARDS))
    in_shard = Window.partitionBy("lang", "shard").orderBy(*by_hash)
    in_all = Window.partitionBy("lang").orderBy(*by_hash)
    picked = (
        known.select("doc_id", "lang", "key", shard.alias("shard"))
        .distinct()
        .withColumn("rank", F.row_number().over(in_shard))
        .filter(F.col("rank") <= rows)
        .withColumn("rank", F.row_number().over(in_all))
        .filter(F.col("rank") <= rows)
        .select("doc_id", "lang", "key")
    )
    return known.join(picked, ["doc_id", "lang", "key"]).select("text", "lang").distinct()


def learn_from(docs: DataFrame, path: str | None = None, **bounds):
    """The model of a bounded sample, fitted in one task; only the model comes to the driver."""

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("text", "ascending"), ("lang", "ascending")])
        model = learn(table["text"].to_pylist(), table["lang"].to_pylist(), path)
        return pa.table({"model": [pickle.dumps(model)]})

    one = sample(docs, **bounds).groupBy(F.lit(1).alias("one"))
    found = one.applyInArrow(fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def identify(docs: DataFrame, model, path: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; the text is read, and kept as the other columns are."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = StructType(
        [docs.schema[c] for c in kept]
        + [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )
    place = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches):
        held = shared.value
        scorer = _Scorer(held[2], path) if held else None
        for batch in batches:
            lettered = np.array(batch.column(len(kept)).to_pylist(), dtype=bool)
            langs, scores = [], []
            for first, words in slices(batch.column(place)):
                count = len(words.bound) - 1
                here = lettered[first : first + count]
                if held is None:
                    langs += ["und"] * count
                    scores.append(np.zeros(count))
                    continue
                total = scorer.totals(words) + held[1]
                best = total.argmax(axis=1)
                chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                langs += [held[0][b] if ok else "und" for b, ok in zip(best, here)]
                scores.append(np.where(here, chance, 0.0))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(kept))],
                    pa.array(langs, pa.string()),
                    pa.array(np.concatenate(scores) if scores else np.zeros(0)),
                ],
                names=[f.name for f in schema.fields],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    return docs.select(*kept, lettered).mapInArrow(of_batches, schema)


def op10_language_id(spark, folder):
    docs = tables.read(spark, folder, "documents").select("doc_id", "text", "lang")
    model = learn_from(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", tables.held_out("doc_id", HELD_OUT_PARTS).alias("held_out"), "lang_pred", "score"
    )


QUERIES = {"op10_language_id": op10_language_id}

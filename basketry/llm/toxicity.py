"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Learning: a bounded sample of labelled documents (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` documents of at most
``SAMPLE_CHARS`` characters, chosen by a hash of the id) goes to one task. Labels are given per document, so
token labels come first: a word or word beginning is a mark of toxicity if it turns up in toxic documents
in far more different surroundings than chance allows (log likelihood ratio) and hardly ever in clean ones.
Surroundings are counted, not occurrences, so that copies of a document prove nothing. On windows of these
tokens a two-label chain is fitted by gradient steps on its likelihood (forward-backward). Features are the
word, its first 3 to 8 bytes, its end, and the words beside it.

Scoring: every text is tagged as a whole. Tokens of a slice of texts are cut into equal pieces; the 2 x 2
transfer matrices of the pieces are multiplied side by side, then chained, which is exact. The token
marginals give a document's highest log odds and expected number of toxic tokens, and a logistic curve fitted on
the sample turns these into the score. Spans are the tokens of marginal 0.5 or more, as code points.

Edge cases: a null or wordless text gets the score of a document without marks and no spans; labels that are
null, of unknown documents or contradictory (both 0 and 1: left out) teach nothing; without a document of either
label the score is 0; repeated documents get a row each; other columns are kept and not looked at.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from basketry.llm import tables
from basketry.llm.words import mixed, slices

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1000, 3000, 10_000
HELD_OUT_PARTS, THRESHOLD = 3, 0.7
ADDED = ("score", "predicted", "toxic_tokens", "spans")
_SIEVE = 1 << 22
_PREFIXES = (3, 4, 5, 6, 7, 8)
#: So many windows around marked tokens, and twice as many around tokens of clean documents, at most.
WINDOWS = 8000
_WINDOW, _EPOCHS, _STEPS, _BATCH, _RATE = 16, 12, 2000, 256, 0.3
_PIECE = 512


def _ends(words):
    """Hash of the word beginnings and the word's last three bytes; 0 where the word is shorter."""
    length = words.end - words.start
    out = []
    padded = np.concatenate([words.data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    value = np.zeros(len(length), dtype=np.uint64)
    for i in range(max(_PREFIXES)):
        value = value * np.uint64(257) + padded[words.start + i] + np.uint64(1)
        if i + 1 in _PREFIXES:
            out.append(np.where(length > i, mixed(value + np.uint64(i << 56)), np.uint64(0)))
    last = np.zeros(len(length), dtype=np.uint64)
    for i in (3, 2, 1):
        last = last * np.uint64(257) + padded[np.maximum(words.end - i, 0)]
    out.append(np.where(length >= 3, mixed(last + np.uint64(99 << 40)), np.uint64(0)))
    return out


def _beside(words):
    """Codes of the word before and after in the same text; 0 at its ends."""
    before, after = np.zeros((2, len(words.code)), dtype=np.uint64)
    same = words.row[1:] == words.row[:-1]
    before[1:] = np.where(same, words.code[:-1], np.uint64(0))
    after[:-1] = np.where(same, words.code[1:], np.uint64(0))
    return before, after


_KINDS = 1 + len(_PREFIXES) + 3


def _feature(words, kind: int) -> np.ndarray:
    """64-bit hashes of one kind of feature per token: word, beginnings, end, word before, word after; 0: none."""
    if kind == 0:
        hashes = words.code
    elif kind < _KINDS - 2:
        hashes = _ends(words)[kind - 1]
    else:
        hashes = _beside(words)[kind - _KINDS + 2]
    return np.where(hashes == 0, hashes, mixed(hashes + np.uint64((kind + 1) << 50)))


def _features(words) -> list[np.ndarray]:
    """All kinds of features, an array each."""
    hashes = [words.code, *_ends(words), *_beside(words)]
    return [
        np.where(h == 0, h, mixed(h + np.uint64((i + 1) << 50))) for i, h in enumerate(hashes)
    ]


def _chain(first_vector, matrices, resets, piece=_PIECE):
    """Normalised products v_t = v_(t-1) M_t; where ``resets``, v_(t-1) is put to ``first_vector``.

    The sequence is cut into pieces that are run side by side: once for their matrices, once for the rows.
    """
    count = len(matrices)
    length = min(piece, count)
    pieces = -(-count // length)
    padded = np.zeros((pieces * length, 2, 2))
    padded[:count] = matrices
    padded[count:] = np.eye(2)
    reset = np.flatnonzero(resets)
    # A reset makes the outcome independent of what came before: both rows become the start's.
    padded[reset] = np.einsum("i,nij->nj", first_vector, padded[reset])[:, None, :]
    steps = padded.reshape(pieces, length, 2, 2).transpose(1, 0, 2, 3).copy()
    product = np.broadcast_to(np.eye(2), (pieces, 2, 2)).copy()
    for step in steps:
        product = product @ step
        product /= product.sum(axis=(1, 2), keepdims=True)
    start = np.empty((pieces, 2))
    vector = first_vector / first_vector.sum()
    for i in range(pieces):
        start[i] = vector
        vector = vector @ product[i]
        vector = vector / vector.sum()
    out = np.empty((length, pieces, 2))
    now = start
    for i, step in enumerate(steps):
        now = now[:, :1] * step[:, 0, :] + now[:, 1:] * step[:, 1, :]
        now /= now.sum(axis=1, keepdims=True)
        out[i] = now
    return out.transpose(1, 0, 2).reshape(-1, 2)[:count]


class Chain:
    """A two-label chain: weights of the toxic label by feature, a bias, and log transition scores.

    ``keys`` are sorted feature hashes with ``weight`` beside them. A bit table sorts out most features
    that have no weight; the rest are looked up, so that no two features share a weight.
    """

    def __init__(self, keys):
        self.keys, self.weight = keys, np.zeros(len(keys))
        self.bias, self.move, self.curve = -4.0, np.zeros((2, 2)), np.zeros(4)
        self.sieve = None

    def places(self, hashes):
        """Index of each hash among the keys; len(keys) if it is none of them."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def prune(self):
        keep = np.abs(self.weight) > 0.02
        self.keys, self.weight = self.keys[keep], self.weight[keep]
        self.sieve = np.zeros(_SIEVE, dtype=bool)
        self.sieve[(self.keys % np.uint64(_SIEVE)).astype(np.int64)] = True

    def odds(self, features):
        out = np.full(len(features[0]), self.bias)
        for hashes in features:
            maybe = np.flatnonzero(self.sieve[(hashes % np.uint64(_SIEVE)).astype(np.int64)])
            at = self.places(hashes[maybe]) if len(self.keys) else maybe[:0]
            known = at < len(self.keys)
            out[maybe[known]] += self.weight[at[known]]
        return out

    def marginals(self, odds, opens, closes):
        """Probability of the toxic label per token; texts begin at ``opens`` and end at ``closes``."""
        if not len(odds):
            return np.zeros(0)
        emit = np.stack([np.ones(len(odds)), np.exp(np.clip(odds, -30, 30))], axis=1)
        move = np.exp(self.move)
        # Texts are independent: the first token of each starts from equal weights without a move.
        fresh = np.broadcast_to(np.eye(2), (len(odds), 2, 2)) * emit[:, None, :]
        forward = np.where(opens[:, None, None], fresh, move[None] * emit[:, None, :])
        ahead = _chain(np.ones(2), forward, opens)
        back = (move[None] * emit[1:, None, :]).transpose(0, 2, 1)
        steps = np.concatenate([back, np.eye(2)[None]])
        steps = np.where(closes[:, None, None], np.eye(2)[None], steps)
        behind = _chain(np.ones(2), steps[::-1], closes[::-1])[::-1]
        both = ahead * behind
        return both[:, 1] / both.sum(axis=1)

    def fit(self, windows, rng):
        """AdaGrad on the log likelihood of windows, given as groups of one length each.

        A group is (windows, tokens, places of features) and labels; a batch holds windows of one group.
        """
        count = len(self.keys)
        weight, squares = np.zeros(count + 1), np.full(count + 1, 1e-2)
        move_squares, bias_square = np.full((2, 2), 1e-2), 1e-2
        total = sum(len(labels) for _, labels in windows)
        batch = int(np.clip(total // 40, 16, _BATCH))
        for _ in range(max(_EPOCHS, _STEPS * batch // total)):
            orders = [rng.permutation(len(labels)) for _, labels in windows]
            parts = [(g, low) for g, order in enumerate(orders) for low in range(0, len(order), batch)]
            for turn in rng.permutation(len(parts)):
                group, low = parts[turn]
                features, labels = windows[group]
                at = orders[group][low : low + batch]
                part, gold = features[at], labels[at]
                node, edge = _window_marginals(weight[part].sum(axis=2) + self.bias, self.move)
                miss = (gold - node) / len(at)
                slope = np.bincount(
                    part.ravel(), np.repeat(miss.ravel(), part.shape[2]), minlength=count + 1
                )
                slope[count] = 0
                used = np.flatnonzero(slope)
                grad = slope[used] - 1e-6 * weight[used]
                squares[used] += grad**2
                weight[used] += _RATE * grad / np.sqrt(squares[used])
                bias_square += miss.sum() ** 2
                self.bias += _RATE * miss.sum() / np.sqrt(bias_square)
                seen = np.zeros((2, 2))
                np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
                grad = (seen - edge) / len(at)
                move_squares += grad**2
                self.move += _RATE * grad / np.sqrt(move_squares)
        self.weight = weight[:count]


def _window_marginals(odds, move):
    """Token marginals and the expected number of each move, over windows of one length."""
    count, length = odds.shape
    emit = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -30, 30))], axis=2)
    step = np.exp(move)
    ahead = np.empty((count, length, 2))
    now = emit[:, 0]
    ahead[:, 0] = now = now / now.sum(axis=1, keepdims=True)
    for i in range(1, length):
        now = (now @ step) * emit[:, i]
        ahead[:, i] = now = now / now.sum(axis=1, keepdims=True)
    behind = np.ones((count, length, 2))
    edge = np.zeros((2, 2))
    for i in range(length - 2, -1, -1):
        tail = emit[:, i + 1] * behind[:, i + 1]
        pair = ahead[:, i, :, None] * step[None] * tail[:, None, :]
        edge += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = tail @ step.T
        behind[:, i] = now / now.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both[:, :, 1] / both.sum(axis=2), edge


def _marked(feature, around, toxic) -> np.ndarray:
    """Tokens with a word or beginning that marks toxicity: many more surroundings than chance allows."""
    share = min(max(toxic.mean(), 1e-9), 1 - 1e-9)
    out = np.zeros(len(toxic), dtype=bool)
    for kind in range(1 + len(_PREFIXES)):
        hashes = feature(kind)
        case = mixed(hashes + around * np.uint64(0x9E3779B97F4A7C15) + toxic.astype(np.uint64))
        first = np.unique(case, return_index=True)[1]
        keys, at = np.unique(hashes[first], return_inverse=True)
        bad = np.bincount(at, toxic[first] == 1)
        good = np.bincount(at, toxic[first] == 0)
        both = bad + good
        ratio = bad * np.log(np.maximum(bad, 1) / (both * share))
        ratio += good * np.log(np.maximum(good, 1) / (both * (1 - share)))
        marks = keys[(ratio > 12) & (bad > 0.95 * both) & (keys > 0)]
        out |= np.isin(hashes, marks)
    return out


def _bounds(words):
    opens = np.zeros(len(words.code), dtype=bool)
    closes = opens.copy()
    filled = np.diff(words.bound) > 0
    opens[words.bound[:-1][filled]] = True
    closes[words.bound[1:][filled] - 1] = True
    return opens, closes


def _summary(words, marginals):
    """Per text: highest log odds, expected number of toxic tokens, its share; 0 tokens give the least."""
    count = len(words.bound) - 1
    high, total = np.full(count, 1e-9), np.zeros(count)
    filled = np.flatnonzero(np.diff(words.bound) > 0)
    if len(filled):
        cut = words.bound[:-1][filled]
        high[filled] = np.maximum.reduceat(marginals, cut)
        total[filled] = np.add.reduceat(np.where(marginals > 0.05, marginals, 0), cut)
    high = np.clip(high, 1e-9, 1 - 1e-9)
    return np.stack(
        [np.ones(count), np.log(high / (1 - high)), np.log1p(total), high], axis=1
    )


def _curve(inputs, toxic) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    out = np.zeros(inputs.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(inputs @ out, -30, 30)))
        grad = inputs.T @ (toxic - p) - 0.5 * out
        hess = (inputs * (p * (1 - p))[:, None]).T @ inputs + 0.5 * np.eye(len(out))
        out = out + np.linalg.solve(hess, grad)
    return out


def learn(texts, toxic) -> Chain | None:
    """A chain from texts with their labels (0 or 1); None without both labels."""
    toxic = np.asarray(toxic, dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    parts = list(slices(pa.array(texts, pa.string())))
    rows = np.concatenate([first + words.row for first, words in parts])

    def feature(kind):
        return np.concatenate([_feature(words, kind) for _, words in parts])

    around = mixed(feature(_KINDS - 2) * np.uint64(3) + feature(_KINDS - 1))
    gold = (_marked(feature, around, toxic[rows]) & (toxic[rows] == 1)).astype(np.int64)
    rng = np.random.default_rng(5)
    bad = rng.permutation(np.flatnonzero(gold))[:WINDOWS]
    free = rng.permutation(np.flatnonzero(toxic[rows] == 0))[: 2 * WINDOWS]
    centre = np.concatenate([bad, free])
    # A window at the edge of a text is moved into it; a text shorter than a window is one.
    first = np.searchsorted(rows, rows[centre])
    beyond = np.searchsorted(rows, rows[centre], side="right")
    low = np.maximum(first, np.minimum(centre - rng.integers(0, _WINDOW, len(centre)), beyond - _WINDOW))
    length = np.minimum(_WINDOW, beyond - first)
    places = [low[length == n][:, None] + np.arange(n) for n in np.unique(length)]
    inside = [[] for _ in places]
    for kind in range(_KINDS):
        # One kind at a time over the whole sample; what is kept is that of the windows.
        hashes = feature(kind)
        for cells, at in zip(inside, places):
            cells.append(hashes[at])
        del hashes
    joined = [f.ravel() for cells in inside for f in cells]
    keys, times = np.unique(np.concatenate(joined or [rows[:0]]), return_counts=True)
    model = Chain(keys[(times > 2) & (keys > 0)])
    if len(bad) and len(model.keys):
        windows = [
            (np.stack([model.places(f) for f in cells], axis=2), gold[at])
            for cells, at in zip(inside, places)
        ]
        model.fit(windows, rng)
    model.prune()
    inputs = np.concatenate(
        [
            _summary(words, model.marginals(model.odds(_features(words)), *_bounds(words)))
            for _, words in parts
        ]
    )
    model.curve = _curve(inputs, toxic)
    return model


def sample(
    docs: DataFrame,
    labels: DataFrame,
    parts: int = HELD_OUT_PARTS,
    toxic: int = SAMPLE_TOXIC,
    clean: int = SAMPLE_CLEAN,
    chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """At most toxic + clean labelled documents for learning: text and toxic."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~tables.held_out("doc_id", parts))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
        .filter(F.col("toxic") == F.col("_most"))
        .drop("_most")
    )
    order = F.xxhash64("doc_id")
    # Places go to documents that may be learned from, and to one text of an id that several have.
    texts = docs.select("doc_id", F.xxhash64("text").alias("key")).filter(F.length("text") <= chars)
    known = texts.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("key").alias("key"))
    picked = (
        known.filter("toxic = 1").orderBy(order, "doc_id").limit(toxic)
        .unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(clean))
    )
    # The broadcast side has toxic + clean rows of three numbers at most.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.join(F.broadcast(picked), ["doc_id", "key"]).select("text", "toxic").distinct()


def tag(docs: DataFrame, model: Chain | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted, expected number of toxic tokens and spans (start, end, probability)."""
    span = StructType(
        [
            StructField("start", LongType()),
            StructField("end", LongType()),
            StructField("probability", DoubleType()),
        ]
    )
    added = [
        StructField("score", DoubleType()),
        StructField("predicted", IntegerType()),
        StructField("toxic_tokens", DoubleType()),
        StructField("spans", ArrayType(span)),
    ]
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    # The text is read, not sent back: what is kept of it is up to the caller.
    schema = StructType([docs.schema[c] for c in kept] + added)
    place = kept.index("text")
    cells = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def of_batches(batches):
        for batch in batches:
            scores, totals, spans = [], [], []
            for _, words in slices(batch.column(place)):
                count = len(words.bound) - 1
                spans_here = [[] for _ in range(count)]
                if model is None:
                    scores.append(np.zeros(count))
                    totals.append(np.zeros(count))
                    spans += spans_here
                    continue
                p = model.marginals(model.odds(_features(words)), *_bounds(words))
                inputs = _summary(words, p)
                scores.append(1 / (1 + np.exp(-np.clip(inputs @ model.curve, -30, 30))))
                totals.append(np.expm1(inputs[:, 2]))
                letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                edge = words.edges
                for i in np.flatnonzero(p >= 0.5):
                    row = words.row[i]
                    base = letters[edge[row]]
                    spans_here[row].append(
                        {
                            "start": int(letters[words.start[i]] - base),
                            "end": int(letters[words.end[i]] - base),
                            "probability": float(p[i]),
                        }
                    )
                spans += spans_here
            score = np.concatenate(scores) if scores else np.zeros(0)
            total = np.concatenate(totals) if totals else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(kept))],
                    pa.array(score),
                    pa.array((score >= threshold).astype(np.int32)),
                    pa.array(total),
                    pa.array(spans, pa.list_(cells)),
                ],
                names=[f.name for f in schema.fields],
            )

    return docs.select(*kept).mapInArrow(of_batches, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with their columns unchanged."""
    model = learn_from(docs, labels)
    # The added columns must not replace any that are there.
    aside = {c: f"__llm_{c}" for c in docs.columns if c.lower() in ADDED}
    rated = tag(docs.withColumnsRenamed(aside), model).filter("predicted = 0")
    return rated.drop(*ADDED).withColumnsRenamed({new: old for old, new in aside.items()})


def learn_from(docs: DataFrame, labels: DataFrame, **bounds) -> Chain | None:
    """The chain of a bounded sample, fitted in one task; only the model comes to the driver."""

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("text", "ascending"), ("toxic", "ascending")])
        model = learn(table["text"].to_pylist(), table["toxic"].to_pylist())
        return pa.table({"model": [pickle.dumps(model)]})

    one = sample(docs, labels, **bounds).groupBy(F.lit(1).alias("one"))
    found = one.applyInArrow(fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def op5_toxicity_crf(spark, folder):
    docs = tables.read(spark, folder, "documents").select("doc_id", "text")
    model = learn_from(docs, tables.read(spark, folder, "labels"))
    return tag(docs, model).select(
        "doc_id",
        tables.held_out("doc_id", HELD_OUT_PARTS).alias("held_out"),
        "score",
        "predicted",
        "toxic_tokens",
        "spans",
    )


QUERIES = {"op5_toxicity_crf": op5_toxicity_crf}

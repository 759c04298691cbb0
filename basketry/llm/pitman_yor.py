"""Language-model scores by a hierarchical Pitman-Yor model.

A text is its words (white space apart, A-Z lower-cased), a blank after each but the last, and an end sign; the
model predicts this row of bytes one by one, so it has no unknown words and its chances add up to one over
all texts. Every training byte is a customer in the restaurant of the ``DEPTH`` bytes before it; the tables there send
one customer each to the restaurant of the context without its first byte, and that of no context falls back on 256
equal chances. Every context of the corpus has a restaurant. Those that ``SHARE`` of the training bytes or more
follow, at most 1 / SHARE of each depth, are the core, which is seated in one task and known to all tasks; the rest
hang below them as trees, each of fewer customers than that, and are seated in as many tasks as there are shards.

1. Counts of byte runs and of words are taken over all training documents where they are read, and summed by
   key in Spark.
2. The seating is sampled by Gibbs sweeps, from the deepest restaurants to the root: the customers of one
   dish get up together and are seated anew, one after the other, given all other tables and the chances of the
   parent. (Where many sit already, an eighth as many are seated in one draw.) Discounts are estimated
   per depth, and in each shard, from how often dishes were served once and twice. The core is seated first as if
   there were no others, then the trees given the core, then the core with the customers that the trees send, and
   at last, when texts are scored, the trees given that.
3. The chance of a dish is averaged over the sweeps after the first ones. What is left to the dishes that a
   restaurant has not served is given out as the parent gives it out, so that the averages add up to one.
4. Texts are scored whole, in blocks of bounded size. The word counts, and the chances outside the core, that a
   block needs come to it from the shards, so neither the vocabulary nor the trees are in one place.

Edge cases: null counts as empty; an empty text is the end sign alone; without training documents all
bytes are equally likely; repeated rows count and are scored each; other columns are not looked at.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tables
from basketry.llm.words import NO_BLANKS, slices
from basketry.storage import save

DEPTH, SHARE, STRENGTH = 5, 4e-6, 1.0
SWEEPS, FIRST_SWEEPS = 12, 4
HELD_OUT_PARTS = 5
BLOCK_BYTES = 8 << 20
#: Words and runs of a shard, on average.
SHARD_KEYS = 400_000
_HELD_RUNS = 1 << 19
_END = np.uint64(1)  # stands for the end among the words' codes
_GRAMS, _WORDS = 0, 1
_KINDS = ("runs", _GRAMS), ("words", _WORDS)


def byte_rows(words):
    """The bytes that the model predicts, and where each text begins in them (and the end)."""
    size = words.end - words.start
    count = np.diff(words.bound)
    rows = len(count)
    # Every word takes its bytes and one more; a text without words takes one.
    per_word = size + 1
    taken = np.concatenate([[0], np.cumsum(per_word)])
    bare = np.concatenate([[0], np.cumsum(count == 0)])
    begin = taken[words.bound] + bare
    out = np.full(int(taken[-1] + bare[-1]), 10, dtype=np.uint8)
    if len(size):
        to = taken[:-1] + bare[words.row]
        source = np.repeat(words.start - np.cumsum(size) + size, size) + np.arange(size.sum())
        target = np.repeat(to - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[target] = words.data[source]
        last = np.zeros(len(size), dtype=bool)
        last[words.bound[1:][count > 0] - 1] = True
        out[(to + size)[~last]] = 32
    return out, begin, rows


def runs(words, depth: int = DEPTH):
    """Per predicted byte the number made of the ``depth`` bytes before it and itself; the texts' begins."""
    out, begin, rows = byte_rows(words)
    place = np.arange(len(out)) - np.repeat(begin[:-1], np.diff(begin))
    value = np.zeros(len(out), dtype=np.uint64)
    for back in range(depth, -1, -1):
        byte = np.full(len(out), 10, dtype=np.uint64)
        byte[back:] = out[: max(len(out) - back, 0)]
        byte[place < back] = 10
        value = (value << np.uint64(8)) | byte
    return value, begin


def _merged(keys, counts):
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): how often each byte run and each word (the end too) stands in the texts."""

    def of_batches(batches):
        held = {_GRAMS: ([], []), _WORDS: ([], [])}

        def out(kind):
            keys, counts = _merged(*held[kind])
            held[kind] = ([keys], [counts])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), kind, dtype=np.int32)),
                    pa.array(keys.view(np.int64)),
                    pa.array(counts),
                ],
                names=["kind", "key", "n"],
            )

        for batch in batches:
            for _, words in slices(batch.column(0), NO_BLANKS):
                ends = np.array([len(words.bound) - 1])
                codes, counts = np.unique(words.code, return_counts=True)
                values, times = np.unique(runs(words, depth)[0], return_counts=True)
                for kind, k, n in (
                    (_WORDS, codes, counts),
                    (_WORDS, np.array([_END]), ends),
                    (_GRAMS, values, times),
                ):
                    held[kind][0].append(k)
                    held[kind][1].append(n)
                    if sum(map(len, held[kind][0])) > 2 * _HELD_RUNS:
                        rows = out(kind)
                        if rows.num_rows > _HELD_RUNS:
                            held[kind] = ([], [])
                            yield rows
        for kind in held:
            if held[kind][0]:
                yield out(kind)

    counted = docs.select("text").mapInArrow(of_batches, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def customers(grams: DataFrame, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """(depth, dish, n): the byte runs as customers of the longest context that is in the core.

    A dish is the context's bytes and the byte that follows. There are those of at most 1 / share contexts of
    each depth. Runs that are not of the greatest depth have restaurants below these: see ``trees``.
    """
    total = grams.agg(F.sum("n")).first()[0] or 0
    rest, found = grams, []
    for k in range(depth, 0, -1):
        context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * k)) - 1))
        frequent = (
            grams.groupBy(context.alias("context"))
            .agg(F.sum("n").alias("times"))
            .filter(F.col("times") >= share * total)
            .select("context")
        )
        # At most 1 / share rows: the bound of what is broadcast.
        kept = F.broadcast(frequent)
        rest = rest.withColumn("context", context)
        here = rest.join(kept, "context", "left_semi")
        rest = rest.join(kept, "context", "left_anti").drop("context")
        dish = F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        found.append(here.select(F.lit(k).alias("depth"), dish.alias("dish"), "n"))
    found.append(
        rest.select(F.lit(0).alias("depth"), F.col("key").bitwiseAND(F.lit(255)).alias("dish"), "n")
    )
    all_ = found[0]
    for part in found[1:]:
        all_ = all_.unionByName(part)
    return all_.groupBy("depth", "dish").agg(F.sum("n").alias("n"))


def by_depth(depth, dish, n, deepest: int = DEPTH) -> list:
    """For each depth from 0 on, sorted dishes and their customers."""
    out = []
    for k in range(deepest + 1):
        here = depth == k
        order = np.argsort(dish[here])
        out.append((dish[here][order].astype(np.uint64), n[here][order]))
    return out


class _Level:
    """The restaurants of one depth: dishes sorted by context and byte."""

    def __init__(self, keys, direct):
        self.keys, self.direct = keys, direct
        self.contexts, self.restaurant = np.unique(keys >> np.uint64(8), return_inverse=True)
        self.tables = np.minimum(direct, 1)
        # Index of each dish among those of the depth above, and the chances there of those that have none (-1).
        self.up = np.full(len(keys), -1)
        self.outer = np.full(len(keys), 1 / 256)

    def total(self, values):
        return np.bincount(self.restaurant, values, minlength=len(self.contexts))

    def above(self, chances):
        out = self.outer.copy()
        inner = self.up >= 0
        if inner.any():
            out[inner] = chances[self.up[inner]]
        return out


def _seat(rng, guests, mass, discount):
    """Tables of dishes whose ``guests`` sit down one after the other.

    ``mass(at, tables)`` is the weight of a new table for the dishes at these places. A guest joins an old
    table with weight (seated - discount x tables). Once 16 are seated, an eighth as many as are seated is dealt
    with in one draw, at the weights half-way.
    """
    tables = np.minimum(guests, 1)
    seated = tables.copy()
    active = np.flatnonzero(guests > 1)
    while len(active):
        t, n = tables[active], seated[active]
        step = np.where(n < 16, 1, np.minimum(-(-n // 8), guests[active] - n))
        new = mass(active, t)
        half = (step - 1) / 2
        t = t + half * new / (new + n - discount * t)
        new, old = mass(active, t), n + half - discount * t
        tables[active] += rng.binomial(step, new / (new + old))
        seated[active] = n + step
        active = active[seated[active] < guests[active]]
    return tables


class Model:
    """Averaged chances: per depth sorted dish keys with log10 chances, contexts with log10 backoff.

    What the model does not know is left to ``core``, where there is one, else to 256 equal chances.
    """

    def __init__(self, dishes, contexts, core=None):
        self.dishes, self.contexts, self.core = dishes, contexts, core

    def depth(self, values):
        """The length of the longest context of each run that the model knows."""
        out, left = np.zeros(len(values), dtype=np.int64), np.arange(len(values))
        for k in range(len(self.contexts) - 1, 0, -1):
            context = (values[left] >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
            known = _find(self.contexts[k][0], context)[0]
            out[left[known]] = k
            left = left[~known]
        return out

    def log_chance(self, values):
        """log10 chance of the last byte of each run."""
        out = np.zeros(len(values))
        left = np.arange(len(values))
        for k in range(len(self.dishes) - 1, -1, -1):
            if not len(left):
                break
            dish = values[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            keys, chances = self.dishes[k]
            hit, at = _find(keys, dish)
            out[left[hit]] += chances[at[hit]]
            left, dish = left[~hit], dish[~hit]
            keys, weights = self.contexts[k]
            known, at = _find(keys, dish >> np.uint64(8))
            out[left[known]] += weights[at[known]]
        out[left] += self.core.log_chance(values[left]) if self.core else -np.log10(256)
        return out


def _find(keys, wanted):
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted, at


def sample_model(
    counts: list,
    sweeps: int = SWEEPS,
    first_sweeps: int = FIRST_SWEEPS,
    strength: float = STRENGTH,
    seed: int = 3,
) -> Model:
    """Gibbs sweeps over the seating of ``customers``' counts, and the averages of the later ones."""
    levels, below = [None] * len(counts), np.zeros(0, dtype=np.uint64)
    for k in range(len(counts) - 1, -1, -1):
        keys, n = counts[k]
        both = np.union1d(keys, below & np.uint64((1 << (8 * (k + 1))) - 1))
        direct = np.zeros(len(both), dtype=np.int64)
        direct[np.searchsorted(both, keys)] = n
        levels[k] = _Level(both, direct)
        below = both
    for k in range(1, len(levels)):
        mask = np.uint64((1 << (8 * k)) - 1)
        levels[k].up = np.searchsorted(levels[k - 1].keys, levels[k].keys & mask)
    return _sampled(levels, sweeps, first_sweeps, strength, seed)


def trees(values, n, core: Model, deepest: int = DEPTH) -> list:
    """The restaurants below the core, of runs and their counts whose whole contexts are not in it.

    A level for each depth; the dishes of a tree's first restaurant take their outer chances from the core.
    """
    levels, keys, direct, known = [None] * (deepest + 1), values, n, core.depth(values)
    for k in range(deepest, -1, -1):
        keys, at = np.unique(keys, return_index=True)
        levels[k] = _Level(keys, direct[at] if k == deepest else np.zeros(len(keys), dtype=np.int64))
        levels[k].outer = 10 ** core.log_chance(keys)
        known = known[at]
        # The restaurant above is in the tree unless the core knows its context.
        if k < deepest:
            levels[k + 1].up[inner] = np.searchsorted(keys, passed)
        inner = known < k - 1
        passed = keys[inner] & np.uint64((1 << (8 * k)) - 1)
        keys, known = passed, known[inner]
    return levels


def _sampled(levels, sweeps, first_sweeps, strength, seed, core=None) -> Model:
    """Seats the levels, which keep the tables of the last sweep, and averages the later sweeps."""
    rng = np.random.default_rng(seed)

    def guests(k):
        own = levels[k].direct
        if k + 1 < len(levels):
            up, sent = levels[k + 1].up, levels[k + 1].tables
            own = own + np.bincount(up[up >= 0], sent[up >= 0], minlength=len(own)).astype(np.int64)
        return own

    discounts = []
    for k in range(len(levels) - 1, -1, -1):
        n = guests(k)
        levels[k].tables = np.minimum(n, 1)
        once, twice = (n == 1).sum(), (n == 2).sum()
        discounts.insert(0, float(np.clip((once + 1) / (once + 2 * twice + 2), 0.05, 0.9)))

    def predict():
        """Per depth the chances of its dishes, from the root down."""
        out, parent = [], None
        for k, level in enumerate(levels):
            above = level.above(parent)
            n, t = guests(k), level.tables
            weight = strength + level.total(n)
            fresh = (strength + discounts[k] * level.total(t))[level.restaurant]
            parent = (n - discounts[k] * t + fresh * above) / weight[level.restaurant]
            out.append((parent, above))
        return out

    sums = [np.zeros(len(level.keys)) for level in levels]
    for sweep in range(sweeps):
        chances = predict()
        for k in range(len(levels) - 1, -1, -1):
            level, above = levels[k], chances[k][1]
            # The other dishes' tables, as they stood before this depth was seated anew.
            others = level.total(level.tables)[level.restaurant] - level.tables
            d = discounts[k]

            def mass(at, t, above=above, others=others, d=d):
                return (strength + d * (others[at] + t)) * above[at]

            level.tables = _seat(rng, guests(k), mass, d)
        if sweep >= first_sweeps:
            for k, (chance, _) in enumerate(predict()):
                sums[k] += chance
    dishes, contexts, means = [], [], []
    for k, level in enumerate(levels):
        mean = sums[k] / max(sweeps - first_sweeps, 1)
        above = level.above(means[k - 1] if k else None)
        left = np.maximum(1 - level.total(mean), 1e-12)
        left_above = np.maximum(1 - level.total(above), 1e-12)
        means.append(mean)
        dishes.append((level.keys, np.log10(np.maximum(mean, 1e-300))))
        contexts.append((level.contexts, np.log10(left / left_above)))
    return Model(dishes, contexts, core)


def sample_trees(levels: list, core: Model, seed: int, sweeps: int = SWEEPS, first_sweeps: int = FIRST_SWEEPS) -> Model:
    """``sample_model`` for ``trees``: chances of the runs below the core; all others are those of the core."""
    return _sampled(levels, sweeps, first_sweeps, STRENGTH, seed, core)


def sent_to_core(levels: list):
    """(depth, dish, n): the customers that the tables of the trees' first restaurants are in the core."""
    depth, dish, n = [], [], []
    for k in range(1, len(levels)):
        first = levels[k].up < 0
        dish.append(levels[k].keys[first] & np.uint64((1 << (8 * k)) - 1))
        n.append(levels[k].tables[first])
        depth.append(np.full(first.sum(), k - 1, dtype=np.int32))
    return np.concatenate(depth), np.concatenate(dish), np.concatenate(n)


def _shard(kind, keys, core: Model, shards: int):
    """The shard of each word, and of each run that of its tree; -1 where the core knows a run's whole context."""
    root = keys.copy()
    grams = np.flatnonzero(kind == _GRAMS)
    known = core.depth(keys[grams])
    inside = known == len(core.contexts) - 1
    mask = (np.uint64(1) << (8 * (known + 1) % 64).astype(np.uint64)) - np.uint64(1)
    # The context one byte longer than the core knows, and its length, name the tree.
    named = ((keys[grams] >> np.uint64(8)) & mask) | ((known + 1).astype(np.uint64) << np.uint64(56))
    root[grams] = named
    mixed = (root ^ (root >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    out = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    out[grams[inside]] = -1
    return out.astype(np.int32)


def dealt(counts: DataFrame, core, shards: int) -> DataFrame:
    """(shard, kind, key, n): ``corpus_counts`` but for the runs whose whole context is in the core (a broadcast)."""

    def place(batches):
        for batch in batches:
            kind, keys = batch.column("kind").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            shard = _shard(kind, keys, _cached(core).model, shards)
            placed = pa.RecordBatch.from_arrays(
                [pa.array(shard), *batch.columns], names=["shard", "kind", "key", "n"]
            )
            yield placed.filter(pa.array(shard >= 0))

    return counts.select("kind", "key", "n").mapInArrow(place, "shard int, kind int, key long, n long")


class _Cached:
    """A model with the chances of recent runs, each at the place that its bits give."""

    def __init__(self, model, places: int = 1 << 20):
        self.model, self.mask = model, np.uint64(places - 1)
        self.keys = np.full(places, np.uint64((1 << 64) - 1))
        self.chances = np.zeros(places)

    def log_chance(self, values, answered, chances):
        """log10 chances: of runs among ``answered``, which is sorted, those beside them, else the model's."""
        mixed = values * np.uint64(0x9E3779B97F4A7C15)
        place = ((mixed >> np.uint64(40)) & self.mask).astype(np.int64)
        out = self.chances[place]
        miss = np.flatnonzero(self.keys[place] != values)
        if len(miss):
            new, at = np.unique(values[miss], return_inverse=True)
            told, place_of = _find(answered, new)
            found = np.empty(len(new))
            found[told] = chances[place_of[told]]
            found[~told] = self.model.log_chance(new[~told])
            out[miss] = found[at]
            self.keys[place[miss]] = values[miss]
            self.chances[place[miss]] = out[miss]
        return out


def log_scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores of every text under the model and under the words' own frequencies.

    ``model`` is the core, ``counts`` are ``corpus_counts`` of the training documents. Columns: doc_id, n_tokens, n_known, train_tokens,
    base_score, score.
    """
    words = counts.filter(F.col("kind") == _WORDS).select(F.col("key").alias("word"), "n")
    facts = words.agg(F.sum("n"), F.count("*")).first()
    tokens, vocabulary = int(facts[0] or 0), int(facts[1])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    placed = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
        "doc_id",
        "text",
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shards = max(blocks, _shards_of(counts))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def needed(table: pa.Table) -> pa.Table:
        keys = {_GRAMS: [np.zeros(0, dtype=np.uint64)], _WORDS: [np.array([_END])]}
        for chunk in table["text"].chunks:
            for _, part in slices(chunk, NO_BLANKS):
                keys[_WORDS].append(_distinct(part.code))
                keys[_GRAMS].append(_distinct(runs(part)[0]))
        out = {"block": np.full(shards, table["block"][0].as_py(), dtype=np.int32)}
        for name, kind in _KINDS:
            own = _distinct(np.concatenate(keys[kind]))
            shard = _shard(np.full(len(own), kind), own, _cached(shared).model, shards)
            out[name] = _listed(shard, shards, own.view(np.int64))
        asked = pa.table({"shard": np.arange(shards, dtype=np.int32), **out})
        return asked.filter(pa.array(np.add(*(_lengths(asked, name) for name, _ in _KINDS)) > 0))

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        kind, keys, n = _numbers(held, "kind"), _numbers(held, "key").view(np.uint64), _numbers(held, "n")
        order = np.lexsort((keys, kind))
        split = np.count_nonzero(kind == _GRAMS)
        keys, n = keys[order], n[order]
        out = {"block": asked["block"]}
        # Words that nobody knows get no answer.
        row, words = _unlisted(asked, "words")
        hit, at = _find(keys[split:], words)
        out["words"] = _listed(row[hit], asked.num_rows, words[hit].view(np.int64))
        out["n"] = _listed(row[hit], asked.num_rows, n[split:][at[hit]])
        row, grams = _unlisted(asked, "runs")
        chances = np.zeros(0)
        if len(grams):
            core = _cached(shared).model
            tree = sample_trees(trees(keys[:split], n[:split], core), core, _seed(keys[:split]))
            new, at = np.unique(grams, return_inverse=True)
            chances = tree.log_chance(new)[at]
        out["runs"] = _listed(row, asked.num_rows, grams.view(np.int64))
        out["chances"] = _listed(row, asked.num_rows, chances)
        return pa.table(out)

    # Lists, a row for each block and shard: a key is a number in an array and not a row.
    asked = placed.groupBy("block").applyInArrow(needed, "shard int, block int, runs array<long>, words array<long>")
    replies = (
        asked.groupBy("shard")
        .cogroup(dealt(counts, shared, shards).groupBy("shard"))
        .applyInArrow(
            answer, "block int, words array<long>, n array<long>, runs array<long>, chances array<double>"
        )
    )
    below = tokens + 0.5 * (vocabulary + 1)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        known, times = (_unlisted(right, name)[1] for name in ("words", "n"))
        answered, chances = (_unlisted(right, name)[1] for name in ("runs", "chances"))
        order, by_run = np.argsort(known), np.argsort(answered)
        known, times = known[order], times[order].view(np.int64)
        answered, chances = answered[by_run], chances[by_run].view(np.float64)
        cached = _cached(shared)
        columns = [[] for _ in range(4)]
        for chunk in left["text"].chunks:
            for _, part in slices(chunk, NO_BLANKS):
                hit, at = _find(known, part.code)
                count = np.zeros(len(part.code), dtype=np.int64)
                count[hit] = times[at[hit]]
                has_end, at = _find(known, np.array([_END]))
                ends = int(times[at[0]]) if has_end[0] else 0
                base = np.log10((np.concatenate([count, [ends]]) + 0.5) / below)
                sums = np.concatenate([[0.0], np.cumsum(base[:-1])])[part.bound]
                seen = np.concatenate([[0], np.cumsum(count > 0)])[part.bound]
                values, begin = runs(part)
                chance = cached.log_chance(values, answered, chances)
                columns[0].append(np.diff(part.bound) + 1)
                columns[1].append(np.diff(seen) + (ends > 0))
                columns[2].append(np.diff(sums) + base[-1])
                columns[3].append(np.add.reduceat(chance, begin[:-1]))
        joined = [np.concatenate(c) if c else np.zeros(0) for c in columns]
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "n_tokens": pa.array(joined[0].astype(np.int64)),
                "n_known": pa.array(joined[1].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(joined[0]), tokens, dtype=np.int64)),
                "base_score": pa.array(joined[2].astype(float)),
                "score": pa.array(joined[3].astype(float)),
            }
        )

    return (
        placed.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(
            scored,
            f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def _numbers(table: pa.Table, name: str):
    return table[name].combine_chunks().to_numpy()


def _distinct(values):
    return pa.array(values).unique().to_numpy()


def _listed(row, rows: int, values) -> pa.Array:
    """A list of values for each row; those with a negative row are left out."""
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order]))


def _unlisted(table: pa.Table, name: str):
    """The row of each value of a column of lists, and the values' bits."""
    lists = table[name].combine_chunks()
    values = lists.flatten().to_numpy().view(np.uint64)
    return np.repeat(np.arange(len(lists)), _lengths(table, name)), values


def _lengths(table: pa.Table, name: str):
    return table[name].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _seed(keys) -> int:
    """Of the runs in a shard, whatever their order."""
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(len(keys))))


def _shards_of(counts: DataFrame) -> int:
    return 1 + counts.count() // SHARD_KEYS


_models = {}


def _cached(shared) -> _Cached:
    """The cache of this Python worker for a broadcast model."""
    key = shared._path if hasattr(shared, "_path") else id(shared)
    if key not in _models:
        _models.clear()
        _models[key] = _Cached(shared.value)
    return _models[key]


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The core of a model of these documents, and their counts (a written table).

    The core is sampled in one task, on the dishes of its bounded number of restaurants; only it comes to the
    driver. It is sampled twice: with the runs below it as its own customers, and with those that their trees
    send it.
    """
    counts = save(corpus_counts(docs), "counts")
    grams = counts.filter(F.col("kind") == _GRAMS)
    direct = save(customers(grams.select("key", "n")), "customers")
    first = docs.sparkSession.sparkContext.broadcast(_core(direct))

    def sent(table: pa.Table) -> pa.Table:
        keys, core = _numbers(table, "key").view(np.uint64), _cached(first).model
        levels = trees(keys, _numbers(table, "n"), core)
        sample_trees(levels, core, _seed(keys), FIRST_SWEEPS)
        depth, dish, n = sent_to_core(levels)
        return pa.table({"depth": depth, "dish": dish.view(np.int64), "n": n})

    trees_ = dealt(grams, first, _shards_of(grams)).groupBy("shard").applyInArrow(sent, "depth int, dish long, n long")
    seated = direct.filter(F.col("depth") == DEPTH).unionByName(trees_.groupBy("depth", "dish").agg(F.sum("n").alias("n")))
    return _core(seated), counts


def _core(seated: DataFrame) -> Model:
    def sampled(table: pa.Table) -> pa.Table:
        depth, dish, n = (_numbers(table, c) for c in ("depth", "dish", "n"))
        return pa.table({"model": [pickle.dumps(sample_model(by_depth(depth, dish, n)))]})

    found = seated.groupBy(F.lit(1).alias("one")).applyInArrow(sampled, "model binary").collect()
    if found:
        return pickle.loads(found[0]["model"])
    nothing = np.zeros(0, dtype=np.int64)
    return sample_model(by_depth(nothing, nothing, nothing))


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: perplexity per token of the model and of the word frequencies."""
    tokens = F.sum("n_tokens")
    return scores.agg(
        tokens.alias("n_tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"),
    )


def op3_pitman_yor(spark, folder):
    docs = tables.read(spark, folder, "documents").select("doc_id", "text")
    out = tables.held_out("doc_id", HELD_OUT_PARTS)
    model, counts = learn(docs.filter(~out))
    return log_scores(docs, model, counts).select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


QUERIES = {"op3_pitman_yor": op3_pitman_yor}

"""Periodic runs of words: stretches that repeat a pattern at least three times.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), of at least
``max(LEAST_WORDS, LEAST_TURNS * q)`` words, that no neighbouring word extends.

1. Distances are taken scale by scale: 1 to 15, then 16 to 31, 32 to 63 and so on. A run whose period lies in the
   scale that starts at B holds a whole aligned block of B words (8 at the first scale) which occurs again one
   period later: its first L - q words are at least 2 * B - 1.
2. Block convolution: the sum of squared differences between a block and every place of the window behind it
   is the block's squares, plus the window's, less twice their correlation. All three are exact integers modulo a
   prime; the correlation is a number-theoretic transform. Zero means that the block occurs at that distance.
   A block with a word that does not come again within reach cannot occur there and is left out.
3. Blocks in a row at one distance are one seed. A seed is extended to both sides word by word, which also
   confirms it: a sum of squares that is a multiple of the prime, but not zero, is told apart here.
4. What is long enough stays; of the distances that give the same stretch the smallest is its period.

Words are compared as bytes, by number within a slice. The work is O(n log n) a scale; memory is bounded by the
slice of texts, or by one text where that is longer.

Edge cases: a null text is empty; it has no words and no runs. Texts are whole at any length. A repeated row is
a row of its own. An empty table gives an empty table. Columns of the input other than the text pass through
unchanged; one called ``runs`` or ``collapsed`` in any case gives way to the operator's own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm import tables
from basketry.llm.words import SLICE_BYTES

LEAST_WORDS, LEAST_TURNS = 24, 3
#: 3 * 2^30 + 1 is prime, and 5 generates its units. Products of two residues fit 64 bits.
PRIME, GENERATOR = 3 * 2**30 + 1, 5
#: Numbers in one batch of transforms.
_BATCH = 1 << 20
#: The first scale: blocks of 8 words, distances from 1 to 15.
_FIRST = 8

_P = np.uint64(PRIME)
_roots: dict[tuple[int, bool], np.ndarray] = {}
_RUNS = T.ArrayType(
    T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
)


def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``."""
    key = (size, inverse)
    if key not in _roots:
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        if inverse:
            root = pow(root, -1, PRIME)
        out = np.ones(1, dtype=np.uint64)
        while len(out) < size // 2:
            step = np.uint64(pow(root, len(out), PRIME))
            out = np.concatenate([out, out * step % _P])
        _roots[key] = out
    return _roots[key]


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row; the length is a power of two. The inverse is not scaled."""
    rows, size = x.shape
    root = _powers(size, inverse)
    # Decimation in frequency with reordering: after each step the parts are one level further sorted.
    x = x.reshape(rows, size, 1)
    while x.shape[1] > 1:
        half, done = x.shape[1] // 2, x.shape[2]
        low, high = x[:, :half], x[:, half:]
        factor = root[::done][:half].reshape(1, half, 1)
        out = np.empty((rows, half, 2, done), dtype=np.uint64)
        total = low + high
        out[:, :, 0] = np.where(total >= _P, total - _P, total)
        out[:, :, 1] = (low + (_P - high)) % _P * factor % _P
        x = out.reshape(rows, half, 2 * done)
    return x.reshape(rows, size)


def _correlation(block: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
    """sum_i block[i] * window[k + i] modulo the prime, row by row, for all k without wrap-around."""
    wide = np.zeros((2, len(block), size), dtype=np.uint64)
    wide[0, :, : block.shape[1]] = block
    wide[1, :, : window.shape[1]] = window
    # Turned round, a convolution is a correlation: index -i modulo size.
    wide[0, :, 1:] = wide[0, :, :0:-1].copy()
    product = transform(wide[0]) * transform(wide[1]) % _P
    scale = np.uint64(pow(size, -1, PRIME))
    return transform(product, inverse=True) * scale % _P


def _occurrences(ids: np.ndarray, start: np.ndarray, block: int, low: int, high: int):
    """(place, distance) where the block at a place occurs again, for distances from low to high."""
    width = block + high - low
    size = 1 << (width - 1).bit_length()
    places, distances = [], []
    for first in range(0, len(start), max(1, _BATCH // size)):
        at = start[first : first + max(1, _BATCH // size)]
        here = ids[at[:, None] + np.arange(block)]
        behind = np.minimum(at[:, None] + low + np.arange(width), len(ids) - 1)
        behind = ids[behind]
        cross = _correlation(here, behind, size)[:, : high - low + 1]
        squares = np.cumsum(behind * behind % _P, axis=1, dtype=np.uint64)
        squares = np.concatenate([np.zeros((len(at), 1), np.uint64), squares], axis=1)
        windows = (squares[:, block:] - squares[:, : width - block + 1]) % _P
        own = (here * here % _P).sum(axis=1, dtype=np.uint64) % _P
        total = (own[:, None] + windows + (_P - cross) + (_P - cross)) % _P
        row, lag = np.nonzero(total == 0)
        places.append(at[row])
        distances.append(low + lag)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(distances)


def _equal_ahead(ids, first: int, second: int, limit: int, step: int) -> int:
    """How many words from ``first`` and ``second`` on are the same, going by ``step``; ``limit`` at most."""
    done, chunk = 0, 16
    while done < limit:
        n = min(chunk, limit - done)
        if step > 0:
            a, b = ids[first + done : first + done + n], ids[second + done : second + done + n]
        else:
            a = ids[first - done - n + 1 : first - done + 1][::-1]
            b = ids[second - done - n + 1 : second - done + 1][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done, chunk = done + n, min(chunk * 2, 1 << 16)
    return done


def find_runs(ids: np.ndarray, bound: np.ndarray, least: int = LEAST_WORDS, turns: int = LEAST_TURNS):
    """Runs of texts given as word numbers; text i has those from ``bound[i]`` to ``bound[i + 1]``.

    Four arrays: text, start (in the text), length, period; sorted by text, start and period. The scales
    find what has three turns and 24 words at least.
    """
    if least < LEAST_WORDS or turns < LEAST_TURNS:
        raise ValueError(f"runs need {LEAST_WORDS} words and {LEAST_TURNS} turns at least")
    count = len(ids)
    sizes = np.diff(bound)
    ids = ids.astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # Distance from a word to the next one that is the same, in the same text.
    order = np.lexsort((np.arange(count), ids, text))
    reach = np.full(count, count + 1, dtype=np.int64)
    if count > 1:
        same = (ids[order[1:]] == ids[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        reach[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found = {}
    block, low, high = _FIRST, 1, 2 * _FIRST - 1
    furthest = reach
    span = 1
    while len(sizes) and max(least, low * turns) <= int(sizes.max()):
        while span < block:
            # Greatest distance within the block that starts at each word.
            after = furthest.copy()
            after[: count - span] = np.maximum(furthest[: count - span], furthest[span:])
            furthest, span = after, span * 2
        many = np.where(sizes >= max(least, low * turns), sizes // block, 0)
        owner = np.repeat(np.arange(len(sizes)), many)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = bound[:-1][owner] + number * block
        end = bound[1:][owner]
        keep = (start + low + block <= end) & (furthest[np.minimum(start, count - 1)] <= high)
        at, distance = _occurrences(ids, start[keep], block, low, high)
        inside = at + distance + block <= bound[1:][text[at]] if len(at) else np.zeros(0, bool)
        at, distance = at[inside], distance[inside]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (
            (distance[1:] != distance[:-1])
            | (at[1:] != at[:-1] + block)
            | (text[at[1:]] != text[at[:-1]])
        )
        heads = np.flatnonzero(fresh)
        tails = np.r_[heads[1:], len(at)] - 1
        done_distance, done_end = -1, -1
        for head, tail in zip(heads, tails):
            d, s = int(distance[head]), int(at[head])
            if d == done_distance and s < done_end:
                continue
            left, right = int(bound[text[s]]), int(bound[text[s] + 1])
            # A false zero shows here: the words of the block itself are compared too.
            ahead = _equal_ahead(ids, s, s + d, right - s - d, 1)
            if ahead < block:
                continue
            back = _equal_ahead(ids, s - 1, s + d - 1, s - left, -1)
            done_distance, done_end = d, s + ahead
            first, length = s - back, back + ahead + d
            if length >= max(least, turns * d):
                key = (int(text[s]), first - left, length)
                found[key] = min(d, found.get(key, d))
        block, low = (block, 2 * _FIRST) if low == 1 else (2 * block, 2 * low)
        block, high = max(block, low), 2 * low - 1
    rows = sorted((t, s, q, n) for (t, s, n), q in found.items())
    out = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 3], out[:, 2]


def collapse(words: list, runs) -> list:
    """The words without those that a run contains after its first period; runs: (start, length, period)."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def _of_texts(texts: list[bytes], least: int, turns: int):
    """Per text its runs and the collapsed text, for texts of one slice."""
    number: dict[bytes, int] = {}
    # bytes.split() cuts at exactly 0x20 and 0x09 to 0x0D.
    split = [t.split() for t in texts]
    bound = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in split], out=bound[1:])
    ids = np.fromiter(
        (number.setdefault(w, len(number)) for words in split for w in words), np.int64, int(bound[-1])
    )
    text, start, length, period = find_runs(ids, bound, least, turns)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    for i, words in enumerate(split):
        here = slice(cut[i], cut[i + 1])
        runs = list(zip(start[here].tolist(), length[here].tolist(), period[here].tolist()))
        yield runs, b" ".join(collapse(words, runs) if runs else words)


def find(
    docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, turns: int = LEAST_TURNS
) -> DataFrame:
    """The table with ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` joins by one blank the words that no run contains after its first period.
    """
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    place = kept.index(text)
    given = docs.select(*[docs[f"`{c}`"] for c in kept])
    cell = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def of_batches(batches):
        for batch in batches:
            column = batch.column(place).cast(pa.large_binary())
            first = 0
            while first < len(column):
                texts, total = [], 0
                while first + len(texts) < len(column) and total < SLICE_BYTES:
                    texts.append(column[first + len(texts)].as_py() or b"")
                    total += len(texts[-1])
                runs, collapsed = zip(*_of_texts(texts, least, turns))
                flat = [x for row in runs for x in row]
                offsets = np.zeros(len(runs) + 1, dtype=np.int32)
                np.cumsum([len(r) for r in runs], out=offsets[1:])
                values = np.array(flat, dtype=np.int64).reshape(-1, 3)
                cells = pa.StructArray.from_arrays(
                    [pa.array(values[:, i]) for i in range(3)], fields=list(cell)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(first, len(texts)) for c in batch.columns],
                        pa.ListArray.from_arrays(pa.array(offsets), cells),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=[*kept, "runs", "collapsed"],
                )
                first += len(texts)

    schema = T.StructType([*given.schema.fields]).add("runs", _RUNS).add("collapsed", T.StringType())
    return given.mapInArrow(of_batches, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the texts go on periodically from some word on.

    With h = crc32 of the id as text and g = floor(h / 10): if h % 10 = 0, each of the n words i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id leaves its text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g"))
    planted = (
        chosen.filter("h % 10 = 0")
        .withColumn("w", words)
        .withColumn("n", F.size("w"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    )
    moved = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.get(
            F.col("w"),
            F.when(i < F.col("a"), i).otherwise(
                F.col("a") + F.pmod(i - F.col("a"), F.col("p"))
            ).cast("int"),
        ),
    )
    text = F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise("")
    rest = chosen.filter("h is null or h % 10 <> 0").select("doc_id", "text")
    return rest.unionByName(planted.select("doc_id", text.alias("text")))


def op13_periodic_runs(spark, folder):
    """One row per document: number of runs, the one with the most turns, digests of runs and rest."""
    found = find(with_planted_runs(tables.read(spark, folder, "documents")).select("doc_id", "text"))

    def ahead(x, best):
        """Whether run x has more turns than ``best``; the lists are sorted, so ties leave the earlier one."""
        return x["length"] * best["period"] > best["length"] * x["period"]

    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda best, x: F.when(ahead(x, best), x).otherwise(best),
    )
    lines = F.transform(
        "runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    )
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}

"""Best-fit packing of documents into sequences, planned on the length histogram.

1. Documents become token ids and an end id; only what is longer than a sequence is cut.
2. The histogram of piece lengths has at most ``limit`` rows, whatever the corpus, and goes to the driver.
3. Patterns of one, two or three lengths that fill a sequence are enumerated, and repeat counts are fitted to
   the histogram by non-negative least squares (accelerated projected gradient). Counts are rounded down,
   never above what the histogram has left.
4. The residual histogram is packed by best fit, longest first, many equal sequences at a time.
5. Pieces of one length are alike, so each takes the place its number has among them. Numbers come from a
   count per task and length, so a length that a third of all pieces have needs no common sort.

The plan's size depends on the number of different lengths, not of documents.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no
rows; other columns of the table are not looked at.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)
from pyspark.sql.window import Window

from basketry.llm import tables
from basketry.llm.encoding import ids_of
from basketry.storage import save

LIMIT, END = 4096, 1
#: Three-length patterns enumerated per shortest length.
PATTERNS_PER_LENGTH = 8
_ROUNDS = 400


def pieces(
    docs: DataFrame, limit: int = LIMIT, end: int = END, path: str | None = None, with_ids=False
) -> DataFrame:
    """One row per piece, with its number (``local``) among the pieces of its length in its task."""
    fields = [
        StructField("doc_id", docs.schema["doc_id"].dataType),
        StructField("piece", IntegerType()),
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids_crc32", LongType()),
        StructField("task", IntegerType()),
        StructField("local", LongType()),
    ]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    schema = StructType(fields)

    def of_batches(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, dtype=np.int64)
        for batch in batches:
            names = batch.column(0)
            for first, texts in ids_of(batch.column(1), path):
                at, number, start, size, crc, local, whole = [], [], [], [], [], [], []
                for i, ids in enumerate(texts):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for low in range(0, len(ids), limit):
                        part = ids[low : low + limit]
                        at.append(first + i)
                        number.append(low // limit)
                        start.append(low)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        local.append(int(seen[len(part)]))
                        seen[len(part)] += 1
                        if with_ids:
                            whole.append(part.astype(np.int32))
                columns = [
                    names.take(pa.array(at, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(at), pa.int32()),
                    pa.array(local, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(whole, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(of_batches, schema)


def patterns(limit: int, present: np.ndarray, per_length: int = PATTERNS_PER_LENGTH) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence, made of lengths that are present."""
    there = np.zeros(limit + 1, dtype=bool)
    there[present] = True
    out = [np.array([[limit, 0, 0]])] if there[limit] else []
    low = np.arange(1, limit // 2 + 1)
    pair = np.stack([low, limit - low, np.zeros_like(low)], axis=1)
    out.append(pair[there[pair[:, 0]] & there[pair[:, 1]]])
    for first in present[present <= limit // 3]:
        second = np.arange(first, (limit - first) // 2 + 1)
        third = limit - first - second
        fits = np.flatnonzero(there[second] & there[third])
        if len(fits):
            chosen = fits[np.linspace(0, len(fits) - 1, min(per_length, len(fits))).astype(int)]
            chosen = np.unique(chosen)
            out.append(
                np.stack([np.full(len(chosen), first), second[chosen], third[chosen]], axis=1)
            )
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = _ROUNDS) -> np.ndarray:
    """Counts x >= 0 of the patterns that make the sum of their lengths closest to the histogram."""
    if not len(rows):
        return np.zeros(0)
    size = len(histogram)

    def lengths(x):
        out = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), minlength=size)
        out[0] = 0
        return out

    # The largest curvature is below the largest row sum of A'A.
    degree = lengths(np.ones(len(rows)))
    step = 1 / max(degree[rows].sum(axis=1).max(), 1)
    x, y, pace = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    target = histogram.astype(float).copy()
    target[0] = 0
    for _ in range(rounds):
        miss = lengths(y) - target
        after = np.maximum(y - step * miss[rows].sum(axis=1), 0)
        quick = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        y = after + (pace - 1) / quick * (after - x)
        x, pace = after, quick
    return x


def plan(histogram: np.ndarray, limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of equal sequences, [(length, how many of it)]) that use up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out = []
    rows = patterns(limit, np.flatnonzero(left))
    count = np.floor(fit_counts(rows, left) + 1e-9).astype(np.int64)
    for at in np.argsort(-count, kind="stable"):
        if count[at] < 1:
            break
        need = {}
        for length in rows[at]:
            if length:
                need[int(length)] = need.get(int(length), 0) + 1
        times = min([int(count[at]), *(int(left[n]) // k for n, k in need.items())])
        if times > 0:
            for n, k in need.items():
                left[n] -= times * k
            out.append((times, sorted(need.items(), reverse=True)))
    return out + _best_fit(left, limit)


def _best_fit(left: np.ndarray, limit: int):
    """Best fit, longest first; sequences that look alike are one entry with a count."""
    open_ = [[] for _ in range(limit + 1)]  # by room: [count, contents]
    room_there = np.zeros(limit + 1, dtype=bool)

    def put(room, count, contents):
        open_[room].append((count, contents))
        room_there[room] = True

    for length in range(limit, 0, -1):
        need = int(left[length])
        while need:
            fits = np.flatnonzero(room_there[length:])
            if len(fits):
                room = length + int(fits[0])
                count, contents = open_[room].pop()
                room_there[room] = bool(open_[room])
            else:
                room, contents = limit, []
                count = -(-need // (limit // length))
            each = room // length
            full = min(count, need // each)
            if full:
                put(room - each * length, full, [*contents, (length, each)])
                need -= full * each
            if count > full and need:
                # Fewer are left than one sequence takes.
                put(room - need * length, 1, [*contents, (length, need)])
                need, full = 0, full + 1
            if count > full and contents:
                put(room, count - full, contents)
    return [entry for room in open_ for entry in room]


def _slots(entries):
    """Arrays, sorted by (length, first number): which numbers of a length go where."""
    out, used, sequence = [], {}, 0
    for count, contents in entries:
        offset = 0
        for length, each in contents:
            first = used.get(length, 0)
            out.append((length, first, sequence, offset, each))
            used[length] = first + count * each
            offset += length * each
        sequence += count
    out.sort()
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, limit: int = LIMIT, end: int = END, path: str | None = None, with_ids=False
) -> DataFrame:
    """One row per piece with its sequence and the offset there; ``with_ids`` adds its token ids."""
    cut = save(pieces(docs, limit, end, path, with_ids), "pieces")
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    per_task = save(per_task, "lengths")
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = _slots(plan(histogram, limit))
    before = (
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    firsts = per_task.select(
        "task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    numbered = cut.join(firsts, ["task", "length"]).withColumn(
        "number", F.col("first") + F.col("local")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = StructType(
        [cut.schema[c] for c in names]
        + [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    )
    # Lengths are at most ``limit``, numbers below 2^40: one sorted key finds the slot.
    keys = (slots[:, 0] << 40) + slots[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(len(names)).to_numpy()
            at = np.searchsorted(keys, (length << 40) + number, side="right") - 1
            _, first, sequence, offset, each = slots[at].T
            rest = number - first
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(names))],
                    pa.array(sequence + rest // each),
                    pa.array(offset + rest % each * length),
                ],
                names=[f.name for f in schema.fields],
            )

    return numbered.select(*names, "number").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from ``pack(..., with_ids=True)``; a sequence has at most ``limit`` ids."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]
            )
        ).alias("ids")
    )


def op7_pattern_packing(spark, folder):
    return pack(tables.read(spark, folder, "documents"))


QUERIES = {"op7_pattern_packing": op7_pattern_packing}

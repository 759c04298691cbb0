"""Conversation structure repair: the cheapest edits that make the roles of each conversation take turns.

A repaired conversation has role initials ``(s?(ua)+)?``. Edits: Keep costs 0, Rerole to user or assistant 3,
Delete 4, Insert of an empty user or assistant turn 3. A turn that is kept or reroled though truncated costs 3
more; blank and duplicate turns must go. Among the cheapest, the edits whose initials sort first are taken.

The pattern has four states, so the cheapest way on from a turn is a vector of four costs, worked out from the last
turn backwards (Viterbi). Conversations are cut into chunks of bounded turns and bytes, and rank convergence lets
all chunks run at once:

1. Every chunk but a conversation's last starts from a speculative vector. Vectors that differ only by a constant
   lead to the same edits, so they are kept relative to their first entry.
2. Fix-up passes: a chunk whose start is not what its successor found, beyond a constant, runs again. The passes
   end when no vector changes; usually the vector has converged within a chunk, and one or two passes do.
3. With the stitched backward costs each chunk is traced forward, taking at each turn the first of D, I, K, R
   that lies on a cheapest way: from all four states, then from the one in which its predecessor ends.

Rows are ordered by a range shuffle on (conversation, turn, role, beginning of the text), so a conversation of
any length is spread over tasks. Only one small row per chunk of a conversation meets in one place.
The digest of a whole conversation is sequential by nature: its pieces stream through one task, one at a time.

Edge cases: a null role or text counts as one space, null turns come first and make no gap; equal turns are
ordered by role, then text; a null conv_id is a conversation. A conversation that has no rows has no edits. Long
texts are a chunk of their own. Other columns are not looked at. An empty table gives an empty table.
"""

import hashlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry import storage
from basketry.llm import tables

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: A chunk holds at most so many turns, and no further turn once it holds so many bytes.
CHUNK_TURNS, CHUNK_BYTES = 1024, 4 << 20

#: States: nothing yet, after system, after user, after assistant. What follows each: a user, but after a user
#: an assistant.
_NEXT, _NEXT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Cost to the end of a conversation from each state: up to two turns are inserted.
_END, _GUESS = (0, 2 * INSERT, INSERT, 0), (0, 0, 0, 0)
#: A turn is a letter: 4 * (initial: s, u, a, other) + (fault: none, truncated, blank, duplicate).
_LETTERS = "ABCDEFGHIJKLMNOP"
_BLANKS = " \t\n\x0b\x0c\r"


class Repair(NamedTuple):
    """``audits``: a row per conversation; ``turns``: what is left, in order of (conv_id, piece, place).

    ``pieces``: the same in pieces of a conversation, ``piece`` ascending, as a list of (role, text); ``alone``
    where the piece is the whole conversation.
    """

    audits: DataFrame
    turns: DataFrame
    pieces: DataFrame


def _relative(costs):
    return tuple(c - costs[0] for c in costs)


@lru_cache(maxsize=1 << 16)
def _ways(after: tuple, letter: str):
    """Per state: (cost to go, edits up to and with this turn, state after it, their cost)."""
    initial, fault = divmod(_LETTERS.index(letter), 4)
    extra = CUT_OFF if fault == 1 else 0
    direct = []
    for state in range(4):
        options = [(DELETE + after[state], "D", state, DELETE)]
        if fault < 2:
            user_next = state != 2
            kept = {0: 1 if state == 0 else None, 1: 2 if user_next else None, 2: None if user_next else 3}
            target = kept.get(initial)
            if target is not None:
                options.append((KEEP + extra + after[target], "K", target, KEEP + extra))
            options.append((REROLE + extra + after[_NEXT[state]], "R", _NEXT[state], REROLE + extra))
        direct.append(min(options))
    out = []
    for state in range(4):
        options, at = [], state
        # Two inserted turns lead back to the same state, so one or two are enough.
        for inserted in range(3):
            cost, edit, target, own = direct[at]
            options.append((inserted * INSERT + cost, "I" * inserted + edit, target, inserted * INSERT + own))
            at = _NEXT[at]
        out.append(min(options))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _before(after: tuple, letter: str) -> tuple:
    return _relative([way[0] for way in _ways(after, letter)])


def backward(letters: str, after: tuple) -> list[tuple]:
    """Relative costs to go before each turn, and after the last one."""
    vectors = [_relative(after)]
    for letter in reversed(letters):
        vectors.append(_before(vectors[-1], letter))
    return vectors[::-1]


def trace(letters: str, vectors: list[tuple], state: int):
    """(edits, their cost, state after them) of the first of the cheapest ways from this state."""
    edits, total = [], 0
    for letter, after in zip(letters, vectors[1:]):
        _, edit, state, cost = _ways(after, letter)[state]
        edits.append(edit)
        total += cost
    return "".join(edits), total, state


def finish(state: int):
    """Turns inserted after the last one: (edits, cost)."""
    count = {0: 0, 1: 2, 2: 1, 3: 0}[state]
    return "I" * count, count * INSERT


def planned(audit: str, letters: str, state: int):
    """(slot or -1, new role or None) of each turn that is left, for a chunk entered in this state."""
    out, slot = [], 0
    for edit in audit:
        if edit == "I":
            out.append((-1, _NEXT_ROLE[state]))
            state = _NEXT[state]
            continue
        if edit == "K":
            out.append((slot, None))
            initial = _LETTERS.index(letters[slot]) // 4
            state = initial + 1
        elif edit == "R":
            out.append((slot, _NEXT_ROLE[state]))
            state = _NEXT[state]
        slot += 1
    return out


def illegal(letters: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = [_LETTERS.index(x) // 4 for x in letters]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def _cut_into_chunks(batches, most_turns: int, most_bytes: int):
    """Rows sorted by conversation become one row per chunk, with lists of what its turns have."""
    part, count, waiting = TaskContext.get().partitionId(), 0, None

    def emit(table, bounds):
        nonlocal count
        offsets = pa.array(bounds, pa.int32())
        heads = pa.array(bounds[:-1], pa.int64())
        blocks = [(part << 32) + count + i for i in range(len(bounds) - 1)]
        count += len(blocks)
        columns = {name: table[name].combine_chunks() for name in table.column_names}
        lists = {
            n: pa.ListArray.from_arrays(offsets, columns[n])
            for n in ("turn", "role", "text", "letter", "key")
        }
        return pa.RecordBatch.from_arrays(
            [
                columns["conv_id"].take(heads),
                columns["conv"].take(heads),
                pa.array(blocks, pa.int64()),
                *lists.values(),
            ],
            names=["conv_id", "conv", "block", *lists],
        )

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        names = table["conv"].to_pylist()
        sizes = table["size"].to_pylist()
        bounds, held = [0], 0
        for i, name in enumerate(names):
            first = bounds[-1]
            if i > first and (
                name != names[first] or i - first >= most_turns or held + sizes[i] > most_bytes
            ):
                bounds.append(i)
                held = 0
            held += sizes[i]
        if len(bounds) > 1:
            yield emit(table.slice(0, bounds[-1]).combine_chunks(), bounds)
        waiting = table.slice(bounds[-1])
    if waiting is not None and waiting.num_rows:
        yield emit(waiting.combine_chunks(), [0, waiting.num_rows])


def _chunks(rows: DataFrame, most_turns: int, most_bytes: int) -> DataFrame:
    """Chunks of turns in order: conv_id, conv, block and lists of turn, role, text, letter, key."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(
        "conv_id",
        # A name that is never null.
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
        "turn",
        role.alias("role"),
        text.alias("text"),
    )
    ended = F.rtrim("text", F.lit(_BLANKS))
    # Without characters at all a turn is blank, whatever its role.
    fault = F.when(ended == "", 2).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    ordered = plain.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(
        *order, F.asc("text")
    )
    marked = ordered.select(
        "*",
        F.substring(F.lit(_LETTERS), 4 * initial + fault + 1, F.lit(1)).alias("letter"),
        F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)).alias("key"),
        F.octet_length("text").alias("size"),
    )
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = (
        f"conv_id {conv}, conv string, block long, turn array<{turn}>, role array<string>, "
        "text array<string>, letter array<string>, key array<binary>"
    )
    return marked.mapInArrow(lambda batches: _cut_into_chunks(batches, most_turns, most_bytes), schema)


def _with_duplicates(chunks: DataFrame) -> DataFrame:
    """(conv, conv_id, block, letters): the letters of a chunk, with turns seen earlier marked."""
    spread = chunks.select("conv", "block", F.posexplode("key").alias("slot", "key"))
    firsts = (
        spread.groupBy("conv", "key")
        .agg(F.min(F.struct("block", "slot")).alias("first"), F.count("*").alias("many"))
        .filter("many > 1")
    )
    again = (
        spread.join(firsts, ["conv", "key"])
        .filter(F.struct("block", "slot") > F.col("first"))
        .groupBy("block")
        .agg(F.collect_list("slot").alias("again"))
    )

    def marked(letter, slot):
        place = F.instr(F.lit(_LETTERS), letter) - 1
        seen = F.array_contains("again", slot) & (place % 4 != 2)
        duplicate = F.substring(F.lit(_LETTERS), place - place % 4 + 4, F.lit(1))
        return F.when(seen, duplicate).otherwise(letter)

    none = F.array().cast("array<int>")
    return (
        chunks.select("conv_id", "conv", "block", "letter")
        .join(again, "block", "left")
        .withColumn("again", F.coalesce(F.array_sort("again"), none))
        .select(
            "conv_id", "conv", "block", F.array_join(F.transform("letter", marked), "").alias("letters")
        )
    )


_VECTOR = "array<int>"


def _run_backward(batches):
    for batch in batches:
        starts = [
            list(backward(letters, tuple(right))[0])
            for letters, right in zip(batch["letters"].to_pylist(), batch["right"].to_pylist())
        ]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(starts, pa.list_(pa.int32()))], names=[*names, "left"]
        )


def _stitched(several: DataFrame) -> DataFrame:
    """(block, right): the costs after each chunk, once no chunk's start differs from its successor's."""
    guess, end = (F.array(*[F.lit(c) for c in v]) for v in (_GUESS, _END))
    given = several.select(
        "block", "next", "letters", F.when(F.col("next").isNull(), end).otherwise(guess).alias("right")
    )
    schema = f"block long, next long, letters string, right {_VECTOR}, left {_VECTOR}"
    done = storage.save(given.mapInArrow(_run_backward, schema), "backward")
    while True:
        found = done.select(F.col("block").alias("next"), F.col("left").alias("found"))
        joined = done.join(found, "next", "left")
        stale = F.coalesce(F.col("found") != F.col("right"), F.lit(False))
        again = storage.save(
            joined.filter(stale).select("block", "next", "letters", F.col("found").alias("right")), "again"
        )
        if again.isEmpty():
            return done.select("block", "right")
        kept = done.join(again.select("block"), "block", "left_anti").select(*done.columns)
        done = storage.save(kept.unionByName(again.mapInArrow(_run_backward, schema)), "backward")


def _exits(batches):
    for batch in batches:
        out = []
        for letters, right in zip(batch["letters"].to_pylist(), batch["right"].to_pylist()):
            vectors = backward(letters, tuple(right))
            out.append([trace(letters, vectors, state)[2] for state in range(4)])
        yield pa.RecordBatch.from_arrays(
            [batch["conv"], batch["block"], pa.array(out, pa.list_(pa.int32()))],
            names=["conv", "block", "exits"],
        )


def _entries(table: pa.Table) -> pa.Table:
    """The state in which each chunk of one conversation is entered."""
    table = table.sort_by("block")
    state, out = 0, []
    for exits in table["exits"].to_pylist():
        out.append(state)
        state = exits[state]
    return pa.table({"block": table["block"], "entry": pa.array(out, pa.int32())})


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_EDITED = (
    "conv string, block long, cost long, audit string, blank long, duplicate long, truncated long, "
    "illegal long, plan array<struct<slot: int, role: string>>, alone boolean"
)


def _edit(batches):
    cell = pa.struct([("slot", pa.int32()), ("role", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            letters, entry = row["letters"], row["entry"]
            vectors = backward(letters, tuple(row["right"]))
            audit, cost, state = trace(letters, vectors, entry)
            if row["next"] is None:
                more, extra = finish(state)
                audit, cost = audit + more, cost + extra
            faults = [_LETTERS.index(x) % 4 for x in letters]
            plan = [{"slot": s, "role": r} for s, r in planned(audit, letters, entry)]
            counts = (faults.count(2), faults.count(3), faults.count(1))
            out.append(
                (
                    *(row["conv"], row["block"], cost, audit, *counts),
                    *(illegal(letters + row["ahead"]), plan, row["alone"]),
                )
            )
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        kinds += [pa.list_(cell), pa.bool_()]
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["conv", "block", "cost", "audit", *_COUNTS, "plan", "alone"],
        )


def _edits(chunks: DataFrame) -> DataFrame:
    """What is done to each chunk: see ``_EDITED``."""
    # A row per chunk of a conversation, a thousandth of its turns.
    along = Window.partitionBy("conv").orderBy("block")
    marked = storage.save(
        _with_duplicates(chunks)
        .withColumn("next", F.lead("block").over(along))
        .withColumn("ahead", F.coalesce(F.substring(F.lead("letters").over(along), 1, 1), F.lit("")))
        .withColumn("number", F.row_number().over(along)),
        "marked",
    )
    alone = (F.col("number") == 1) & F.col("next").isNull()
    several = marked.filter(~alone)
    given = marked.filter(alone).select(
        "conv",
        "block",
        "next",
        "letters",
        "ahead",
        F.array(*[F.lit(c) for c in _END]).alias("right"),
        F.lit(0).alias("entry"),
        F.lit(True).alias("alone"),
    )
    if not several.isEmpty():
        right = several.select("conv", "block", "next", "letters", "ahead").join(_stitched(several), "block")
        entries = (
            right.mapInArrow(_exits, "conv string, block long, exits array<int>")
            .groupBy("conv")
            .applyInArrow(_entries, "block long, entry int")
        )
        given = given.unionByName(right.join(entries, "block").withColumn("alone", F.lit(False)))
    return storage.save(given.mapInArrow(_edit, _EDITED), "edits")


def repair(rows: DataFrame, chunk_turns: int = CHUNK_TURNS, chunk_bytes: int = CHUNK_BYTES) -> Repair:
    """Repair conversations given as (conv_id, turn, role, text). The tables read saved ones: see storage.

    ``audits`` has conv_id, gaps (turn numbers that are missing between the least and the greatest), blank,
    duplicate, truncated (turns whose first fault that is), illegal (neighbours out of turn), cost and audit.
    """
    chunks = storage.save(_chunks(rows, chunk_turns, chunk_bytes), "chunks")
    edits = _edits(chunks)
    turns = (
        chunks.select("conv", "conv_id", F.explode_outer("turn").alias("turn"))
        .groupBy("conv")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.min("turn").alias("least"),
            F.max("turn").alias("most"),
            F.count_distinct("turn").alias("different"),
        )
    )
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("different"), F.lit(0)).cast("long")
    in_order = F.array_sort(F.collect_list(F.struct("block", "audit")))
    sums = edits.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in (*_COUNTS, "cost")],
        F.array_join(F.transform(in_order, lambda x: x["audit"]), "").alias("audit"),
    )
    audits = turns.join(sums, "conv").select(
        "conv_id", gaps.alias("gaps"), *_COUNTS, "cost", "audit"
    )

    def as_left(p):
        kept = p["slot"] >= 0
        return F.struct(
            F.coalesce(p["role"], F.get("role", p["slot"])).alias("role"),
            F.when(kept, F.get("text", p["slot"])).otherwise("").alias("text"),
        )

    pieces = (
        chunks.select("conv_id", "conv", "block", "role", "text")
        .join(edits.select("block", "plan", "alone"), "block")
        .select(
            "conv_id",
            "conv",
            F.col("block").alias("piece"),
            "alone",
            F.transform("plan", as_left).alias("turns"),
        )
    )
    spread = pieces.select("conv_id", "piece", F.posexplode("turns").alias("place", "t"))
    return Repair(audits, spread.select("conv_id", "piece", "place", "t.role", "t.text"), pieces)


def damage(rows: DataFrame) -> DataFrame:
    """Faults for tests, by crc32 of ``conv_id:turn`` modulo 20; a null is one space.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats the row, 4 makes the role user.
    """
    parts = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    h = F.crc32(F.concat(parts["conv_id"], F.lit(":"), parts["turn"]).cast("binary")) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", ""))
    many = F.when(F.col("h") == 3, 2).otherwise(1)
    return (
        rows.select("conv_id", "turn", parts["role"].alias("role"), parts["text"].alias("text"), h.alias("h"))
        .filter("h <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
            text.otherwise(F.col("text")).alias("text"),
            F.explode(F.array_repeat(F.lit(0), many)).alias("copy"),
        )
        .drop("copy")
    )


def _digest(batches):
    """SHA-256 of each conversation, whose pieces come one after the other."""
    name, state, empty = None, None, True
    for batch in batches:
        out = []
        for conv, count, lines in zip(*(batch[c].to_pylist() for c in ("conv", "count", "lines"))):
            if conv != name:
                if state is not None:
                    out.append((name, state.hexdigest()))
                name, state, empty = conv, hashlib.sha256(), True
            if count:
                state.update((b"" if empty else b"\n") + lines.encode())
                empty = False
        yield pa.RecordBatch.from_pydict(
            {"conv": pa.array([x[0] for x in out], pa.string()), "sha": pa.array([x[1] for x in out], pa.string())}
        )
    if state is not None:
        yield pa.RecordBatch.from_pydict({"conv": [name], "sha": [state.hexdigest()]})


def digests(pieces: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` lines; only conversations of several pieces are moved."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    lined = pieces.select(
        "conv", "piece", "alone", F.size("turns").alias("count"), F.array_join(line, "\n").alias("lines")
    )
    whole = lined.filter("alone").select("conv", F.sha2(F.col("lines").cast("binary"), 256).alias("sha"))
    streamed = (
        lined.filter("not alone")
        .repartition("conv")
        .sortWithinPartitions("conv", "piece")
        .mapInArrow(_digest, "conv string, sha string")
    )
    return whole.unionByName(streamed)


def report(rows: DataFrame, originals: DataFrame, **options) -> DataFrame:
    """One row per conv_id of ``originals``: what :func:`repair` says of ``rows``, with a digest of what is left."""
    fixed = repair(rows, **options)
    named = fixed.pieces.select("conv", "conv_id").distinct()
    sha = named.join(digests(fixed.pieces), "conv").select(F.col("conv_id").alias("_sha_id"), "sha")
    audits = fixed.audits.withColumnRenamed("conv_id", "_id")
    numbers = ("gaps", *_COUNTS, "cost")
    return (
        originals.select("conv_id")
        .distinct()
        .join(audits, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
        .join(sha, F.col("conv_id").eqNullSafe(F.col("_sha_id")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )


def op11_conversation_repair(spark, folder):
    """One row per conversation: faults, the cheapest edits and a digest of what they leave."""
    rows = tables.read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return report(damage(rows), rows)


QUERIES = {"op11_conversation_repair": op11_conversation_repair}

import hashlib
import itertools
import random
import re
import zlib

import pytest

from basketry.llm import conversation_repair as cr

ROLES = ("user", "assistant", "system", "tool", None, "sUser", "")
FULL = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Rows after damage, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        row = (turn, "user" if h == 4 else role, text)
        out[conv] += [row, row] if h == 3 else [row]
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else ""
        if not fault and ink[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows, marks):
    """(cost, audit, lines) by dynamic programming over (row, state), costs and audits compared as a pair."""
    best = {(len(rows), ""): (0, "", ()), (len(rows), "a"): (0, "", ())}
    for i in range(len(rows), -1, -1):
        for _ in range(3):
            for state, steps in STEP.items():
                options = [best[i, state]] if (i, state) in best else []
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if initial in steps and (i, steps[initial]) in best:
                        cost, audit, lines = best[i, steps[initial]]
                        options.append((cost + 3, "I" + audit, (f"{role}:", *lines)))
                if i < len(rows):
                    extra = 3 if marks[i] == "truncated" else 0
                    if (i + 1, state) in best:
                        cost, audit, lines = best[i + 1, state]
                        options.append((cost + 4, "D" + audit, lines))
                    if marks[i] not in ("blank", "duplicate"):
                        _, own, text = rows[i]
                        for kind, role, price in (("K", own, 0), ("R", "user", 3), ("R", "assistant", 3)):
                            after = (i + 1, steps.get(role[:1]))
                            if after in best:
                                cost, audit, lines = best[after]
                                options.append((cost + price + extra, kind + audit, (f"{role}:{text}", *lines)))
                if options:
                    best[i, state] = min(options, key=lambda o: o[:2])
    return best[0, ""]


def expected(rows):
    out = []
    for conv, mine in damaged(rows).items():
        marks = faults(mine)
        cost, audit, lines = cheapest(mine, marks)
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = (marks.count("blank"), marks.count("duplicate"), marks.count("truncated"))
        out.append((conv, gaps, *counts, illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    schema = "conv_id long, turn long, role string, text string, conv int"
    table = spark.createDataFrame([(*r, 1) for r in rows], schema)
    return sorted(map(tuple, cr.report(cr.damage(table), table, **options).collect()), key=repr)


def random_rows(seed, conversations=150, longest=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What? ", "So!\n", "", " \t", None, "é.", "...", "a\nb."]
    out = [(None, None, "user", "Hi."), (None, 3, "assistant", "Ho.")]
    for conv in range(conversations):
        turns = list(range(rng.randint(1, longest)))
        for turn in turns:
            role = rng.choice(ROLES) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}{rng.choice(['.', '', '?'])}"
            out.append((conv, rng.choice([turn, turn, turn + 4, None]), role, text))
    return out


def test_plain_form_against_all_edits():
    """The dynamic programme of this file, against every sequence of edits on a few turns."""
    rng = random.Random(1)
    for _ in range(40):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "B", "C?", ""])) for i in range(rng.randint(0, 3))]
        marks, best = faults(rows), None
        for many in itertools.product(range(3), repeat=len(rows) + 1):
            for edits in itertools.product("DKR", repeat=len(rows)):
                if any(m in ("blank", "duplicate") and e != "D" for m, e in zip(marks, edits)):
                    continue
                audit = "".join("I" * n + e for n, e in zip(many, [*edits, ""]))
                slots = [None if e in "IR" else "K" for e in audit if e != "D"]
                kept = iter([r[1][:1] for r, e in zip(rows, edits) if e == "K"])
                slots = [next(kept) if s else None for s in slots]
                free = [j for j, s in enumerate(slots) if s is None]
                for roles in itertools.product("ua", repeat=len(free)):
                    for j, role in zip(free, roles):
                        slots[j] = role
                    if FULL.fullmatch("".join(slots)):
                        cost = 3 * sum(many) + sum({"D": 4, "K": 0, "R": 3}[e] for e in edits)
                        cost += 3 * sum(m == "truncated" and e != "D" for m, e in zip(marks, edits))
                        best = min(best or (cost, audit), (cost, audit))
        assert cheapest(rows, marks)[:2] == best


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    assert got(spark, rows) == expected(rows)


def test_chunks_of_a_few_turns(spark):
    rows = random_rows(4, conversations=20, longest=60)
    # A conversation whose vectors stay apart for long: only system turns that must not be kept.
    rows += [(99, i, "system", f"{i}.") for i in range(40)]
    assert got(spark, rows, chunk_turns=3) == expected(rows)


def test_chunks_of_a_few_bytes(spark):
    rows = random_rows(5, conversations=10, longest=30) + [(77, 1, "user", "long " * 10000)]
    assert got(spark, rows, chunk_bytes=30) == expected(rows)


def test_conversations_that_lose_every_row(spark):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hi.") for c in gone]
    result = got(spark, rows)
    assert result == sorted([(c, *[0] * 6, "", hashlib.sha256(b"").hexdigest()) for c in gone], key=repr)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in table.collect()]
    result = sorted(map(tuple, cr.op11_conversation_repair(spark, folder).collect()), key=repr)
    assert result == expected(rows)
    fixed = cr.repair(cr.damage(table))
    lines = {}
    for r in fixed.turns.collect():
        lines.setdefault(r.conv_id, []).append((r.piece, r.place, r.role[:1]))
    assert lines
    assert all(FULL.fullmatch("".join(x[2] for x in sorted(v))) for v in lines.values())

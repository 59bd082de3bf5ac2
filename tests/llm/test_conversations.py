"""Conversation repair against exhaustive search, with short and long conversations on the same path of results."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpuswright.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string, rows string, uid string, part int"


def every_edit(rows, deepest):
    """(cost, audit, lines) of the least edit over all of them; rows are (role, text, must go, truncated)."""
    fills = [f for k in range(deepest + 1) for f in itertools.product("ua", repeat=k)]
    best = None
    for gaps in itertools.product(fills, repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for fill, edit, row in itertools.zip_longest(gaps, edits, rows):
                for role in fill:
                    cost, audit = cost + 5, audit + "I"
                    lines.append({"u": "user", "a": "assistant"}[role] + ":")
                if edit is None:
                    continue
                role, text, gone, broken = row
                if edit == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if gone:
                    break
                cost += 5 * broken + (edit != "K")
                audit += "K" if edit == "K" else "R"
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[edit]}:{text}")
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(x[0] if x[0] != ":" else "?" for x in lines)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best


def plain(rows):
    """The result columns for (turn, role, text) rows, deciding by exhaustive search."""
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        marked.append((role, text, fault in (0, 1), fault == 2))
    cost, audit, lines = every_edit(marked, 2 if len(rows) < 3 else 1)
    turns = [t for t, *_ in rows if t is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(30))
def test_integers_decide_as_exhaustive_search(seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice([None, 0, 1, 5]), rng.choice(["system", "user", "assistant", "tool", "", " ", "unknown"]), rng.choice(["a.", "a.", "b!", "cut", " \n", ""]))
        for _ in range(rng.randrange(0, 5))
    ]
    assert C.repair(rows, {}) == plain(rows)


@pytest.mark.parametrize("seed", range(20))
def test_blocks_put_together_are_the_whole(seed):
    rng = random.Random(seed)
    symbols = [rng.choice(["s", "u", "a", "o", "u!", "a!", "U", "A", "S", "u", "a"]) for _ in range(rng.randrange(1, 40))]
    cut = sorted({0, len(symbols), *(rng.randrange(len(symbols)) for _ in range(4))})
    blocks = [C.crossings(symbols[a:b]) for a, b in zip(cut, cut[1:])]
    cost, parts, tail = C.put_together(blocks)
    assert (cost, "".join(a for _, a in parts) + tail) == C.cheapest(tuple(symbols))


def _conversations():
    rng = random.Random(4)
    out = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "No."), (2, None, None, None),
           (2, None, "user", "x?"), (2, None, "user", None), (3, 4, "", ""), (None, 0, "user", "Q?"), (None, 9, "assistant", "A."), (None, None, None, "A."),
           (5, 0, "system", "Only."), (7, 1 << 62, "user", "far."), (7, -(1 << 62), "assistant", "Very " * 20_000 + "long."),
           *((8, t << 62, "user", "far.") for t in (-2, -1, 0, 1))]
    for c in range(20, 60):
        out += [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two!", "three", "Ä ö ü?"])) for t in range(rng.randrange(1, 5))]
    return out


def _damaged(rows):
    """Rows per conversation after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        given = (role if role is not None else " ", text if text is not None else " ")
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        role, text = given
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        place = (turn is not None, turn or 0, given[0], hashlib.md5(given[1].encode()).hexdigest())
        own += [(place, turn, role, text)] * (2 if kind == 3 else 1)
    return {c: [r[1:] for r in sorted(own, key=lambda r: r[0])] for c, own in out.items()}


def _table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", "z", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [C.BLOCK, 3])
def test_damaged_conversations(spark, block):
    rows = _conversations()
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair_conversations(_table(spark, rows), C.damage, block).collect()}
    want = {c: C.repair(own, {}) for c, own in _damaged(rows).items()}
    assert got == want
    for c, own in _damaged(rows).items():
        if len(own) < 5:
            assert got[c] == plain(own)


def test_a_conversation_of_many_blocks(spark):
    """One conversation with nearly all rows, ties and repeated rows included, cut and not cut."""
    rng = random.Random(9)
    rows = [(1, rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b?", "c", " "])) for _ in range(400)]
    rows += [(2, 0, "user", "Q?"), (2, 1, "assistant", "A.")]
    table = _table(spark, rows)
    whole = sorted(tuple(r) for r in C.repair_conversations(table).collect())
    assert sorted(tuple(r) for r in C.repair_conversations(table, block=16).collect()) == whole
    assert [r[0] for r in whole] == [1, 2] and whole[1][6:8] == (0, "KK")


def test_nothing_to_repair(spark):
    empty = C.repair_conversations(_table(spark, []), C.damage)
    assert empty.count() == 0 and empty.columns[0] == "conv_id"
    # every row is dropped by the damage: the conversation is there with zeros
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = C.repair_conversations(_table(spark, [(gone, 0, "user", "x.")]), C.damage).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

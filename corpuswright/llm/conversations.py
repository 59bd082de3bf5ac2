"""Conversation repair: the cheapest edits that give every conversation roles `(s?(ua)+)?`, as one integer minimum.

A way to repair the rows from some row on is one integer. Its high digits are the cost; below them stand `width` digits of
three bits, the audit letters from the left, with zeros behind the last one. So the smaller of two integers is the
cheaper way and, at equal cost, the one whose letters are ASCII-least, a prefix coming first. Putting an edit in front adds its
cost to the high digits, moves the letters by one digit and sets the first. The nodes of the graph are (row, role
emitted last); walking the rows backwards, the value of a node is the least integer among its edits. Nothing else decides.

At most one insertion in front of a row is looked at: two are `ua` or `au`, and taking both out costs 10 less and leaves legal
roles; where only a system row would be left, deleting that costs 2.

A conversation of up to `BLOCK` rows is one row of a grouped table. A longer one, which may hold a third of all
rows, is cut by sampled range bounds into blocks of at most `BLOCK` rows. For every block the least integers from each role
before it to each role after it are found on their own; they put together like edits. Letters go back to the blocks, which
write their pieces of the repaired text, and SHA-256, which cannot be split, reads the pieces in order, one in memory at a
time. Repeated rows are found by grouping digests. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import cut_lineage
from .samples import crc_of

#: rows of a conversation that one task holds at once
BLOCK = 4096
#: shapes of conversations whose least integer a task remembers
REMEMBERED = 1 << 14
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_BITS = 3
_BLANKS = " \t\n\x0b\x0c\r"
#: roles emitted last: none, system, user, assistant; and the role that may follow each, other than system
STATES = "-sua"
_NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}
_ROLE = {"u": "user", "a": "assistant"}
_LEGAL = ("su", "ua", "au")
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# --- the integers -----------------------------------------------------------------------------------------------


def in_front(value: int, cost: int, letters: str, width: int) -> int:
    """The integer of a way with edits put in front of it."""
    low = value & ((1 << _BITS * width) - 1)
    code = 0
    for letter in letters:
        code = code << _BITS | _DIGIT[letter]
    k = len(letters)
    return value - low + (cost << _BITS * width) + (code << _BITS * (width - k)) + (low >> _BITS * k)


def read_back(value: int, width: int) -> tuple[int, str]:
    """(cost, audit letters) of an integer."""
    letters = []
    for place in range(width - 1, -1, -1):
        digit = value >> _BITS * place & 7
        if not digit:
            break
        letters.append(" DIKR"[digit])
    return value >> _BITS * width, "".join(letters)


def _before_row(symbol: str, after: dict[str, int], width: int) -> dict[str, int]:
    """Values of the states in front of a row, given those behind it.

    A symbol is the initial of the role (`o` if it is none of sua), upper case for a row that must go, followed by `!` for
    a truncated one.
    """
    gone, broken = symbol[0].isupper(), TRUNCATED * symbol.endswith("!")
    initial = symbol[0]
    own: dict[str, int] = {}
    for state in STATES:
        ways = []
        if state in after:
            ways.append(in_front(after[state], DELETE, "D", width))
        follow = _NEXT[state]
        if not gone:
            if initial == "s" and state == "-" and "s" in after:
                ways.append(in_front(after["s"], KEEP + broken, "K", width))
            if follow in after:
                kept = initial == follow
                ways.append(in_front(after[follow], (KEEP if kept else REROLE) + broken, "K" if kept else "R", width))
        if ways:
            own[state] = min(ways)
    before = dict(own)
    for state in STATES:
        follow = _NEXT[state]
        if follow in own:
            way = in_front(own[follow], INSERT, "I", width)
            before[state] = min(before.get(state, way), way)
    return before


def _ends(width: int) -> dict[str, int]:
    """Values behind the last row: what is missing is inserted."""
    return {"-": 0, "s": in_front(0, 2 * INSERT, "II", width), "u": in_front(0, INSERT, "I", width), "a": 0}


def cheapest(symbols: tuple[str, ...]) -> tuple[int, str]:
    """(cost, audit) of the least integer over a whole conversation."""
    width = 2 * len(symbols) + 2
    values = _ends(width)
    for symbol in reversed(symbols):
        values = _before_row(symbol, values, width)
    return read_back(values["-"], width)


def crossings(symbols: list[str]) -> list[tuple[str, str, int, str]]:
    """(state before, state behind, cost, audit) of the least integer of a block for every pair of states that it has."""
    width, out = 2 * len(symbols), []
    for last in STATES:
        values = {last: 0}
        for symbol in reversed(symbols):
            values = _before_row(symbol, values, width)
        out += [(state, last, *read_back(value, width)) for state, value in values.items()]
    return out


def put_together(blocks: list[list[tuple[str, str, int, str]]]) -> tuple[int, list[tuple[str, str]], str]:
    """(cost, state before each block and its letters, letters behind the last) from the crossings of all blocks in order."""
    width = 2 + sum(max(len(audit) for *_, audit in block) for block in blocks)
    values = _ends(width)
    chosen: list[dict[str, tuple[str, str]]] = []
    for block in reversed(blocks):
        best: dict[str, int] = {}
        pick: dict[str, tuple[str, str]] = {}
        for state, last, cost, audit in block:
            if last in values:
                way = in_front(values[last], cost, audit, width)
                if state not in best or way < best[state]:
                    best[state], pick[state] = way, (last, audit)
        values = best
        chosen.append(pick)
    state, parts = "-", []
    for pick in reversed(chosen):
        last, audit = pick[state]
        parts.append((state, audit))
        state = last
    cost, audit = read_back(values["-"], width)
    return cost, parts, audit[sum(len(a) for _, a in parts) :]


# --- rows of one conversation -------------------------------------------------------------------------------------


def _symbol(role: str, gone: bool, broken: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (initial.upper() if gone else initial) + ("!" if broken else "")


def _faults(role: str, text: str, repeated: bool) -> tuple[bool, bool, bool]:
    """The first fault of a row: (blank, duplicate, truncated)."""
    end = text.rstrip(_BLANKS)
    if not end:
        return True, False, False
    if repeated:
        return False, True, False
    return False, False, end[-1] not in ".!?"


def edited(state: str, audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired lines `role:text` of (role, text) rows under an audit that starts behind `state`."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = role[:1]
        else:
            state = _NEXT[state]
            role = _ROLE[state]
        yield f"{role}:{text}"


def _gaps(turns: list[int]) -> int:
    if not turns:
        return 0
    return min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1)


def repair(rows: list[tuple[int | None, str, str]], known: dict) -> tuple:
    """The columns of the result for the damaged rows (turn, role, text) of one conversation in order.

    `known` remembers the outcome of up to `REMEMBERED` sequences of symbols.
    """
    seen: set[tuple[str, str]] = set()
    symbols, counts = [], [0, 0, 0]
    for _, role, text in rows:
        faults = _faults(role, text, (role, text) in seen)
        seen.add((role, text))
        counts = [n + f for n, f in zip(counts, faults)]
        symbols.append(_symbol(role, faults[0] or faults[1], faults[2]))
    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:]))
    shape = tuple(symbols)
    if shape not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        known[shape] = cheapest(shape)
    cost, audit = known[shape]
    lines = edited("-", audit, ((role, text) for _, role, text in rows))
    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return _gaps([t for t, *_ in rows if t is not None]), *counts, illegal, cost, audit, digest


# --- Spark ----------------------------------------------------------------------------------------------------------


def damage(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    """Struct (copies, role, text): what the test damage makes of a row, by crc32(`conv_id:turn`) mod 20; null is one space."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = crc_of(F.concat(blank(conv_id), F.lit(":"), blank(turn))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.translate(blank(text), ".!?", "")).otherwise(blank(text))
    return F.struct(
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
        F.when(kind == 4, "user").otherwise(blank(role)).alias("role"),
        body.alias("text"),
    )


def as_given(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    """Rows as they stand; null roles and texts are one space."""
    return F.struct(
        F.lit(1).alias("copies"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text.cast("string"), F.lit(" ")).alias("text")
    )


def _in_order(lists: pa.ListArray, known: dict) -> pa.Array:
    offsets = lists.offsets.to_pylist()
    cells = lists.values
    turns, copies, roles, texts = (cells.field(name).to_pylist() for name in ("turn", "copies", "role", "text"))
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        out.append(repair([(turns[k], roles[k], texts[k]) for k in range(a, b) for _ in range(copies[k])], known))
    names = [part.split()[0] for part in _RESULT.split(", ")]
    types = [pa.int64() if part.endswith("long") else pa.string() for part in _RESULT.split(", ")]
    columns = zip(*out) if out else [[]] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _repair_lists(lists: Column) -> Column:
    known: dict = {}

    def run(column: pa.Array) -> pa.Array:
        return _in_order(column, known)

    return arrow_udf(run, _RESULT)(lists)


def repair_conversations(rows: DataFrame, change=as_given, block: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `change` makes (copies, role, text) of a row; a conversation of which no copy is left is there with zeros, an empty audit
    and the digest of the empty text. Rows are taken by turn, null first; rows of one turn by role and by the MD5 of the
    text, as given, so that repeated rows are neighbours. A null conversation id is a conversation of its own. A role's
    initial is its first character; a role without one can only be changed or deleted. `gaps` stops at the largest long. Other
    columns are not looked at.
    """
    col = lambda name: F.col(f"`{name}`")
    made = change(*(col(c) for c in (conv_col, turn_col, role_col, text_col)))
    place = F.struct(
        col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("by_role"),
        F.md5(F.coalesce(col(text_col).cast("string"), F.lit(" "))).alias("by_text"), made["copies"].alias("copies"),
        made["role"].alias("role"), made["text"].alias("text"),
    )
    turns = rows.select(col(conv_col).alias("conv_id"), place.alias("row"))
    long = turns.groupBy("conv_id").agg(F.sum("row.copies").alias("n")).where(F.col("n") > block)
    if long.isEmpty():
        return _short(turns)
    long = cut_lineage(long.select(F.col("conv_id").alias("__cw_long")), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("__cw_long"))
    return _short(turns.join(long, same, "left_anti")).unionByName(_long(turns.join(long, same, "left_semi"), block))


def _short(turns: DataFrame) -> DataFrame:
    listed = turns.groupBy("conv_id").agg(F.collect_list("row").alias("rows"))
    return listed.select("conv_id", _repair_lists(F.sort_array("rows")).alias("r")).select("conv_id", "r.*")


_ORDER = ["conv_id", "turn", "by_role", "by_text", "uid"]


def _crossing_table(lists: pa.ListArray) -> pa.Array:
    offsets = lists.offsets.to_pylist()
    symbols = lists.values.field("symbol").to_pylist()
    kind = pa.list_(pa.struct([("state", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
    rows = [
        [dict(zip(("state", "last", "cost", "audit"), c)) for c in crossings(symbols[a:b])] for a, b in zip(offsets[:-1], offsets[1:])
    ]
    return pa.array(rows, kind)


def _whole(lists: pa.ListArray) -> pa.Array:
    kind = pa.struct([("cost", pa.int64()), ("parts", pa.list_(pa.struct([("state", pa.string()), ("audit", pa.string())]))), ("tail", pa.string())])
    out = []
    for blocks in lists.to_pylist():
        cost, parts, tail = put_together([[tuple(c.values()) for c in b["ways"]] for b in blocks])
        out.append({"cost": cost, "parts": [{"state": s, "audit": a} for s, a in parts], "tail": tail})
    return pa.array(out, kind)


def _piece(lists: pa.ListArray, states: pa.Array, audits: pa.Array) -> pa.Array:
    out = []
    for rows, state, audit in zip(lists.to_pylist(), states.to_pylist(), audits.to_pylist()):
        lines = list(edited(state, audit, ((r["role"], r["text"]) for r in rows)))
        out.append("\n".join(lines) if lines else None)
    return pa.array(out, pa.string())


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, which come in order; the hash's state is all that is kept."""
    key, state, schema = None, None, None
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("repaired_sha256", pa.string())])
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()):
            if state is None or conv != key:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], schema[0].type), pa.array([state.hexdigest()])], schema=schema)
                key, state, first = conv, hashlib.sha256(), True
            if piece is not None:
                state.update((piece if first else "\n" + piece).encode("utf-8", "surrogatepass"))
                first = False
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], schema[0].type), pa.array([state.hexdigest()])], schema=schema)


def _long(turns: DataFrame, block: int) -> DataFrame:
    """The same columns for conversations longer than a block."""
    id_type = turns.schema["conv_id"].dataType.simpleString()
    each = turns.select("conv_id", "row.*").where("copies > 0").withColumn("__cw_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    each = each.select("*", F.md5("text").alias("text_key")).drop("copies", "__cw_copy")
    each = cut_lineage(each.withColumn("uid", F.monotonically_increasing_id()), "turns")
    spark = each.sparkSession
    # equal rows are told apart by uid, so that no range is one hot value; the order is written, so a retry cannot change it
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), each.count() // (16 * block) + 1)
    ranged = each.repartitionByRange(slices, *_ORDER).sortWithinPartitions(*_ORDER)
    ranged = ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    ranged = cut_lineage(ranged, "turns-in-order")
    starts = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("start"))
    ranged = _null_safe(ranged, starts, ["conv_id", "part"]).withColumn("blk", F.floor((F.col("at") - F.col("start")) / block).cast("long"))
    # the first of equal rows by place, which (part, at) is
    first = ranged.groupBy("conv_id", "role", "text_key").agg(F.min("at").alias("first_at"))
    marked = _null_safe(ranged, first, ["conv_id", "role", "text_key"])
    end = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    fault = F.when(end == "", "blank").when(F.col("at") != F.col("first_at"), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.upper(code)).when(F.col("fault") == "truncated", F.concat(code, F.lit("!"))).otherwise(code)
    marked = marked.withColumn("fault", fault).withColumn("symbol", symbol).withColumn("initial", initial)
    keys = ["conv_id", "part", "blk"]
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    facts = marked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("at", "symbol", "initial"))).alias("rows"), count("blank"), count("duplicate"), count("truncated")
    )
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.size("rows") - 1), F.slice(initials, F.lit(2), F.size("rows") - 1), lambda a, b: F.concat(a, b))
    facts = facts.select(
        *keys, "blank", "duplicate", "truncated", F.size(F.filter(pairs, lambda p: ~p.isin(*_LEGAL))).alias("inside"),
        initials[0].alias("first"), F.element_at(initials, -1).alias("last"), _crossings_of(F.col("rows")).alias("ways"),
    )
    facts = cut_lineage(facts, "turn-blocks")
    border = W.partitionBy("conv_id").orderBy("part", "blk")
    joint = F.concat(F.lag("last").over(border), F.col("first"))
    facts = facts.withColumn("illegal", F.col("inside") + F.when(joint.isNotNull() & ~joint.isin(*_LEGAL), 1).otherwise(0))
    per = facts.groupBy("conv_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.sort_array(F.collect_list(F.struct("part", "blk", "ways"))).alias("blocks"),
    )
    per = per.select("*", _whole_of(F.col("blocks")).alias("w"))
    per = cut_lineage(per.select(
        "conv_id", "blank", "duplicate", "truncated", "illegal", F.col("w.cost").alias("cost"),
        F.concat(F.array_join(F.transform("w.parts", lambda p: p["audit"]), ""), F.col("w.tail")).alias("audit"),
        F.col("w.tail").alias("tail"),
        F.zip_with("blocks", "w.parts", lambda b, p: F.struct(b["part"].alias("part"), b["blk"].alias("blk"), p["state"].alias("state"), p["audit"].alias("letters"))).alias("parts"),
    ), "long-audits")
    parts = per.select("conv_id", F.inline("parts"))
    texts = ranged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("rows"))
    pieces = _null_safe(texts, parts, keys).select(*keys, _pieces_of(F.col("rows"), F.col("state"), F.col("letters")).alias("piece"))
    closing = F.when(F.col("tail") == "I", "assistant:").when(F.col("tail") == "II", "user:\nassistant:")
    pieces = pieces.unionByName(per.select("conv_id", F.lit(1 << 30).alias("part"), F.lit(0).cast("long").alias("blk"), closing.alias("piece")))
    hashed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "blk").select("conv_id", "piece")
    hashed = hashed.mapInArrow(_hash_pieces, f"conv_id {id_type}, repaired_sha256 string")
    spread = each.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("distinct_turns")
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.least(F.coalesce(wide("hi") - wide("lo") + 1 - wide("distinct_turns"), F.lit(0)), F.lit((1 << 63) - 1)).cast("long")
    spread = spread.select("conv_id", gaps.alias("gaps"))
    out = _null_safe(_null_safe(per.drop("parts", "tail"), hashed, ["conv_id"]), spread, ["conv_id"])
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key equals a null key."""
    named = right.withColumnsRenamed({k: f"__cw_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__cw_{k}")) for k in keys]
    return left.join(named, on).drop(*(f"__cw_{k}" for k in keys))


def _crossings_of(rows: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return _crossing_table(column)

    return arrow_udf(run, "array<struct<state: string, last: string, cost: long, audit: string>>")(rows)


def _whole_of(blocks: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return _whole(column)

    return arrow_udf(run, "struct<cost: long, parts: array<struct<state: string, audit: string>>, tail: string>")(blocks)


def _pieces_of(rows: Column, state: Column, letters: Column) -> Column:
    def run(column: pa.Array, states: pa.Array, audits: pa.Array) -> pa.Array:
        return _piece(column, states, audits)

    return arrow_udf(run, "string")(rows, state, letters)

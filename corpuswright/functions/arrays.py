"""Row-local expressions over token-id arrays: padding, masks, labels, shifts.

Everything here is Column → Column, so a whole encode-mask-pad chain stays one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let, let_all

# Fixed value: the label that the loss ignores.
IGNORE = -100


def int_lit(v: int) -> Column:
    return F.lit(v).cast("int")


def as_col(n: int | Column) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def repeat(v: int, n: Column) -> Column:
    return F.array_repeat(int_lit(v), n.cast("int"))


def truncate(ids: Column, n: int | Column) -> Column:
    return F.slice(ids, 1, n)


def tail(ids: Column, n: int | Column) -> Column:
    """Last n elements (all of them if there are fewer)."""

    def last(s: Column) -> Column:
        keep = F.least(F.size(s["ids"]), s["n"])
        return F.slice(s["ids"], F.size(s["ids"]) - keep + 1, keep)

    return let_all({"ids": ids, "n": as_col(n)}, last)


def pad_to(ids: Column, n: int | Column, value: int, side: str = "right") -> Column:
    """Pad to n elements; longer rows are left as they are."""
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, not {side}")

    def padded(s: Column) -> Column:
        fill = repeat(value, F.greatest(s["n"] - F.size(s["ids"]), F.lit(0)))
        return F.concat(fill, s["ids"]) if side == "left" else F.concat(s["ids"], fill)

    return let_all({"ids": ids, "n": as_col(n)}, padded)


def pad_mask(ids: Column, n: int | Column, side: str = "right") -> Column:
    """Attention mask of `pad_to`: 1 on the tokens, 0 on the padding."""
    return pad_to(repeat(1, F.size(ids)), n, 0, side)


def first_index(arr: Column, value: int) -> Column:
    """0-based position of the first `value`, −1 if there is none."""
    return (F.array_position(arr, int_lit(value)) - 1).cast("int")


def first_index_not(arr: Column, value: int) -> Column:
    """0-based position of the first element other than `value`, −1 if there is none."""
    differs = F.transform(arr, lambda x: x != int_lit(value))
    return (F.array_position(differs, F.lit(True)) - 1).cast("int")


def ends_with(ids: Column, value: int) -> Column:
    return let(ids, lambda x: F.coalesce(F.get(x, F.size(x) - 1) == int_lit(value), F.lit(False)))


def starts_with(ids: Column, value: int) -> Column:
    return F.coalesce(F.get(ids, F.lit(0)) == int_lit(value), F.lit(False))


def append_eos(ids: Column, eos: int) -> Column:
    """EOS at the end unless it is there already, decided per row."""
    return let(ids, lambda x: F.when(ends_with(x, eos), x).otherwise(F.concat(x, F.array(int_lit(eos)))))


def prepend_bos(ids: Column, bos: int) -> Column:
    return let(ids, lambda x: F.when(starts_with(x, bos), x).otherwise(F.concat(F.array(int_lit(bos)), x)))


def eos_slot(ids: Column, pad: int) -> Column:
    """Where a right-padded row takes its EOS: the first pad, or the last position if it is full."""
    return let(ids, lambda x: F.coalesce(F.nullif(first_index(x, pad), F.lit(-1)), F.size(x) - 1))


def put_at(arr: Column, index: Column, value: int) -> Column:
    """`value` at a 0-based position; a position outside the array, or NULL, changes nothing."""

    def placed(s: Column) -> Column:
        rest = F.greatest(F.size(s["arr"]) - s["index"] - 1, F.lit(0))
        new = F.concat(F.slice(s["arr"], 1, s["index"]), F.array(int_lit(value)), F.slice(s["arr"], s["index"] + 2, rest))
        return F.when((s["index"] >= 0) & (s["index"] < F.size(s["arr"])), new).otherwise(s["arr"])

    return let_all({"arr": arr, "index": index}, placed)


def ignore_value(ids: Column, value: int) -> Column:
    """Labels: `value` (the pad id) → ignored."""
    return F.transform(ids, lambda x: F.when(x == int_lit(value), int_lit(IGNORE)).otherwise(x))


def ignore_span(labels: Column, start: Column, length: Column) -> Column:
    """Labels: `length` positions from `start` → ignored."""
    return let_all(
        {"labels": labels, "start": start, "end": start + length},
        lambda s: F.transform(
            s["labels"],
            lambda x, i: F.when((i >= s["start"]) & (i < s["end"]), int_lit(IGNORE)).otherwise(x),
        ),
    )


def leading_ones(size: Column, n: Column) -> Column:
    """0/1 array of `size` whose first n elements are 1."""

    def ones(s: Column) -> Column:
        k = F.least(F.greatest(s["n"], F.lit(0)), s["size"])
        return F.concat(repeat(1, k), repeat(0, s["size"] - k))

    return let_all({"size": size, "n": n}, ones)


def shift_right(labels: Column, start: int, pad: int) -> Column:
    """Decoder inputs: start id, then all labels but the last; ignored labels become pad."""
    shifted = F.concat(F.array(int_lit(start)), F.slice(labels, 1, F.size(labels) - 1))
    return F.transform(shifted, lambda x: F.when(x == int_lit(IGNORE), int_lit(pad)).otherwise(x))


def shift_right_mask(labels: Column, start: int) -> Column:
    """1 where the shifted label is a real one."""
    shifted = F.concat(F.array(int_lit(start)), F.slice(labels, 1, F.size(labels) - 1))
    return F.transform(shifted, lambda x: F.when(x == int_lit(IGNORE), int_lit(0)).otherwise(int_lit(1)))

"""Column expressions over integer cells; all exact, all inside code generation but the array folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns that tell an image, and one of its channels.
K = ["image_id"]
KC = ["image_id", "channel"]
CELL = [*KC, "row", "col"]


def clip(c: Column) -> Column:
    """c, held within 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), c))


def clip_add(value: Column, mult: Column) -> Column:
    return clip(value + mult)


def idiv(a: Column, b) -> Column:
    """Whole quotient of whole numbers that are not negative, exact whatever their size."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def nearest_code(total: Column, count: Column, book: list[int]) -> Column:
    """Place in book of the entry nearest to total / count; the lowest place on ties. Whole numbers, no division."""
    away = [F.struct(F.abs(F.lit(m).cast("long") * count - total).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(book)]
    return F.array_min(F.array(*away))["i"]


def book_value(book: list[int], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in book]), idx + 1)


def code_bits(entries: int) -> int:
    """Bits of an index into so many entries."""
    return (entries - 1).bit_length()


def halvings(size: int, times: int) -> list[int]:
    """Ascending midpoints of an axis that is halved so many times, the lower half being the smaller one."""
    spans = [(0, size)]
    out: list[int] = []
    for _ in range(times):
        out += [(lo + hi) // 2 for lo, hi in spans]
        spans = [half for lo, hi in spans for half in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    return sorted(out)


def quadrant_code(row: Column, col: Column, h: int, w: int, depth: int) -> Column:
    """Region of a cell after `depth` halvings, rows and columns in turn, rows first; bit 0 is the lower half."""
    place = lambda c, size, times: sum((F.when(c >= b, 1).otherwise(0) for b in halvings(size, times)), F.lit(0))
    rows, cols = (depth + 1) // 2, depth // 2
    r, c = place(row, h, rows), place(col, w, cols)
    code = F.lit(0)
    for k in range(depth):
        axis, left = (r, rows - 1 - k // 2) if k % 2 == 0 else (c, cols - 1 - k // 2)
        code = code * 2 + F.shiftright(axis, left).bitwiseAND(F.lit(1))
    return code.cast("int")


def quadrant_text(code: Column, depth: int) -> Column:
    return F.lpad(F.bin(code), depth, "0") if depth else F.lit("")

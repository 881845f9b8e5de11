"""Small helpers for expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space, as a regular expression class and as characters.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 64


def running(values: Column, join: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each element of an array what ``join`` makes of ``start`` and all elements before it, and at last of all.

    The array is folded in blocks and the blocks' results once more, so that a long array isn't
    copied once for each of its elements.
    """

    def fold(a: Column, first: Column) -> Column:
        return F.aggregate(a, F.array(first), lambda s, x: F.concat(s, F.array(join(F.element_at(s, -1), x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

        def placed(b: Column) -> Column:
            ends = fold(F.transform(b, lambda x: F.aggregate(x, start, join)), start)
            parts = let(ends, lambda e: F.transform(b, lambda x, i: F.slice(fold(x, F.get(e, i)), F.lit(1), F.size(x))))
            return F.concat(F.flatten(parts), F.array(F.aggregate(v, start, join)))

        return let(blocks, placed)

    return let(values, whole)


def words(text: Column) -> Column:
    """The words of a text in order; a null or blank text has none."""
    return F.array_remove(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), BLANK), "")

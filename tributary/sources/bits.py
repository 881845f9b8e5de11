"""Bit fields: a cursor over bytes for the readers, and column expressions that write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.columns import let


class Bits:
    """Fields of bits, high bit first; what goes beyond the end is an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.size, self.at = data, 8 * len(data), at

    def take(self, n: int) -> int:
        first, end = self.at, self.at + n
        if end > self.size:
            raise ValueError("short payload")
        self.at = end
        low, high = first >> 3, (end + 7) >> 3
        return int.from_bytes(self.data[low:high], "big") >> (8 * high - end) & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.take(1))

    def many(self, count: int, n: int) -> list[int]:
        return [self.take(n) for _ in range(count)]

    def uvlc(self) -> int:
        """As many zeros as bits follow the first one; 32 zeros are too many."""
        zeros = 0
        while not self.flag():
            zeros += 1
            if zeros == 32:
                raise ValueError("integer of too many bits")
        return (1 << zeros) - 1 + self.take(zeros)

    def among(self, n: int) -> int:
        """One of ``n`` values, of which the first ones take a bit less where ``n`` isn't a power of two."""
        width = (n - 1).bit_length()
        if not width:
            return 0
        short = (1 << width) - n
        value = self.take(width - 1)
        return value if value < short else 2 * value + self.take(1) - short

    def trailing(self) -> None:
        """The rest is a one and then zeros."""
        left = self.size - self.at
        if left <= 0:
            raise ValueError("short payload")
        if self.take(left) != 1 << (left - 1):
            raise ValueError("trailing bits")


# --- writing ---------------------------------------------------------------------------------------


def field(value: Column, width: int) -> Column:
    """A value as ``width`` binary digits."""
    return F.lpad(F.bin(value.cast("long")), width, "0") if width else F.lit("")


def flag(value: Column) -> Column:
    return F.when(value, "1").otherwise("0")


def field_of(value: Column, width: Column) -> Column:
    """A value as digits whose number is a column."""
    return F.when(width > 0, F.lpad(F.bin(value.cast("long")), width.cast("int"), F.lit("0"))).otherwise("")


def among(value: Column, n: Column) -> Column:
    """One of ``n`` values as :meth:`Bits.among` reads it; ``n`` is a column."""
    width = F.length(F.bin((n - 1).cast("long")))
    short = F.call_function("shiftleft", F.lit(1).cast("long"), width) - n
    return F.when(n <= 1, "").when(value < short, field_of(value, width - 1)).otherwise(field_of(value + short, width))


def uvlc(value: Column) -> Column:
    return let(F.bin(value.cast("long") + 1), lambda text: F.concat(F.repeat(F.lit("0"), F.length(text) - 1), text))


def joined(parts: Column) -> Column:
    """An array of digits as one."""
    return F.array_join(parts, "")


def packed(digits: Column, trailing: bool = False) -> Column:
    """Digits as bytes, filled up with zeros; ``trailing``: behind a one."""
    text = F.concat(digits, F.lit("1")) if trailing else digits
    whole = let(text, lambda x: F.concat(x, F.repeat(F.lit("0"), F.pmod(-F.length(x), F.lit(8)))))

    def bytes_of(x: Column) -> Column:
        nibbles = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 3, F.lit(1)), F.lit(4)), lambda i: F.conv(F.substring(x, i, F.lit(4)), 2, 16))
        return F.when(F.length(x) > 0, F.unhex(F.array_join(nibbles, ""))).otherwise(F.unhex(F.lit("")))

    return let(whole, bytes_of)

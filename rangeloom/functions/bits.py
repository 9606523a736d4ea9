"""Functions of 64-bit words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(x: Column) -> Column:
    """Ones of the 64-bit word."""
    return F.bit_count(x.cast("bigint")).cast("int")


def bit_length(x: Column) -> Column:
    """Bits needed for ``x`` as an unsigned word; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def msb(x: Column) -> Column:
    """Number of the highest one (from 0), null for 0."""
    return F.when(x != 0, F.length(F.bin(x)) - 1)


def lsb(x: Column) -> Column:
    """Number of the lowest one (from 0), null for 0."""
    return F.when(x != 0, F.length(F.bin(x)) - F.length(F.regexp_replace(F.bin(x), "0+$", "")))


def floor_log2(x: Column) -> Column:
    """Greatest ``k`` with ``2^k <= x``; null below 1."""
    return F.when(x >= 1, F.length(F.bin(x)) - 1)


def ceil_log2(x: Column) -> Column:
    """Least ``k`` with ``2^k >= x``; null below 1."""
    return F.when(x == 1, 0).when(x > 1, F.length(F.bin(x - 1)))


def ceil_div(a: Column, b: Column | int) -> Column:
    """``a / b`` rounded up, for whole ``a >= 0`` and ``b > 0``."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a + b - 1, b.cast("bigint"))


def binary_text(x: Column, width: int = 64) -> Column:
    """The word's ``width`` low bits as text, lowest first."""
    return F.reverse(F.right(F.lpad(F.bin(x), 64, "0"), F.lit(width)))


def reversed_bits(x: Column, width: int = 32) -> Column:
    """The word of the ``width`` low bits in reverse order (``width`` up to 63)."""
    return F.conv(binary_text(x, width), 2, 10).cast("bigint")


def select_in_word(x: Column, k: Column | int) -> Column:
    """Number of the (k+1)-th one of the word, null if there are fewer."""
    k = F.lit(k) if isinstance(k, int) else k
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(x, i) == 1)
    return F.get(ones, k)


def field(x: Column, at: int, size: int) -> Column:
    """``size`` (below 63) bits from bit ``at`` on, as a number."""
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << size) - 1))


def with_field(x: Column, at: int, size: int, value: Column) -> Column:
    """The word with ``size`` bits from bit ``at`` on set to ``value``."""
    mask = ((1 << size) - 1) << at
    return x.bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit((1 << size) - 1)), at))

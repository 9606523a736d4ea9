"""Lengths and texts of integer codes, and maps between signed and unsigned numbers, as column expressions.

``n`` is a non-negative whole number, at least 1 for the Elias codes. Codes are texts of 0 and 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import floor_log2


def gamma_bits(n: Column) -> Column:
    return (2 * floor_log2(n) + 1).cast("int")


def gamma_code(n: Column) -> Column:
    """The number in binary behind as many zeros as it has further bits."""
    return F.concat(F.repeat(F.lit("0"), floor_log2(n)), F.bin(n))


def delta_bits(n: Column) -> Column:
    k = floor_log2(n)
    return (gamma_bits((k + 1).cast("bigint")) + k).cast("int")


def delta_code(n: Column) -> Column:
    """The gamma code of the number of bits, then the bits below the highest."""
    k = floor_log2(n)
    return F.concat(gamma_code((k + 1).cast("bigint")), F.substring(F.bin(n), 2, 64))


def to_unsigned(v: Column) -> Column:
    """0 to 0, ``v > 0`` to ``2 v - 1``, ``v < 0`` to ``-2 v``."""
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


def to_signed(u: Column) -> Column:
    """The inverse of :func:`to_unsigned`."""
    half = F.shiftright(u + 1, 1)
    return F.when(F.pmod(u, F.lit(2)) == 1, half).otherwise(-F.shiftright(u, 1))


def rice_bits(n: Column, k: int) -> Column:
    """Unary quotient with its end, and ``k`` bits."""
    return (F.shiftright(n, k) + 1 + k).cast("bigint")


def golomb_bits(n: Column, m: int) -> Column:
    """Unary quotient by ``m`` with its end, and the rest in truncated binary."""
    b = (m - 1).bit_length()
    short = (1 << b) - m
    q = F.call_function("div", n, F.lit(m).cast("bigint"))
    return (q + 1 + F.when(F.pmod(n, F.lit(m)) < short, max(b - 1, 0)).otherwise(b)).cast("bigint")


def vbyte_len(n: Column) -> Column:
    """Bytes of seven bits each; one for 0."""
    return F.when(n == 0, 1).otherwise(F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def vbyte_code(n: Column) -> Column:
    """The bytes as hexadecimal text, lowest seven bits first, the high bit set in all but the last."""
    last = vbyte_len(n) - 1
    part = F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(F.call_function("shiftright", n, 7 * i).bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0)), 2, "0"))
    return F.array_join(part, "")


def fibonacci_bits(n: Column, top: int = 80) -> Column:
    """Length of the Fibonacci code of ``n >= 1``: the place of the greatest Fibonacci number not above it, and the end mark."""
    fib = [1, 2]
    while len(fib) < top:
        fib.append(fib[-1] + fib[-2])
    return (reduce(lambda a, f: a + F.when(n >= f, 1).otherwise(0), fib, F.lit(0)) + 1).cast("int")


def _choose(size: int) -> Column:
    """``C(n, k)`` at place ``n * (size + 1) + k``, for ``n`` below ``size``."""
    from math import comb

    return F.expr("array(" + ",".join(f"{comb(n, k)}L" for n in range(size) for k in range(size + 1)) + ")")  # one call, not one an element


def rrr_offset(x: Column, size: int = 63) -> Column:
    """The number of a word of ``size`` bits among the words with as many ones: the ones, from the lowest on, choose among those left."""
    ones = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("shiftright", x, i) % 2 == 1)
    table, k = _choose(size), F.bit_count(x)
    return F.aggregate(F.transform(ones, lambda at, i: F.get(table, (size - 1 - at) * (size + 1) + k - i)), F.lit(0).cast("bigint"), lambda a, b: a + b)


def rrr_word(ones: Column, offset: Column, size: int = 63) -> Column:
    """The word with ``ones`` ones that has the number ``offset``: the inverse of :func:`rrr_offset`."""
    table, zero = _choose(size), F.lit(0).cast("bigint")

    def step(a, j):
        c = F.get(table, (size - 1 - j) * (size + 1) + a.k.cast("int"))
        take = (a.k > 0) & (a.rest >= c)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), j)
        return F.struct(F.when(take, a.word.bitwiseOR(bit)).otherwise(a.word).alias("word"), F.when(take, a.rest - c).otherwise(a.rest).alias("rest"), F.when(take, a.k - 1).otherwise(a.k).alias("k"))

    start = F.struct(zero.alias("word"), offset.cast("bigint").alias("rest"), ones.cast("bigint").alias("k"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, step, lambda a: a.word)


def rrr_bits(x: Column, size: int = 63) -> Column:
    """Bits of a block of ``size`` bits as class (number of ones) and offset among the blocks of its class."""
    from math import comb

    offset = F.element_at(F.array(*[F.lit((comb(size, k) - 1).bit_length()) for k in range(size + 1)]), F.bit_count(x) + 1)
    return (offset + F.lit(size.bit_length())).cast("int")

"""Functions of texts and numbers as text, and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Start and prime of the 32-bit FNV hash.
FNV_START = 2166136261
FNV_PRIME = 16777619


def tokens(s: Column, delimiters: str = " \t") -> Column:
    """The non-empty parts between delimiters."""
    import re

    return F.filter(F.split(s, "[" + re.escape(delimiters) + "]"), lambda x: x != "")


def trimmed(s: Column) -> Column:
    """Without blanks, tabs and line ends around it."""
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def strict_long(s: Column) -> Column:
    """The number that the whole text is; null for anything else."""
    return F.when(s.rlike(r"^[+-]?[0-9]{1,18}\z"), s.try_cast("bigint"))


def strict_double(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), s.try_cast("double"))


def decimals(v: Column, most: int = 6) -> Column:
    """Decimals needed to print ``v`` to ``most`` places."""
    text = F.regexp_replace(F.round(v, most).cast("decimal(30,%d)" % most).cast("string"), r"0+$", "")
    return F.length(F.regexp_extract(text, r"\.(\d*)$", 1))


def number_text(v: Column, most: int = 6) -> Column:
    """``v`` with at most ``most`` decimals and no trailing zeros; ``nan`` for NaN, null for null, -0 as 0."""
    text = F.regexp_replace(F.regexp_replace(F.round(v, most).cast("decimal(30,%d)" % most).cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(F.isnan(v), "nan").otherwise(F.when(text == "-0", "0").otherwise(text))


def fnv1_32(data: Column) -> Column:
    """FNV-1 of the bytes of a text or binary, 32 bits, as a non-negative number."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data.cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))
    word = F.aggregate(bytes_, F.lit(FNV_START).cast("bigint"), lambda h, b: (h * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(b))
    return F.when(F.octet_length(data) == 0, F.lit(FNV_START).cast("bigint")).otherwise(word)


def _bytes(data: Column) -> Column:
    none = F.array().cast("array<bigint>")
    each = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data.cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))
    return F.when(F.octet_length(data) == 0, none).otherwise(each)


def fnv1a_32(data: Column) -> Column:
    """FNV-1a of the bytes of a text or binary, 32 bits, as a non-negative number."""
    return F.aggregate(_bytes(data), F.lit(FNV_START).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv1a_24(data: Column) -> Column:
    """FNV-1a folded to 24 bits: the high byte is added, without carry, to the low three."""
    h = fnv1a_32(data)
    return F.shiftright(h, 24).bitwiseXOR(h.bitwiseAND(F.lit(0xFFFFFF)))


def pearson(data: Column, table: list[int] | None = None) -> Column:
    """Pearson's hash of the bytes of a text or binary, 8 bits. ``table`` is a permutation of 0 to 255; without one, of the rule ``(167 i + 13) mod 256``."""
    places = F.array(*[F.lit(x) for x in (table or [(167 * i + 13) % 256 for i in range(256)])]).cast("array<bigint>")
    return F.aggregate(_bytes(data), F.lit(0).cast("bigint"), lambda h, b: F.get(places, h.bitwiseXOR(b).cast("int")))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows; empty if there is none or the dot comes first."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)

"""Joins that Catalyst has no strategy for: interval overlap, and the nearest row at or before (or after) a position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import join_on, shard_of

#: Width of the narrowest bins of an overlap join: about the usual length of the longer side.
BIN = 1 << 14
#: Bits between the bin widths of two levels.
STEP = 6
SHARD = 1 << 16


def _level(st: str, ed: str, width: int) -> Column:
    """The level of an interval: bins of level ``l`` have ``width * 2^(STEP * l)`` positions, and it spans two of them at most."""
    out, size = F.lit(0), width
    while size < 1 << 62:
        out = out + F.when(F.col(ed) - F.col(st) > size, 1).otherwise(0)
        size <<= STEP
    return out.cast("int")


def _levels(df: DataFrame, st: str, ed: str, width: int) -> Column:
    """The levels that occur, a handful of numbers, as a scalar subquery: nothing runs before the join does."""
    return df.where(F.col(st) < F.col(ed)).agg(F.collect_set(_level(st, ed, width))).scalar()


def _binned(df: DataFrame, st: str, ed: str, width: int, side: str, others: Column) -> DataFrame:
    """Rows by level and bin: at the row's own level (``home``), and at the coarser levels of the other side."""
    cols = [F.col(c).alias(f"_{side}_{c}") for c in df.columns]
    good = df.where(F.col(st) < F.col(ed)).select(*cols, _level(st, ed, width).alias("_own"))
    st, ed = f"_{side}_{st}", f"_{side}_{ed}"
    level = F.explode(F.array_union(F.array("_own"), others)).alias("_level")
    base = width.bit_length() - 1
    by = F.lit(base) + F.col("_level") * STEP
    at = lambda c: F.call_function("shiftright", c, by)
    names = [f"_{side}_{c}" for c in df.columns]
    leveled = good.select(*names, "_own", level).where("_level >= _own")
    return leveled.select(*names, F.col("_level").alias(f"_{side}level"), (F.col("_level") == F.col("_own")).alias(f"_{side}home"), F.explode(F.sequence(at(F.col(st)), at(F.col(ed) - 1))).alias(f"_{side}bin"))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chrom",), left_iv: tuple[str, str] = ("st", "ed"), right_iv: tuple[str, str] = ("st", "ed"),
    prefix: str = "r_", how: str = "inner", width: int = BIN,
) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose half-open intervals share a position; right columns get ``prefix``.

    Both sides are put into bins and joined on keys and bin. Bins have levels, each 64 times wider than the one below, from
    ``width`` positions on; an interval lies in one or two bins of the level of its length, and is looked up in those of the
    levels above that the other side has, so long intervals don't multiply. A pair meets at the coarser of its two levels and is
    kept in the bin of the later start only, so it comes out once. ``how`` may also be ``left_semi`` or ``left_anti`` (left rows with or
    without an overlap). Rows with null keys, null ends or empty intervals overlap nothing.
    """
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    clash = set(left.columns) & {f"{prefix}{c}" for c in right.columns if c not in keys}
    if how == "inner" and clash:
        raise ValueError(f"prefix {prefix!r} makes names that the left side has: {sorted(clash)}")
    in_l, in_r = _levels(left, *left_iv, width), _levels(right, *right_iv, width)
    a, b = _binned(left, *left_iv, width, "l", in_r), _binned(right, *right_iv, width, "r", in_l)
    ls, le, rs, re = F.col(f"_l_{left_iv[0]}"), F.col(f"_l_{left_iv[1]}"), F.col(f"_r_{right_iv[0]}"), F.col(f"_r_{right_iv[1]}")
    later = F.call_function("shiftright", F.greatest(ls, rs), F.lit(width.bit_length() - 1) + F.col("_llevel") * STEP)
    cond = (F.col("_llevel") == F.col("_rlevel")) & (F.col("_lbin") == F.col("_rbin")) & (F.col("_lhome") | F.col("_rhome")) & (ls < re) & (rs < le) & (F.col("_lbin") == later)
    for k in keys:
        cond = cond & (F.col(f"_l_{k}") == F.col(f"_r_{k}"))
    if how != "inner":
        # a left row may have an overlap in several bins
        hit = a.join(b, cond, "left_semi").select(*[F.col(f"_l_{c}").alias(f"_s_{c}") for c in left.columns]).distinct()
        same = F.lit(True)
        for c in left.columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        return left.join(hit, same, how)
    both = a.join(b, cond)
    return both.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], *[F.col(f"_r_{c}").alias(f"{prefix}{c}") for c in right.columns if c not in keys])


def asof_join(points: DataFrame, rows: DataFrame, keys: Sequence[str], pos: str, at: str, name: str = "hit", ahead: bool = False, width: int = SHARD) -> DataFrame:
    """``points`` with struct ``name``: of ``rows`` with equal ``keys`` the last with ``at <= pos`` (``ahead``: the first with ``at > pos``).

    The struct holds the row's columns beside the keys; it is null where there is no such row, and for points with a null
    key or position. ``at`` must be unique within keys. Both sides meet in shards of ``width`` positions; what lies across a shard's edge is carried by a scan
    of one summary row per key and shard.
    """
    keys = list(keys)
    held = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    own = F.struct(*[F.col(c) for c in points.columns])
    # at equal positions a row comes before a point in both directions of reading: at <= pos, and not at > pos
    a = rows.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_p"), F.lit(0).alias("_t"), held.alias("_h"), F.lit(None).cast(points.select(own.alias("x")).schema["x"].dataType).alias("_o"))
    b = points.select(*keys, F.col(pos).alias("_p"), F.lit(1).alias("_t"), F.lit(None).cast(rows.select(held.alias("x")).schema["x"].dataType).alias("_h"), own.alias("_o"))
    u = a.unionByName(b).withColumn("_s", shard_of(F.col("_p"), width))
    # read backwards for what is ahead: a frame that ends at the current row is summed up as it grows
    way = (lambda c: F.col(c).desc()) if ahead else F.col
    inner, outer = Window.partitionBy(*keys, "_s").orderBy(way("_p"), way("_t")), Window.partitionBy(*keys).orderBy(way("_s"))
    edge = u.groupBy(*keys, "_s").agg((F.min_by if ahead else F.max_by)("_h", F.when(F.col("_t") == 0, F.col("_p"))).alias("_e"))
    near = F.last("_h", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = F.last("_e", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.select(*keys, "_s", carry.alias("_c"))
    got = join_on(u.withColumn("_n", near).where("_t = 1"), edge, [*keys, "_s"])
    asked = F.col("_p").isNotNull()
    for k in keys:
        asked = asked & F.col(k).isNotNull()
    return got.select("_o.*", F.when(asked, F.coalesce("_n", "_c")).alias(name))

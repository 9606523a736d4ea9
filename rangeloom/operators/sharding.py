"""Ordered work on keys of any size: shard each key by position, carry what crosses a shard edge by a scan of summaries.

A window over a key runs in one task, so a key that holds a third of all rows holds up everything. Here each key is cut
into shards of fixed width in position; rows are ordered only within a shard, and one summary row per key and shard
(its first or last row) is scanned per key to find what lies across the edge. The number of summary rows of a key is
bounded by its extent in positions, not by its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column | int) -> Column:
    """Division of whole numbers, rounded down for negative ``a`` too (``b`` > 0)."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def shard_of(pos: Column, width: int) -> Column:
    """Number of the shard of ``width`` positions that holds ``pos``."""
    return F.shiftright(pos, width.bit_length() - 1) if width & (width - 1) == 0 else floor_div(pos, width)


def spread(df: DataFrame, lo: Column, hi: Column, name: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with a row for each whole number ``name`` from ``lo`` to ``hi``, none if ``lo > hi`` or one is null.

    In two steps, by shards of ``width`` numbers and then by number, so that no row ever holds more than ``width`` numbers (or
    shards) however far ``lo`` and ``hi`` lie apart, up to ``width`` squared.
    """
    part, cols = f"_part_{name}", df.columns
    s = df.where(lo <= hi).withColumn(part, F.explode(F.sequence(shard_of(lo, width), shard_of(hi, width))))
    first = F.col(part) * F.lit(width)
    return s.select(*[F.col(c) for c in cols if c != name], F.explode(F.sequence(F.greatest(lo, first), F.least(hi, first + F.lit(width - 1)))).alias(name))


def packed(df: DataFrame, keys: Sequence[str], *rest: str | Column) -> DataFrame:
    """``_k`` (a struct of ``keys``) and ``rest``. Structs are equal where their fields are, nulls included, so that a
    plain equality join on ``_k`` keeps keys with nulls together and can use the partitioning of a window over ``_k``."""
    return df.select(F.struct(*keys).alias("_k"), *rest)


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``a`` joined with ``b`` on equal ``keys``; ``b``'s copies of the keys are dropped."""
    renamed = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return a.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def scan(
    df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], sums: dict[str, Column] | None = None, inclusive: bool = True,
    before: tuple[str, Sequence[str]] | None = None, after: tuple[str, Sequence[str]] | None = None, highs: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` with running sums, running maxima and neighbours along ``order`` within ``keys``, in one pass and one scan of summaries.

    ``sums`` are names and values; nulls count as 0, ``inclusive=False`` leaves out the row itself. ``before`` (``after``) is
    a name for a struct of columns of the row before (after), null at the ends. ``highs`` are names and values; each gets the
    largest value of all rows before, null if there is none. ``shard`` must not decrease along ``order``; for neighbours and
    maxima ``order`` must be total. No task gets more than one shard of a key.
    """
    keys, sums, highs = list(keys), sums or {}, highs or {}
    inner = Window.partitionBy(*keys, shard).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    by = F.struct(*order)
    own = [F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(n) for n, v in sums.items()]
    edge = [F.sum(v).alias(f"_t_{n}") for n, v in sums.items()]
    outer = Window.partitionBy(*keys).orderBy(shard)
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    across = [F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    out = {n: F.col(n) + F.col(f"_c_{n}") for n in sums}
    own += [F.max(v).over(inner.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, v in highs.items()]
    edge += [F.max(v).alias(f"_t_{n}") for n, v in highs.items()]
    across += [F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in highs]
    out |= {n: F.greatest(n, f"_c_{n}") for n in highs}  # nulls don't count
    if before:
        what = F.struct(*before[1])
        own.append(F.lag(what).over(inner).alias("_near_b"))
        edge.append(F.max_by(what, by).alias("_edge_b"))
        across.append(F.lag("_edge_b").over(outer).alias("_c_b"))
        out[before[0]] = F.coalesce("_near_b", "_c_b")
    if after:
        what = F.struct(*after[1])
        own.append(F.lead(what).over(inner).alias("_near_a"))
        edge.append(F.min_by(what, by).alias("_edge_a"))
        across.append(F.lead("_edge_a").over(outer).alias("_c_a"))
        out[after[0]] = F.coalesce("_near_a", "_c_a")
    marks = df.groupBy(*keys, shard).agg(*edge).select(*keys, shard, *across)
    got = join_on(df.select("*", *own), marks, [*keys, shard]).withColumns(out)
    return got.drop(*[f"_c_{n}" for n in [*sums, *highs]], "_near_b", "_c_b", "_near_a", "_c_a")


def neighbour(
    df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], cols: Sequence[str], name: str, ahead: bool = False
) -> DataFrame:
    """Adds struct ``name`` with ``cols`` of the row before (``ahead``: after) in ``order`` within ``keys``; null at the ends. See :func:`scan`."""
    return scan(df, keys, shard, order, **{"after" if ahead else "before": (name, cols)})


def running(
    df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], sums: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Adds for each ``name: value`` of ``sums`` the running sum of the values along ``order`` within ``keys``. See :func:`scan`."""
    return scan(df, keys, shard, order, sums, inclusive)

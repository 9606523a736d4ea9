"""Irregular interval readings onto the regular grid of each source, missing cells marked or filled.

Method: readings are spread over the cells they overlap and united per cell map-side; each source's cells are cut into
time shards; a scan of the shards' last readings gives each shard the reading it starts from; every shard is then
filled by itself. A stretch without readings is cut into pieces of bounded size before its cells are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharding import floor_div, neighbour, shard_of, spread

#: Cells of a shard, and of a piece of an empty stretch.
CELLS = 1 << 12


def cells(df: DataFrame, steps: DataFrame, source: str = "track_id", series: str = "chrom", st: str = "st", ed: str = "ed", val: str = "val", step: str = "step") -> DataFrame:
    """Filled cells ``(source, series, step, cell, val)``: ``val`` is the mean of the readings weighted by their overlap.

    ``steps`` has one positive ``step`` per ``source``; sources without one, rows with null ``series``, and rows that
    aren't valued (null or NaN ``val``) or have no ``st < ed`` fill nothing.
    """
    good = df.where(F.col(series).isNotNull() & (F.col(st) < F.col(ed)) & F.col(val).isNotNull() & ~F.isnan(val))
    grid = steps.where(F.col(step) > 0).groupBy(F.col(source).alias("_src")).agg(F.min(step).alias("_w"))
    good = good.select(F.col(source).alias("_s"), F.col(series).alias("_c"), F.col(st).alias("_a"), F.col(ed).alias("_b"), F.col(val).alias("_v"))
    good = good.join(grid, F.col("_s") == F.col("_src"))
    w = F.col("_w")
    each = spread(good, floor_div(F.col("_a"), w), floor_div(F.col("_b") - 1, w), "cell", CELLS)
    over = F.least(F.col("_b"), (F.col("cell") + 1) * w) - F.greatest("_a", F.col("cell") * w)
    v = F.col("_v").cast("decimal(24,6)")
    out = each.withColumn("_o", over).groupBy("_s", "_c", "_w", "cell").agg(F.sum(v * F.col("_o").cast("decimal(12,0)")).alias("_t"), F.sum("_o").alias("_n"))
    return out.select(
        F.col("_s").alias(source), F.col("_c").alias(series), w.alias(step), "cell", (F.col("_t").cast("double") / F.col("_n")).alias(val)
    )


def _stretches(filled: DataFrame, source: str, series: str, val: str, step: str) -> DataFrame:
    """Each filled cell with the filled cell before it (``before``: cell, val; null for a series' first)."""
    sharded = filled.withColumn("_sh", shard_of(F.col("cell"), CELLS))
    return neighbour(sharded, [source, series, step], "_sh", ["cell"], ["cell", val], "before")


def _between(s: DataFrame, source: str, series: str, step: str, *keep) -> DataFrame:
    """Rows ``(source, series, step, cell, keep...)`` of the cells strictly between ``before.cell`` and ``cell``."""
    lo, hi = F.col("before.cell") + 1, F.col("cell") - 1
    gaps = s.where(F.col("before").isNotNull() & (lo <= hi)).select(source, series, step, *keep, lo.alias("_lo"), hi.alias("_hi"))
    return spread(gaps, F.col("_lo"), F.col("_hi"), "cell", CELLS).drop("_lo", "_hi")


def missing_cells(df: DataFrame, steps: DataFrame, source: str = "track_id", series: str = "chrom", st: str = "st", ed: str = "ed", val: str = "val", step: str = "step") -> DataFrame:
    """``(source, series, cell_st)``: the cells without a reading between two filled cells of the same series."""
    s = _stretches(cells(df, steps, source, series, st, ed, val, step), source, series, val, step)
    return _between(s, source, series, step).select(source, series, (F.col("cell") * F.col(step)).alias("cell_st"))


def regular_series(df: DataFrame, steps: DataFrame, source: str = "track_id", series: str = "chrom", st: str = "st", ed: str = "ed", val: str = "val", step: str = "step") -> DataFrame:
    """The whole series ``(source, series, cell_st, val, filled, age)`` from each series' first to its last filled cell.

    A cell with a reading has ``filled`` false and ``age`` 0; a missing one carries the value of the last cell before
    it that has one, ``filled`` true, ``age`` the number of cells since then. A series of one cell has one row.
    """
    s = _stretches(cells(df, steps, source, series, st, ed, val, step), source, series, val, step)
    own = s.select(source, series, step, "cell", val, F.lit(False).alias("filled"), F.lit(0).cast("bigint").alias("age"))
    gap = _between(s, source, series, step, F.col(f"before.{val}").alias(val), F.col("before.cell").alias("_from"))
    gap = gap.select(source, series, step, "cell", val, F.lit(True).alias("filled"), (F.col("cell") - F.col("_from")).alias("age"))
    return own.unionByName(gap).select(source, series, (F.col("cell") * F.col(step)).alias("cell_st"), val, "filled", "age")

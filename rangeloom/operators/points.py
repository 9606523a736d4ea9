"""Grid counts and heat maps of point multisets; dominance and rectangle counts are in :mod:`.sequence`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_count(points: DataFrame, xs: list[int], ys: list[int], x: str = "x", y: str = "y") -> DataFrame:
    """``(i, j, n)`` for every pair of sorted edges: points with ``x < xs[i]`` and ``y < ys[j]``.

    Points are counted per cell map-side; only the grid itself, of the given size, is summed up along both axes.
    """
    xs, ys = sorted(xs), sorted(ys)

    def cell(c: Column, edges: list[int]) -> Column:
        # the first edge above the value: a balanced choice, so a point takes log(edges) comparisons
        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(c < edges[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

        return pick(0, len(edges))

    n = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(cell(F.col(x), xs).alias("i"), cell(F.col(y), ys).alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    spark = points.sparkSession
    grid = spark.range(len(xs)).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(len(ys) - 1))).alias("j"), F.lit(0).cast("bigint").alias("n"))
    n = n.where((F.col("i") < len(xs)) & (F.col("j") < len(ys))).unionByName(grid).groupBy("i", "j").agg(F.sum("n").alias("n"))
    n = n.withColumn("n", F.sum("n").over(Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return n.select("i", "j", F.sum("n").over(Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"))


def heatmap(points: DataFrame, x1: int, x2: int, y1: int, y2: int, nx: int, ny: int, x: str = "x", y: str = "y") -> DataFrame:
    """``(bx, by, n)`` of ``nx`` times ``ny`` bins of ``[x1, x2) x [y1, y2)``; the first bins are one wider where the width doesn't divide."""
    for lo, hi, n in ((x1, x2, nx), (y1, y2, ny)):
        if n < 1 or hi - lo < n:
            raise ValueError("a bin would be empty")

    def bin_of(c: Column, lo: int, hi: int, n: int) -> Column:
        d, r = divmod(hi - lo, n)
        v = c.cast("bigint") - lo
        wide = r * (d + 1)
        whole = lambda a, b: ((a - F.pmod(a, F.lit(b))) / b).cast("int")
        return F.when(v < wide, whole(v, d + 1)).otherwise(whole(v - wide, d) + r)

    inside = points.where((F.col(x) >= x1) & (F.col(x) < x2) & (F.col(y) >= y1) & (F.col(y) < y2))
    n = inside.select(bin_of(F.col(x), x1, x2, nx).alias("bx"), bin_of(F.col(y), y1, y2, ny).alias("by"), F.lit(1).cast("bigint").alias("n"))
    grid = points.sparkSession.range(nx).select(F.col("id").cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("by"), F.lit(0).cast("bigint").alias("n"))
    return n.unionByName(grid).groupBy("bx", "by").agg(F.sum("n").alias("n"))

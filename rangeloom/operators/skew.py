"""Few keys that hold most rows: find them with a sketch, treat them apart from the rest, unite the results.

``heavy_keys`` runs a frequent-items sketch in each task (bounded counters, no false negatives) and then counts the few
candidates exactly. ``key_profile`` sends the heavy keys, chosen by a broadcast join with that bounded list, through
operators that split a key by position, and the remaining keys through one ordinary shuffle by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coverage import covered_periods


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        rows = lost = 0
        for batch in batches:
            col = batch.column(0)
            rows += len(col)
            for x in pc.value_counts(col.drop_null()).to_pylist() if len(col) else []:
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > k:  # take the (k+1)th largest count from all: each unit is taken from k+1 keys or more
                cut = sorted(held.values(), reverse=True)[k]
                lost += cut
                held = {x: n - cut for x, n in held.items() if n > cut}
        if rows:
            keys = [None, *held]
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(keys, pa.string()), "n": pa.array([rows, *held.values()], pa.int64()), "lost": pa.array([lost] + [0] * len(held), pa.int64())}
            )

    return run


def candidates(df: DataFrame, key: str, share: float) -> tuple[list[str], int]:
    """Keys that may hold ``share`` of all rows, as strings (at most 2/share of them; no such key is missed), and the row count.

    Each task keeps ``2/share`` counters; what it takes off any counter is at most ``share/2`` of its rows, so a heavy
    key keeps at least ``share/2`` of all rows over the tasks.
    """
    k = int(2 / share) + 1
    sums = df.select(F.col(key).cast("string").alias("key")).mapInArrow(_sketch(k), "key string, n bigint, lost bigint")
    # the row of the total comes first, then the largest keys; at most k keys can have share/2 of all rows
    top = sums.groupBy("key").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).orderBy(F.col("key").isNotNull(), F.col("n").desc()).limit(k + 2).collect()
    if not top:
        return [], 0
    rows, lost = top[0]["n"], top[0]["lost"]
    least = share * rows - lost
    return [r["key"] for r in top[1:] if r["n"] >= least - 1], rows


def heavy_keys(df: DataFrame, key: str = "chrom", share: float = 0.05) -> DataFrame:
    """``(key, n)``: non-null keys with at least ``share`` of all rows (null keys count as rows), with exact counts.

    An empty table gives no rows; ties and repeated rows count each. Two passes: sketch, then a count of the candidates.
    """
    some, rows = candidates(df, key, share)
    part = Fraction(share).limit_denominator(1_000_000)
    chosen = df.where(F.col(key).cast("string").isin(some)) if some else df.where(F.lit(False))
    n = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") * F.lit(part.denominator) >= F.lit(part.numerator * rows))


def key_profile(df: DataFrame, key: str = "chrom", st: str = "st", ed: str = "ed", val: str = "val", share: float | None = None) -> DataFrame:
    """Per non-null key: ``rows``, ``covered`` positions, ``valued`` rows, ``val_min, val_max, val_sum, val_mean, val_std``.

    ``covered`` counts positions of at least one row with ``st < ed``; rows without a valid interval count in ``rows``
    and, where ``val`` is neither null nor NaN, in the statistics. ``val_sum`` is an exact decimal sum to six places.
    Keys with ``share`` of all rows are heavy; by default those with more rows than an average shuffle partition.
    """
    spark = df.sparkSession
    share = share or min(0.05, 1 / int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = F.when(~F.isnan(val), F.col(val))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(st).alias("_a"), F.col(ed).alias("_b"), v.alias("_v"))
    heavy = spark.createDataFrame([(k,) for k in candidates(df, key, share)[0]], "_h string")
    on = F.col("_k").cast("string") == F.col("_h")
    stats = [
        F.count(F.lit(1)).alias("rows"),
        F.count("_v").alias("valued"),
        F.min("_v").alias("val_min"),
        F.max("_v").alias("val_max"),
        F.sum(F.col("_v").cast("decimal(28,6)")).alias("_s"),
        F.var_pop("_v").alias("_var"),
    ]
    # at most 2/share heavy keys, so the list may be broadcast; their sums combine map-side, their lengths by shard
    many = rows.join(F.broadcast(heavy), on, "left_semi")
    length = covered_periods(many, ["_k"], "_a", "_b").groupBy("_k").agg(F.sum(F.col("ed") - F.col("st")).alias("covered"))
    many = many.groupBy("_k").agg(*stats).join(length, "_k", "left")
    w = Window.partitionBy("_k").orderBy("_a", "_b")
    seen = F.max(F.when(F.col("_a") < F.col("_b"), F.col("_b"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("_a") < F.col("_b"), F.greatest(F.lit(0), F.col("_b") - F.greatest("_a", seen)))
    few = rows.join(F.broadcast(heavy), on, "left_anti").withColumn("_n", new).groupBy("_k").agg(*stats, F.sum("_n").alias("covered"))
    both = many.unionByName(few)
    s = F.col("_s").cast("double")
    return both.select(
        F.col("_k").alias(key), "rows", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"), "valued", "val_min", "val_max",
        s.alias("val_sum"), F.try_divide(s, F.col("valued")).alias("val_mean"), F.sqrt("_var").alias("val_std"),
    )


def heavy_profiles(df: DataFrame, key: str = "chrom", st: str = "st", ed: str = "ed", val: str = "val", of: float = 0.05) -> DataFrame:
    """The rows of :func:`key_profile` of the keys that hold at least ``of`` of all rows (rows with a null key count as rows), exactly."""
    part = Fraction(of).limit_denominator(1_000_000)
    least = F.lit(part.numerator * df.count())
    return key_profile(df, key, st, ed, val).where(F.col("rows") * F.lit(part.denominator) >= least)

"""Runs of equal or nearly equal consecutive events: one row per run with its count and duration.

Method: only boundary rows are kept, the events that differ from the one before them; a lead over these starts gives each
run's end: the difference of positions is its count, and the next start's predecessor is where it ended. Positions and
predecessors are found in shards of bounded extent, so no sequence has to be ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sharding import join_on, neighbour, packed, shard_of
from ..tables import written

#: Positions of a shard.
SHARD = 1 << 16


def collapse(
    df: DataFrame, entity: Sequence[str] = ("track_id", "chrom"), st: str = "st", ed: str = "ed", val: str = "val", tolerance: float = 0.0025, reach: int = 100, shard_width: int = SHARD
) -> DataFrame:
    """One row per run: ``(entity..., run_st, run_ed, n, length, first_val, valued)``.

    Events are ordered by ``st`` (then ``ed``) within an entity; rows equal in entity, ``st`` and ``ed`` are one event
    (of differing values the smallest counts, and any value before none). An event continues the run of the event before it if both are
    valued (neither null nor NaN), their values differ by less than ``tolerance`` and it starts at most ``reach`` past the
    end of the event before. An event without value is a run of its own, ``valued`` false. ``length`` is
    ``run_ed - run_st``. Rows with null ``st`` or ``ed`` have no place in the order and are left out; null entity values are values.
    """
    entity = list(entity)
    rows = packed(df, entity, F.col(st).cast("bigint").alias("_a"), F.col(ed).cast("bigint").alias("_b"), F.when(~F.isnan(val), F.col(val)).alias("_v")).where("_a is not null and _b is not null")
    events = rows.groupBy("_k", "_a", "_b").agg(F.min("_v").alias("_v")).withColumn("_s", shard_of(F.col("_a"), shard_width))
    events = written(events, "events")  # read for neighbours, positions and ends

    # one pass over each shard, one scan of the shards' summaries: predecessor and position
    inner = Window.partitionBy("_k", "_s").orderBy("_a", "_b")
    row = F.struct("_a", "_b", "_v")
    near = events.select("*", F.lag(row).over(inner).alias("_p"), F.row_number().over(inner).cast("bigint").alias("_i"))
    edge = events.groupBy("_k", "_s").agg(F.max_by(row, F.struct("_a", "_b")).alias("_e"), F.count(F.lit(1)).alias("_n"))
    scan = Window.partitionBy("_k").orderBy("_s")
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("_k", "_s", F.lag("_e").over(scan).alias("_pe"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = join_on(near, edge, ["_k", "_s"]).withColumns({"_p": F.coalesce("_p", "_pe"), "_i": F.col("_i") + F.col("_off")})

    goes_on = (F.abs(F.col("_v") - F.col("_p._v")) < tolerance) & (F.col("_a") <= F.col("_p._b") + reach)
    starts = placed.where(~F.coalesce(goes_on, F.lit(False))).select("_k", "_s", "_a", "_b", "_v", "_i", F.col("_p._b").alias("_pb"))
    ends = events.groupBy("_k").agg(F.max(F.struct("_a", "_b")).alias("_z"), F.count(F.lit(1)).alias("_total"))
    # behind an entity's last event: a start that only closes the run before it
    stop = ends.select("_k", F.lit(None).cast("bigint").alias("_s"), F.lit(None).cast("bigint").alias("_a"), F.lit(None).cast("bigint").alias("_b"), F.lit(None).cast("double").alias("_v"), (F.col("_total") + 1).alias("_i"), F.col("_z._b").alias("_pb"), F.col("_z._a").alias("_za"))
    stop = stop.withColumns({"_s": shard_of(F.col("_za"), shard_width)}).drop("_za")
    ordered = written(starts.unionByName(stop), "starts")  # boundary rows only
    nxt = neighbour(ordered, ["_k"], "_s", ["_i"], ["_i", "_pb"], "_next", ahead=True).where("_a is not null")
    return nxt.select(
        "_k.*", F.col("_a").alias("run_st"), F.col("_next._pb").alias("run_ed"), (F.col("_next._i") - F.col("_i")).alias("n"),
        (F.col("_next._pb") - F.col("_a")).alias("length"), F.col("_v").alias("first_val"), F.col("_v").isNotNull().alias("valued"),
    )

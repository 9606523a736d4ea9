"""Overlapping and gapped intervals per entity: covered periods, their gaps and where two or more rows overlap.

Method: positions are exact units on a line that is cut into shards. The set of covered positions of an entity in a
shard is a run bitmap, kept compressed as its boundaries (position, change of depth), never as single positions. Bitmaps
are united by adding the changes at equal boundaries, which Spark does map-side; the depth at a shard's left edge comes
from a scan of the shards' net changes, so an interval over many shards costs two boundaries, not a row per shard. Set
runs are then read off each bitmap, runs open at a shard edge are joined, and the clear runs between set runs are the gaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written
from .sharding import join_on, neighbour, packed, shard_of

#: Positions of a shard: at most so many boundaries are in one bitmap.
SHARD = 1 << 16


def run_bitmaps(df: DataFrame, entity: Sequence[str], st: str = "st", ed: str = "ed", shard_width: int = SHARD) -> DataFrame:
    """One row per entity and shard that holds a boundary: ``(_k, shard, carry, pos, step)``, ``_k`` a struct of ``entity``.

    ``pos`` (ascending) and ``step`` are the boundaries and changes of depth of the united bitmap, ``carry`` the depth
    at the shard's left edge. Rows with null ``st`` or ``ed`` or ``ed <= st`` cover nothing; null entity values are values.
    """
    valid = packed(df, entity, F.col(st).cast("bigint").alias("_a"), F.col(ed).cast("bigint").alias("_b")).where("_a < _b")
    bounds = valid.select(
        "_k", F.explode(F.array(F.struct(F.col("_a").alias("p"), F.lit(1).cast("bigint").alias("d")), F.struct(F.col("_b").alias("p"), F.lit(-1).cast("bigint").alias("d")))).alias("_e")
    )
    united = bounds.select("_k", F.col("_e.p").alias("_p"), F.col("_e.d").alias("_d")).groupBy("_k", "_p").agg(F.sum("_d").alias("_d")).where("_d <> 0")
    united = united.withColumn("shard", shard_of(F.col("_p"), shard_width))
    maps = united.groupBy("_k", "shard").agg(F.array_sort(F.collect_list(F.struct("_p", "_d"))).alias("_r"))
    scan = Window.partitionBy("_k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    net = united.groupBy("_k", "shard").agg(F.sum("_d").alias("_n"))
    net = net.select("_k", "shard", F.coalesce(F.sum("_n").over(scan), F.lit(0)).alias("carry"))
    return join_on(maps, net, ["_k", "shard"]).select(
        "_k", "shard", "carry", F.col("_r._p").alias("pos"), F.col("_r._d").alias("step")
    )


def set_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set runs of the bitmaps of each batch; ``st`` (``ed``) is null for a run open at the left (right) shard edge."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        pos_list, step_list = batch.column("pos"), batch.column("step")
        first = pos_list.offsets.to_numpy().astype(np.int64)
        pos = pos_list.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
        off2 = step_list.offsets.to_numpy()
        step = step_list.values.to_numpy(zero_copy_only=False)[off2[0] : off2[-1]]
        first = first - first[0]
        carry = batch.column("carry").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), np.diff(first))
        total = np.concatenate([[0], np.cumsum(step)])
        depth = carry[owner] + total[1:] - total[first[owner]]
        before = depth - step
        starts = np.flatnonzero((before <= 0) & (depth > 0))
        ends = np.flatnonzero((before > 0) & (depth <= 0))
        left = np.flatnonzero(carry > 0)
        right = np.flatnonzero(carry + total[first[1:]] - total[first[:-1]] > 0)
        # event numbers; an open end takes the edge of its bitmap, ordered before (after) its own events
        s_row, s_at = np.concatenate([left, owner[starts]]), np.concatenate([first[left], starts])
        s_open = np.concatenate([np.ones(len(left), bool), np.zeros(len(starts), bool)])
        order = np.lexsort((s_at, ~s_open, s_row))
        s_row, s_at, s_open = s_row[order], s_at[order], s_open[order]
        e_row, e_at = np.concatenate([owner[ends], right]), np.concatenate([ends, first[right + 1]])
        e_open = np.concatenate([np.zeros(len(ends), bool), np.ones(len(right), bool)])
        order = np.lexsort((e_at, e_open, e_row))
        e_at, e_open = e_at[order], e_open[order]
        twice = np.concatenate([[0], np.cumsum(depth >= 2)])
        multi = (twice[e_at] - twice[s_at] > 0) | (s_open & (carry[s_row] >= 2))
        last = max(len(pos) - 1, 0)
        row = pa.array(s_row)
        out = {f: batch.column(f).take(row) for f in batch.schema.names if f not in ("pos", "step", "carry")}
        out["st"] = pa.array(pos[np.minimum(s_at, last)], pa.int64(), mask=s_open)
        out["ed"] = pa.array(pos[np.minimum(e_at, last)], pa.int64(), mask=e_open)
        out["multi"] = pa.array(multi)
        yield pa.RecordBatch.from_pydict(out)


def _periods(df: DataFrame, entity: Sequence[str] = ("track_id", "chrom"), st: str = "st", ed: str = "ed", shard_width: int = SHARD) -> DataFrame:
    maps = run_bitmaps(df, entity, st, ed, shard_width)
    schema = T.StructType(
        [maps.schema[c] for c in ["_k", "shard"]]
        + [T.StructField("st", T.LongType()), T.StructField("ed", T.LongType()), T.StructField("multi", T.BooleanType())]
    )
    runs = written(maps.mapInArrow(set_runs, schema), "runs")  # read four times: whole and cut runs, each for the periods and their neighbours
    whole = runs.where("st is not null and ed is not null").select("_k", "st", "ed", "multi")
    scan = Window.partitionBy("_k").orderBy("shard", F.col("st").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = runs.where("st is null or ed is null")
    cut = cut.withColumn("_i", F.sum(F.col("st").isNotNull().cast("int")).over(scan))
    cut = cut.groupBy("_k", "_i").agg(F.min("st").alias("st"), F.max("ed").alias("ed"), F.max("multi").alias("multi"))
    return whole.unionByName(cut.select("_k", "st", "ed", "multi"))


def covered_periods(df: DataFrame, entity: Sequence[str] = ("track_id", "chrom"), st: str = "st", ed: str = "ed", shard_width: int = SHARD) -> DataFrame:
    """Continuous covered periods: ``(entity..., st, ed, multi)``, ``multi`` where two or more rows cover a position.

    Abutting intervals continue a period; repeated rows count each. Null entity values form an entity of their own.
    An empty input gives no rows. Columns of the input beside the named ones are ignored.
    """
    return _periods(df, entity, st, ed, shard_width).select("_k.*", "st", "ed", "multi")


def periods_and_gaps(df: DataFrame, entity: Sequence[str] = ("track_id", "chrom"), st: str = "st", ed: str = "ed", shard_width: int = SHARD) -> DataFrame:
    """:func:`covered_periods` and the gap after each: ``(entity..., st, ed, multi, gap_ed)``.

    The gap after a period is ``[ed, gap_ed)``; ``gap_ed`` is null after an entity's last period.
    """
    p = _periods(df, entity, st, ed, shard_width).withColumn("_s", shard_of(F.col("st"), shard_width))
    p = neighbour(p, ["_k"], "_s", ["st"], ["st"], "_next", ahead=True)
    return p.select("_k.*", "st", "ed", "multi", F.col("_next.st").alias("gap_ed"))


def found(df: DataFrame, entity: Sequence[str] = ("track_id", "chrom")) -> DataFrame:
    """Rows with a null chrom (the last of ``entity``) cover nothing. Rows ``(entity..., kind, st, ed)``: periods covered twice somewhere (``merged``) and the gaps between periods (``gap``)."""
    entity = list(entity)
    p = periods_and_gaps(df.where(F.col(entity[-1]).isNotNull()), entity)
    each = F.array(
        F.struct(F.lit("merged").alias("kind"), F.col("st"), F.when(F.col("multi"), F.col("ed")).alias("ed")),
        F.struct(F.lit("gap").alias("kind"), F.col("ed").alias("st"), F.col("gap_ed").alias("ed")),
    )
    return p.select(*entity, F.explode(each).alias("_e")).select(*entity, "_e.*").where("ed is not null")

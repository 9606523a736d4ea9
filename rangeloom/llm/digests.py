"""Percentiles of very large columns by merging centroid digests, with certified rank errors.

A digest holds centroids (mean, count, min, max) of sorted values, clustered under the size function
``k(q) = delta / (2 pi) * asin(2 q - 1)``: values whose quantiles have the same whole part of ``k`` share a centroid, so
centroids are small near the ends. Digests are merged by clustering their centroids again. Each task makes digests of its
own rows first; digests of a key meet in two steps (first apart by salt), so a key of any size loads no single task.
The stored mins and maxs bound every rank for certain; a second pass over the rows counts the rank of an estimate exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sharding import join_on
from ..tables import written

DELTA = 200
#: Keys whose rows, one a key and some hundred bytes each, may be broadcast.
KNOWN = 1 << 16
SALTS = 16
#: Rounds of narrowing the bounds by digests.
ROUNDS = 4
#: Values or centroids that a task gathers before it clusters them.
GATHER = 400_000


class Centroids:
    """Centroids of several groups: ``g`` is the group number of each, ascending; within a group means ascend."""

    def __init__(self, g, mean, count, low, high):
        self.g, self.mean, self.count, self.low, self.high = g, mean, count, low, high

    @staticmethod
    def of_values(g: np.ndarray, v: np.ndarray) -> Centroids:
        return Centroids(g, v, np.ones(len(v), np.int64), v, v)

    def clustered(self, delta: int) -> Centroids:
        if not len(self.g):
            return self
        order = np.lexsort((self.high, self.low, self.mean, self.g))
        g, mean, count, low, high = (x[order] for x in (self.g, self.mean, self.count, self.low, self.high))
        # equal values are one exact centroid
        same = (g[1:] == g[:-1]) & (mean[1:] == mean[:-1]) & (low[1:] == high[1:]) & (low[:-1] == high[:-1])
        at = np.flatnonzero(np.append(True, ~same))
        g, mean, low, high, count = g[at], mean[at], low[at], high[at], np.add.reduceat(count, at)
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        total = np.add.reduceat(count, first)
        size = np.diff(np.append(first, len(g)))
        upto = np.cumsum(count)
        begun = np.repeat(upto[first] - count[first], size)
        q = (upto - begun - count / 2) / np.repeat(total, size)
        k = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1)) + delta / 4)
        at = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
        n = np.add.reduceat(count, at)
        lo, hi = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        m = mean[at] + np.add.reduceat((mean - np.repeat(mean[at], np.diff(np.append(at, len(g))))) * count, at) / n
        return Centroids(g[at], np.clip(np.where(lo == hi, lo, m), lo, hi), n, lo, hi)

    def packed(self, groups: int) -> list[bytes]:
        """A digest per group: number of centroids, counts, means, then min and max of those that aren't one value."""
        cut = np.searchsorted(self.g, np.arange(groups + 1))
        out = []
        flat = self.low == self.high
        for a, b in zip(cut[:-1], cut[1:]):
            wide = ~flat[a:b]
            kind = np.uint16 if self.count[a:b].max(initial=0) < 1 << 16 else np.int64
            out.append(
                np.array([b - a, np.dtype(kind).itemsize], np.int32).tobytes() + self.mean[a:b].tobytes() + self.count[a:b].astype(kind).tobytes()
                + np.packbits(wide).tobytes() + self.low[a:b][wide].tobytes() + self.high[a:b][wide].tobytes()
            )
        return out


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, count, low, high)`` of a digest."""
    n, width = np.frombuffer(blob, np.int32, 2).tolist()
    mean = np.frombuffer(blob, np.float64, n, 8)
    count = np.frombuffer(blob, np.uint16 if width == 2 else np.int64, n, 8 + 8 * n).astype(np.int64)
    at = 8 + (8 + width) * n
    wide = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    ends = np.frombuffer(blob[at + (n + 7) // 8 :], np.float64)
    low, high = mean.copy(), mean.copy()
    low[wide], high[wide] = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    return mean, count, low, high


def _codes(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's keys, and the first row of each number."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        col = batch.column(k).dictionary_encode("encode")
        code = code * (len(col.dictionary) + 1) + col.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def _tables(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += size(b)
        if n >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _make(keys: Sequence[str], delta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _tables(batches, lambda b: b.num_rows):
            g, first = _codes(batch, keys)
            c = Centroids.of_values(g, batch.column("_v").to_numpy(zero_copy_only=False)).clustered(delta)
            row = pa.array(first)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), pa.array(c.packed(len(first)), pa.binary())], [*keys, "digest"])

    return run


def _merge(keys: Sequence[str], delta: int):
    """Of rows sorted by ``keys``: one digest per key."""

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, first = _codes(batch, keys)
        parts = [unpack(x) for x in batch.column("digest").to_pylist()]
        size = [len(p[0]) for p in parts]
        c = Centroids(np.repeat(g, size), *(np.concatenate([p[i] for p in parts]) for i in range(4)))
        c = c.clustered(delta) if len(first) < batch.num_rows else Centroids(*(x[np.argsort(c.g, kind="stable")] for x in (c.g, c.mean, c.count, c.low, c.high)))
        row = pa.array(first)
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), pa.array(c.packed(len(first)), pa.binary())], schema=batch.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # of the last key, which may go on
        for batch in _tables(batches, lambda b: b.column("digest").nbytes // 16):
            batch = batch.select([*keys, "digest"])  # the schema that `rest` has
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            last = np.ones(batch.num_rows, bool)
            for k in keys:
                col = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                last &= col == col[-1]
            if not last.all():
                yield merged(batch.filter(pa.array(~last)))
            rest = merged(batch.filter(pa.array(last)))
        if rest is not None:
            yield rest

    return run


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), T.StructField("digest", T.BinaryType())])


def merge(digests: DataFrame, keys: Sequence[str], delta: int = DELTA) -> DataFrame:
    """``(keys..., digest)``: the digests of each key merged into one, whatever partitions, days or finer keys they are from."""
    keys = list(keys)
    part = digests.select(*keys, "digest", F.pmod(F.hash("digest"), F.lit(SALTS)).alias("_salt"))
    some = part.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt").mapInArrow(_merge([*keys, "_salt"], delta), _schema(part, [*keys, "_salt"]))
    return some.select(*keys, "digest").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys, delta), _schema(digests, keys))


def _valued(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*keys, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))


def digest(df: DataFrame, keys: Sequence[str], value: str = "val", delta: int = DELTA) -> DataFrame:
    """``(keys..., digest)`` over the valued rows (neither null nor NaN) of each key; null keys are keys, keys without a valued row have none."""
    keys = list(keys)
    rows = _valued(df, keys, value)
    return merge(rows.mapInArrow(_make(keys, delta), _schema(rows, keys)), keys, delta)


def _names(qs: Sequence[int]) -> list[str]:
    return ["n"] + [f"{a}{q}" for q in qs for a in ("lo", "p", "hi")]


def _read(keys: Sequence[str], qs: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 1 + 3 * len(qs)))
            for i, blob in enumerate(batch.column("digest").to_pylist()):
                mean, count, low, high = unpack(blob)
                upto = np.cumsum(count)
                n = int(upto[-1])
                out[i, 0] = n
                exact = bool((low == high).all())
                if not exact:
                    a, b = np.argsort(low), np.argsort(high)
                    low_n, high_n = np.cumsum(count[a]), np.cumsum(count[b])
                for j, q in enumerate(qs):
                    r = max(1, -(-n * q // 100))
                    at = int(np.searchsorted(upto, r))
                    p = mean[at]
                    lo = hi = p
                    if not exact:
                        lo, hi = low[a][np.searchsorted(low_n, r)], high[b][np.searchsorted(high_n, r)]
                        p = min(max(np.interp(r - 0.5, upto - count / 2, mean), lo), hi)
                    out[i, 1 + 3 * j : 4 + 3 * j] = lo, p, hi
            cols = [pa.array(out[:, 0].astype(np.int64))] + [pa.array(out[:, c]) for c in range(1, out.shape[1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], [*keys, *_names(qs)])

    return run


def percentiles(digests: DataFrame, keys: Sequence[str], qs: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """``(keys..., n, loX, pX, hiX ...)``: the estimate of each percentile and bounds that hold for certain.

    The true pX, the smallest value with at least X % of the rows at or below it, lies in ``[loX, hiX]``: no digest of
    the bounds' ranks allows another one.
    """
    keys = list(keys)
    schema = T.StructType([*(digests.schema[k] for k in keys), T.StructField("n", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in _names(qs)[1:])])
    return digests.mapInArrow(_read(keys, qs), schema)


def _at_keys(rows: DataFrame, per_key: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``per_key``, a stored table of one row per ``_k``; rows of other keys are dropped.

    Up to ``KNOWN`` keys are broadcast, their number is counted before, so no row is shuffled. More are joined with a salt, each
    key's row being there once per salt, so that no key's rows meet in one task.
    """
    if per_key.count() <= KNOWN:
        return join_on(rows, F.broadcast(per_key), ["_k"], "inner")
    salted = per_key.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(rows.withColumn("_z", F.pmod(F.hash("_v"), F.lit(SALTS))), salted, ["_k", "_z"], "inner").drop("_z")


def certified(df: DataFrame, keys: Sequence[str], value: str = "val", qs: Sequence[int] = (50, 90, 95, 99), delta: int = DELTA) -> DataFrame:
    """``(keys..., n, pX..., errX...)``: estimates, and from a second pass over the rows the exact rank error of each.

    ``errX`` is the distance of the wanted rank from the ranks the estimate has, as a share of ``n``; 0 if pX is exact. It is at most
    ``pi / delta``: keys with a larger one, by ties or by the merging of centroids, are narrowed until their percentiles are exact. Rows
    are counted map-side, the estimates come to them.
    """
    keys = list(keys)
    p = [f"p{q}" for q in qs]
    est = written(percentiles(digest(df, keys, value, delta), keys, qs).select(F.struct(*keys).alias("_k"), *_names(qs)), "percentiles")
    values = _valued(df, keys, value).select(F.struct(*keys).alias("_k"), "_v")
    both = _at_keys(values, est.select("_k", "n", *p))
    sums = [x for q in qs for x in (F.count(F.when(F.col("_v") < F.col(f"p{q}"), 1)).alias(f"lt{q}"), F.count(F.when(F.col("_v") <= F.col(f"p{q}"), 1)).alias(f"le{q}"))]
    out = both.groupBy("_k", "n", *p).agg(*sums)

    def error(q: int) -> Column:
        r = F.ceil(F.col("n") * q / 100)
        return (F.greatest(F.lit(0), r - F.greatest(F.col(f"le{q}"), F.lit(0)), F.col(f"lt{q}") + 1 - r) / F.col("n")).alias(f"err{q}")

    out = written(out.select("_k", "n", *p, *[error(q) for q in qs]), "errors")
    near = F.greatest(*[F.col(f"err{q}") for q in qs], F.lit(0.0)) <= math.pi / delta
    same = F.lit(True)
    for q in qs:
        same = same & (F.col(f"lo{q}") == F.col(f"hi{q}"))
    done = [out.where(near)]
    left = written(join_on(out.where(~near).select("_k"), est.drop(*p), ["_k"], "inner"), "bounds")
    rounds = 0
    while not left.isEmpty():
        rounds += 1
        b = written(_nearer(values, left, keys, qs, delta, rounds > ROUNDS), "bounds")
        done.append(b.where(same).select("_k", "n", *[F.col(f"lo{q}").alias(f"p{q}") for q in qs], *[F.lit(0.0).alias(f"err{q}") for q in qs]))
        left = b.where(~same)
    return reduce(DataFrame.unionByName, done).select("_k.*", "n", *p, *[f"err{q}" for q in qs])


def bounded(df: DataFrame, keys: Sequence[str], value: str = "val", qs: Sequence[int] = (50, 90, 95, 99), delta: int = DELTA) -> DataFrame:
    """``(keys..., n, within)``: the valued rows of each key and whether every percentile's rank error is at most ``pi / delta``."""
    out = certified(df, keys, value, qs, delta)
    return out.select(*keys, "n", (F.greatest(*[F.col(f"err{q}") for q in qs], F.lit(0.0)) <= math.pi / delta).alias("within"))


def skewed(df: DataFrame, keys: Sequence[str] = ("track_id", "chrom"), value: str = "val", least: int = 30, factor: float = 6.0, delta: int = DELTA) -> DataFrame:
    """``(keys...)`` of the keys with ``least`` valued rows or more, ``p50 > 0`` and ``p95 >= factor * p50``, exactly.

    The digests' certain bounds decide nearly all keys. For the others the rows between the bounds are counted and digested
    again, which narrows the bounds about ``delta``-fold a round; after ``ROUNDS`` rounds the few distinct values left
    between the bounds are counted one by one.
    """
    keys = list(keys)
    b = written(percentiles(digest(df, keys, value, delta), keys, (50, 95)).where(F.col("n") >= least).drop("p50", "p95"), "bounds")
    yes = (F.col("lo50") > 0) & (F.col("lo95") >= factor * F.col("hi50"))
    no = (F.col("hi50") <= 0) | ((F.col("lo50") > 0) & (F.col("hi95") < factor * F.col("lo50"))) | ((F.col("lo50") == F.col("hi50")) & (F.col("lo95") == F.col("hi95")))
    done = [b.where(yes).select(*keys)]
    open_ = b.where(~yes & ~no)
    values = _valued(df, keys, value).select(F.struct(*keys).alias("_k"), "_v")
    rounds = 0
    while not open_.isEmpty():
        rounds += 1
        left = open_.select(F.struct(*keys).alias("_k"), "n", "lo50", "hi50", "lo95", "hi95")
        b = written(_nearer(values, left, keys, (50, 95), delta, rounds > ROUNDS).select("_k.*", "n", "lo50", "hi50", "lo95", "hi95"), "bounds")
        done.append(b.where(yes).select(*keys))
        open_ = b.where(~yes & ~no)
    return reduce(DataFrame.unionByName, done)


def _nearer(values: DataFrame, left: DataFrame, keys: Sequence[str], qs: Sequence[int], delta: int, exactly: bool) -> DataFrame:
    """``(_k, n, loX, hiX ...)`` of the keys of ``left``, a stored table with these columns, by a pass over ``(_k, _v)``: bounds
    from a digest of the values between the bounds, or, ``exactly``, each distinct one counted."""
    rows = _at_keys(values, left)
    each = rows.select("_k", "n", "_v", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"lo{q}").alias("lo"), F.col(f"hi{q}").alias("hi")) for q in qs])).alias("_b"))
    each = each.select("_k", F.col("_b.q").alias("_q"), "n", F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"), "_v").where("_v <= _hi")
    below = each.groupBy("_k", "_q", "n").agg(F.sum(F.when(F.col("_v") < F.col("_lo"), 1).otherwise(0)).cast("bigint").alias("_below"))
    inner = each.where("_v >= _lo").select("_k.*", "_q", "_v")
    if exactly:
        near = _ranked(below, inner, keys)
    else:
        again = merge(inner.mapInArrow(_make([*keys, "_q"], delta), _schema(inner, [*keys, "_q"])), [*keys, "_q"], delta)
        again = again.select(F.struct(*keys).alias("_k"), "_q", "digest")
        near = join_on(below, again, ["_k", "_q"], "inner").mapInArrow(_narrowed, T.StructType([below.schema["_k"], below.schema["_q"], below.schema["n"], T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
    return near.groupBy("_k", "n").agg(*[F.max(F.when(F.col("_q") == q, F.col(c))).alias(f"{c}{q}") for q in qs for c in ("lo", "hi")])


def _ranked(below: DataFrame, inner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The exact percentile of each key from the counts of its distinct values between the bounds."""
    w = Window.partitionBy("_k", "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = inner.groupBy(F.struct(*keys).alias("_k"), "_q", "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(w))
    both = join_on(n, below, ["_k", "_q"], "inner")
    v = F.min(F.when(F.col("_below") + F.col("_upto") >= F.ceil(F.col("n") * F.col("_q") / 100), F.col("_v")))
    return both.groupBy("_k", "_q", "n").agg(v.alias("lo"), v.alias("hi"))


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds = np.zeros((batch.num_rows, 2))
        for i, (n, q, below, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "_q", "_below", "digest")))):
            _, count, low, high = unpack(blob)
            r = max(1, -(-n * q // 100)) - below
            a, b = np.argsort(low), np.argsort(high)
            bounds[i] = low[a][np.searchsorted(np.cumsum(count[a]), r)], high[b][np.searchsorted(np.cumsum(count[b]), r)]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_q"), batch.column("n"), pa.array(bounds[:, 0]), pa.array(bounds[:, 1])], ["_k", "_q", "n", "lo", "hi"])

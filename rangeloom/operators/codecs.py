"""Encodings of integer arrays ``(pos, v)`` that need more than one value at a time, and their decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import to_signed, to_unsigned
from ..tables import written
from .joins import asof_join
from .sharding import join_on, neighbour, running, shard_of

BLOCK = 64
SHARD = 1 << 14


def diff_encode(array: DataFrame, every: int = BLOCK) -> DataFrame:
    """``(pos, code)``: each ``every``-th value as it is, others as the unsigned map of the difference to the one before."""
    w = Window.partitionBy("_b").orderBy("pos")
    s = array.withColumn("_b", shard_of(F.col("pos"), every))
    return s.select("pos", F.when(F.pmod("pos", F.lit(every)) == 0, F.col("v")).otherwise(to_unsigned(F.col("v") - F.lag("v").over(w))).alias("code"))


def diff_decode(codes: DataFrame, every: int = BLOCK) -> DataFrame:
    """The inverse of :func:`diff_encode`: ``(pos, v)``."""
    w = Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.pmod("pos", F.lit(every)) == 0, F.col("code")).otherwise(to_signed(F.col("code")))
    return codes.withColumn("_b", shard_of(F.col("pos"), every)).select("pos", F.sum(step).over(w).alias("v"))


def differences(array: DataFrame) -> DataFrame:
    """``(pos, diff, neg)``: the difference to the value before (the value itself at the start), and the negated value."""
    s = neighbour(array.withColumn("_s", shard_of(F.col("pos"), SHARD)), [], "_s", ["pos"], ["v"], "_p")
    return s.select("pos", (F.col("v") - F.coalesce("_p.v", F.lit(0))).alias("diff"), (-F.col("v")).alias("neg"))


def histogram(array: DataFrame, value: str = "v") -> DataFrame:
    """``(v, n)``."""
    return array.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def top_symbols(array: DataFrame, k: int = 127, least: int = 8) -> DataFrame:
    """``(v, n)`` of the ``k`` most frequent values; of equally frequent ones the larger first; beyond ``least`` only those that occur twice or more."""
    top = histogram(array).orderBy(F.col("n").desc(), F.col("v").desc()).limit(k)
    i = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("v").desc()))  # over k rows
    return top.withColumn("_i", i).where((F.col("n") > 1) | (F.col("_i") <= least)).drop("_i")


def remap(array: DataFrame, k: int = 127) -> DataFrame:
    """``(pos, v, code)``: the most frequent values swap places with the small numbers 0 to k-1, so ``code`` is small where ``v`` is frequent."""
    top = top_symbols(array, k)
    i = (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("v").desc())) - 1).cast("bigint")
    swap = top.select("v", i.alias("code"))
    # a small number that isn't frequent itself goes where a frequent value leaves a free place
    free = swap.select(F.col("v").alias("x")).join(swap.select(F.col("code").alias("x")), "x", "left_anti").withColumn("_i", F.row_number().over(Window.orderBy("x")))
    lost = swap.select(F.col("code").alias("x")).join(swap.select(F.col("v").alias("x")), "x", "left_anti").withColumn("_i", F.row_number().over(Window.orderBy("x")))
    moved = lost.select(F.col("x").alias("v"), "_i").join(free.select(F.col("x").alias("code"), "_i"), "_i").select("v", "code")
    both = swap.unionByName(moved)  # at most 2 k rows
    return join_on(array, F.broadcast(both), ["v"]).select("pos", "v", F.coalesce("code", F.col("v")).alias("code"))


def unmap(remapped: DataFrame, array: DataFrame, k: int = 127) -> DataFrame:
    """The values of :func:`remap`'s codes: ``(pos, v)``."""
    table = remap(array, k)
    back = table.where("code <> v").select("code", F.col("v").alias("_v")).distinct()
    return join_on(remapped.select("pos", "code"), back, ["code"]).select("pos", F.coalesce("_v", F.col("code")).alias("v"))


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of a Huffman code; one symbol gets one bit."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    length = dict.fromkeys(counts, 0)
    if len(heap) == 1:
        return dict.fromkeys(counts, 1)
    i = len(heap)
    while len(heap) > 1:
        a, _, x = heapq.heappop(heap)
        b, _, y = heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
        i += 1
    return length


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    """Codes of the given lengths, as texts of 0 and 1: ascending by length, then symbol."""
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s] = format(code, f"0{n}b") if n else ""
        code, last = code + 1, n
    return out


def huffman_groups(times: dict[int, int]) -> dict[int, dict[int, int]]:
    """Code lengths of a Huffman code from ``{count: number of values with it}``: ``{count: {length: number of values}}``.

    Nodes of equal weight are paired all at once, so the work follows the number of different counts, of which there are at most
    ``sqrt(2 n)`` among ``n`` rows, not the number of values.
    """
    if sum(times.values()) == 1:
        return {c: {1: 1} for c in times}
    parts: list[list[tuple[int, int]]] = []  # of each group of nodes: (group, nodes it takes of it per node)
    heap = []
    for c, n in sorted(times.items()):
        parts.append([])
        heap.append((c, len(parts) - 1, n))
    leaves = [c for c, _ in sorted(times.items())]
    heapq.heapify(heap)
    while True:
        w, g, n = heapq.heappop(heap)
        if n > 1:
            if n % 2:
                heapq.heappush(heap, (w, g, 1))
            parts.append([(g, 2)])
            heapq.heappush(heap, (2 * w, len(parts) - 1, n // 2))
        elif heap:
            x, h, m = heapq.heappop(heap)
            if m > 1:
                heapq.heappush(heap, (x, h, m - 1))
            parts.append([(g, 1), (h, 1)])
            heapq.heappush(heap, (w + x, len(parts) - 1, 1))
        else:
            break
    depth: list[dict[int, int]] = [{} for _ in parts]
    depth[-1] = {0: 1}
    for g in range(len(parts) - 1, -1, -1):
        for child, k in parts[g]:
            for d, n in depth[g].items():
                depth[child][d + 1] = depth[child].get(d + 1, 0) + k * n
    return {c: depth[i] for i, c in enumerate(leaves)}


def huffman_table(array: DataFrame) -> DataFrame:
    """``(v, n, bits, code)``: a canonical Huffman code of the values, of any number of them.

    Values and the numbers of values of each count are counted in Spark; the driver sees the different counts only (at most
    ``sqrt(2 n)`` of ``n`` rows) and says how many values of each get which length. Of values of one count the smaller get
    the shorter codes; codes ascend by length, then value.
    """
    values = written(histogram(array).where("v is not null"), "values")
    times = {r["n"]: r["k"] for r in values.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    spark = array.sparkSession
    groups = huffman_groups(times) if times else {}
    # within a count the values up to each bound have a length
    bounds, total = [], {}
    for n, lengths in groups.items():
        upto = 0
        for bits, k in sorted(lengths.items()):
            bounds.append((n, upto, bits))
            upto += k
            total[bits] = total.get(bits, 0) + k
    first, code, last = [], 0, 0
    for bits in sorted(total):
        code <<= bits - last
        first.append((bits, str(code)))
        code, last = code + total[bits], bits
    by_value = values.withColumn("_s", shard_of(F.col("v"), SHARD))
    ranked = running(by_value, ["n"], "_s", ["v"], {"_r": F.lit(1).cast("bigint")}, inclusive=False)
    steps = spark.createDataFrame(bounds, "n bigint, at bigint, bits int")
    ranked = asof_join(ranked.select("v", "n", "_s", "_r"), steps, ["n"], "_r", "at", "_h", width=1 << 20).select("v", "n", "_s", F.col("_h.bits").alias("bits"))
    placed = running(ranked, ["bits"], "_s", ["v"], {"_i": F.lit(1).cast("bigint")}, inclusive=False)
    starts = spark.createDataFrame(first, "bits int, first string")  # a row per length
    got = join_on(placed, F.broadcast(starts), ["bits"], "inner")
    whole = F.col("first").cast("decimal(38,0)") + F.col("_i").cast("decimal(38,0)")
    high, low = F.floor(whole / F.lit(1 << 40)).cast("bigint"), F.pmod(whole, F.lit(1 << 40).cast("decimal(38,0)")).cast("bigint")
    text = F.concat(F.bin(high), F.lpad(F.bin(low), 40, "0"))
    return got.select("v", "n", "bits", F.right(F.lpad(text, 128, "0"), F.col("bits")).alias("code"))


def huffman_encode(array: DataFrame, codes: DataFrame, often: int = 1 << 16) -> DataFrame:
    """``(pos, code)``. Values that make up more than one row in ``often`` (fewer than ``often`` of them) get their codes by broadcast, the others by a shuffle."""
    total = codes.agg(F.sum("n").alias("n")).head()["n"] or 0
    hot = F.col("n") * often > total
    known = F.broadcast(codes.where(hot).select("v", F.col("code").alias("_hot")))
    first = join_on(array.where("v is not null"), known, ["v"])
    rest = join_on(first.where("_hot is null").drop("_hot"), codes.where(~hot).select("v", "code"), ["v"], "inner")
    return first.where("_hot is not null").select("pos", F.col("_hot").alias("code")).unionByName(rest.select("pos", "code"))


def sizes(array: DataFrame) -> DataFrame:
    """One row ``(length, distinct, entropy_bits, huffman_bits)``: bits an ideal (arithmetic) coder and a Huffman code need for all values."""
    h = histogram(array)
    n = F.sum("n")
    e = h.agg(n.alias("length"), F.count(F.lit(1)).alias("distinct"), (n * F.log2(n) - F.sum(F.col("n") * F.log2("n"))).alias("entropy_bits"))
    t = huffman_table(array).agg(F.sum(F.col("n") * F.col("bits")).alias("huffman_bits"))
    return e.withColumn("_k", F.lit(1)).join(t.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows sorted by block and position: number, positions, values."""
    held, number = [], None
    for b in batches:
        k, p, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_b", "pos", "v"))
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1):
            if len(part):
                if held and k[part[0]] != number:
                    yield number, *(np.concatenate(x) for x in zip(*held))
                    held = []
                number = int(k[part[0]])
                held.append((p[part], v[part]))
    if held:
        yield number, *(np.concatenate(x) for x in zip(*held))


def _per_block(array: DataFrame, size: int, f, schema: str) -> DataFrame:
    s = array.select("pos", F.col("v").cast("bigint").alias("v")).withColumn("_b", shard_of(F.col("pos"), size))
    return s.repartition("_b").sortWithinPartitions("_b", "pos").mapInArrow(f, schema)


def move_to_front(array: DataFrame, size: int = 1 << 12) -> DataFrame:
    """``(pos, code)`` by move-to-front, starting anew every ``size`` positions: the place of the value among those seen, or the number seen plus the value's zig-zag code if it is new.

    A new value has ``code = seen + to_unsigned(v)``; the list holds the values seen in the block, the latest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pos, v in _blocks(batches):
            seen: list[int] = []
            out = []
            for x in v.tolist():
                if x in seen:
                    i = seen.index(x)
                    out.append(i)
                    del seen[i]
                else:
                    out.append(len(seen) + (2 * x - 1 if x > 0 else -2 * x))
                seen.insert(0, x)
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(out, pa.int64())], ["pos", "code"])

    return _per_block(array, size, run, "pos bigint, code bigint")


def front_to_values(codes: DataFrame, size: int = 1 << 12) -> DataFrame:
    """The inverse of :func:`move_to_front`: ``(pos, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pos, c in _blocks(batches):
            seen: list[int] = []
            out = []
            for x in c.tolist():
                if x < len(seen):
                    v = seen.pop(x)
                else:
                    u = x - len(seen)
                    v = (u + 1) // 2 if u % 2 else -(u // 2)
                out.append(v)
                seen.insert(0, v)
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(out, pa.int64())], ["pos", "v"])

    return _per_block(codes.select("pos", F.col("code").alias("v")), size, run, "pos bigint, v bigint")


def adaptive_golomb_bits(array: DataFrame, size: int = 1 << 12) -> DataFrame:
    """``(block, n, bits)``: bits of a Golomb code whose parameter follows the mean of the values before, anew for each block of ``size``. Values aren't negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, v in _blocks(batches):
            before = np.concatenate([[0], np.cumsum(v)[:-1]])
            mean = (before + 1) / np.arange(1, len(v) + 1)
            m = np.maximum(1, np.ceil(mean * np.log(2))).astype(np.int64)
            b = np.ceil(np.log2(m)).astype(np.int64)
            short = (1 << b) - m
            bits = v // m + 1 + np.where(v % m < short, np.maximum(b - 1, 0), b)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(v)], pa.int64()), pa.array([int(bits.sum())], pa.int64())], ["block", "n", "bits"])

    return _per_block(array, size, run, "block bigint, n bigint, bits bigint")


def adaptive_bits(array: DataFrame, size: int = 1 << 12) -> DataFrame:
    """``(block, n, bits)``: bits of an adaptive arithmetic coder (each value by its frequency so far, plus one), anew for each block of ``size``; the alphabet is the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, v in _blocks(batches):
            k = len(np.unique(v))
            order = np.argsort(v, kind="stable")
            s = v[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            seen = np.empty(len(v), np.int64)
            seen[order] = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
            bits = -np.log2((seen + 1) / (np.arange(len(v)) + k)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(v)], pa.int64()), pa.array([round(float(bits), 6)])], ["block", "n", "bits"])

    return _per_block(array, size, run, "block bigint, n bigint, bits double")


def compressed_sizes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Each text's bytes, and its bytes after a general compressor (zlib): ``(raw_bytes, zlib_bytes)`` beside its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text_ = b.column(b.num_columns - 1).to_pylist()
            size = pa.array([None if x is None else len(zlib.compress(x.encode())) for x in text_], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size], [*b.schema.names[:-1], "zlib_bytes"])

    rows = texts.select("*", F.octet_length(text).cast("bigint").alias("raw_bytes"), F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("zlib_bytes", T.LongType())])
    return rows.mapInArrow(run, schema)

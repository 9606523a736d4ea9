"""Ordered sequences ``(pos, c)`` and bit arrays ``(pos, bit)``: rank, select, prefix sums, range counts and range minima.

Positions of a sequence are 0, 1, 2, ...; global running values are taken over shards of positions, so that no task
gets the whole sequence. Counts over a value range and a position range use dyadic value ranges (the layers of a wavelet
tree as rows): each value lies in one range per bit, each bound splits into at most one range per bit, and both meet by an
equi-join. Range minima use dyadic position ranges in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import rrr_offset, rrr_word
from ..tables import written
from .joins import asof_join
from .sharding import floor_div, join_on, neighbour, running, shard_of

SHARD = 1 << 14


def numbered(df: DataFrame, order: Sequence[str], shard_by: str, name: str = "pos", width: int = SHARD) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... along ``order``, whose first column ``shard_by`` is a whole number.

    Rows equal in ``order`` get consecutive numbers in any order. Nulls in ``shard_by`` come first.
    """
    s = df.withColumn("_s", F.coalesce(shard_of(F.col(shard_by).cast("bigint"), width), F.lit(-(2**62))))
    return running(s, [], "_s", list(order), {name: F.lit(1).cast("bigint")}, inclusive=False).withColumn(name, F.col(name).cast("bigint")).drop("_s")


def bit_ranks(bits: DataFrame) -> DataFrame:
    """``(pos, bit, rank1, rank0)``: ones and zeros before each position."""
    s = running(bits.withColumn("_s", shard_of(F.col("pos"), SHARD)), [], "_s", ["pos"], {"rank1": F.col("bit").cast("bigint")}, inclusive=False).drop("_s")
    return s.select("pos", "bit", F.col("rank1").cast("bigint").alias("rank1"), (F.col("pos") - F.col("rank1")).cast("bigint").alias("rank0"))


def select_bits(bits: DataFrame, bit: bool = True) -> DataFrame:
    """``(r, pos)``: position of the (r+1)-th bit of the given kind."""
    s = bit_ranks(bits).where(F.col("bit") == F.lit(bit))
    return s.select(F.col("rank1" if bit else "rank0").alias("r"), "pos")


def next_bits(bits: DataFrame) -> DataFrame:
    """``(pos, next1, next0)``: nearest one and nearest zero at or after each position, -1 if none."""
    out = bits.select("pos")
    for name, kind in (("next1", True), ("next0", False)):
        at = bits.where(F.col("bit") == F.lit(kind)).select(F.col("pos").alias("at"))
        out = asof_join(out.withColumn("_q", F.col("pos") - 1), at, [], "_q", "at", "_h", ahead=True, width=SHARD)
        out = out.withColumn(name, F.coalesce("_h.at", F.lit(-1)).cast("bigint")).drop("_q", "_h")
    return out


def scan_bits(bits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, one, zero)``: position of the (skip+1)-th one, and zero, at or after ``pos``; -1 if there are fewer. ``queries`` has ``qid, pos, skip``.

    A negative ``pos`` counts from 0, one past the end has none.
    """
    ranks = bit_ranks(bits)
    q = queries.select("qid", F.greatest("pos", F.lit(0)).alias("pos"), "skip")
    q = join_on(q, ranks.select("pos", "rank1", "rank0"), ["pos"])
    for name, kind, rank in (("one", True, "rank1"), ("zero", False, "rank0")):
        at = ranks.where(F.col("bit") == F.lit(kind)).select(F.col(rank).alias("_r"), F.col("pos").alias(name))
        q = join_on(q.withColumn("_r", F.col(rank) + F.col("skip")), at, ["_r"]).drop("_r")
    return q.select("qid", *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("one", "zero")])


def value_ranks(seq: DataFrame, value: str = "v") -> DataFrame:
    """``(pos, v, code)``: each value's place among the distinct values, from 0; null for null. Distinct values are numbered by shards of value."""
    words = seq.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct()
    codes = numbered(words, ["v"], "v", "code")
    return join_on(seq.select("pos", F.col(value).alias("v")), codes, ["v"]).select("pos", "v", "code")


def rrr_blocks(bits: DataFrame, size: int = 63) -> DataFrame:
    """A bit array compressed by blocks of ``size`` bits: ``(block, ones, offset, before)``, the class of each block (its ones), its number
    among the blocks of its class, and the ones before it. Blocks without ones are there too; missing bits are zeros."""
    word = F.sum(F.when(F.col("bit"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("pos", F.lit(size)).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    b = bits.groupBy(floor_div(F.col("pos"), size).alias("block")).agg(word.alias("_w"))
    b = b.select("block", F.bit_count("_w").cast("bigint").alias("ones"), rrr_offset(F.col("_w"), size).alias("offset"), shard_of(F.col("block"), SHARD).alias("_s"))
    return running(b, [], "_s", ["block"], {"before": F.col("ones")}, inclusive=False).select("block", "ones", "offset", F.col("before").cast("bigint").alias("before"))


def rrr_lookup(blocks: DataFrame, points: DataFrame, size: int = 63) -> DataFrame:
    """``(pos, bit, rank1)`` of each point from compressed blocks: only the point's own block is decoded."""
    p = points.select("pos", floor_div(F.col("pos"), size).alias("block"))
    word = rrr_word(F.col("ones"), F.col("offset"), size)
    at = F.pmod("pos", F.lit(size)).cast("int")
    low = word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at) - 1)
    return join_on(p, blocks, ["block"], "inner").select("pos", (F.call_function("shiftright", word, at) % 2 == 1).alias("bit"), (F.col("before") + F.bit_count(low)).cast("bigint").alias("rank1"))


def rrr_select(blocks: DataFrame, ranks: DataFrame, size: int = 63) -> DataFrame:
    """``(r, pos)``: the (r+1)-th one from compressed blocks; null if there are fewer."""
    at = blocks.where("ones > 0").select(F.col("before").alias("at"), "block", "ones", "offset")
    hit = asof_join(ranks.select("r"), at, [], "r", "at", "_h", width=1 << 20)
    word, k = rrr_word(F.col("_h.ones"), F.col("_h.offset"), size), (F.col("r") - F.col("_h.at")).cast("int")
    # the word is decoded once, as the element of an array, not for each of its bits
    inside = F.get(F.get(F.transform(F.array(word), lambda w: F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("shiftright", w, i) % 2 == 1)), F.lit(0)), k)
    return hit.select("r", (F.col("_h.block") * size + inside).cast("bigint").alias("pos"))


def sparse_ranks(positions: DataFrame, points: DataFrame) -> DataFrame:
    """``(pos, rank, is_set)`` of each point: set positions before it, and whether it is one. ``positions`` has distinct ``at``."""
    p = numbered(positions, ["at"], "at", "i")
    got = asof_join(points, p, [], "pos", "at", "_h", width=SHARD)
    hit = F.coalesce(F.col("_h.at") == F.col("pos"), F.lit(False))
    return got.select(*points.columns, (F.coalesce(F.col("_h.i") + 1, F.lit(0)) - hit.cast("bigint")).cast("bigint").alias("rank"), hit.alias("is_set"))


def prefix_sums(array: DataFrame, value: str = "v") -> DataFrame:
    """``(pos, v, psum)``: sum of the values before each position."""
    s = running(array.select("pos", F.col(value).alias("v")).withColumn("_s", shard_of(F.col("pos"), SHARD)), [], "_s", ["pos"], {"psum": F.col("v")}, inclusive=False)
    return s.select("pos", "v", F.col("psum").cast("bigint").alias("psum"))


def prefix_sum_rank(array: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target, rank)``: least ``i`` with ``prefixsum(i) >= target``; the length of the array if the target exceeds the total. Values aren't negative."""
    s = prefix_sums(array)
    total = s.agg((F.max("pos") + 1).alias("pos"), F.sum("v").alias("psum"))
    # of equal sums the first position counts
    marks = s.select("psum", "pos").unionByName(total.select("psum", "pos")).groupBy("psum").agg(F.min("pos").alias("pos"))
    got = asof_join(targets.withColumn("_q", F.col("target") - 1), marks.withColumnRenamed("psum", "at"), [], "_q", "at", "_h", ahead=True, width=1 << 20)
    length = array.agg(F.count(F.lit(1)).alias("_n"))
    n = length.head()["_n"]
    return got.select("target", F.coalesce("_h.pos", F.lit(n)).cast("bigint").alias("rank"))


def symbol_ranks(seq: DataFrame) -> DataFrame:
    """``(pos, c, rank)``: occurrences of the symbol before each position; also the table for select: the (rank+1)-th ``c`` is at ``pos``."""
    s = seq.select("pos", "c").withColumn("_s", shard_of(F.col("pos"), SHARD))
    return running(s, ["c"], "_s", ["pos"], {"rank": F.lit(1).cast("bigint")}, inclusive=False).select("pos", "c", F.col("rank").cast("bigint").alias("rank"))


def dominance(points: DataFrame, queries: DataFrame, x: str, y: str) -> DataFrame:
    """``(qid, n)``: points with ``x < qx`` and ``y < qy``, each point counted as often as it occurs.

    ``points`` has ``x``, ``y`` (0 or more; negative ones and nulls count nowhere), ``queries`` ``qid, qx, qy``. Layers are
    made up to the highest bit of any ``qy``; a point above that is below no query.
    """
    bits = max(1, int(queries.agg(F.max("qy").alias("m")).head()["m"] or 0)).bit_length()
    top = 1 << bits
    good = points.select(F.col(x).cast("bigint").alias("x"), F.col(y).cast("bigint").alias("y")).where((F.col("y") >= 0) & (F.col("y") < top) & F.col("x").isNotNull())
    good = good.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    level = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("l")
    layers = good.select("x", "y", "w", level).where(F.expr("shiftright(y, l) % 2 = 0")).select("l", F.expr("shiftright(y, l)").alias("p"), "x", "w")
    layers = layers.groupBy("l", "p", "x").agg(F.sum("w").alias("w")).withColumn("_s", shard_of(F.col("x"), SHARD))
    upto = running(layers, ["l", "p"], "_s", ["x"], {"n": F.col("w")}).select("l", "p", F.col("x").alias("at"), "n")
    q = queries.select("qid", F.col("qx").cast("bigint").alias("qx"), F.least(F.greatest(F.col("qy").cast("bigint"), F.lit(0)), F.lit(top)).alias("qy"))
    parts = q.select("qid", (F.col("qx") - 1).alias("at_most"), "qy", level).where(F.expr("shiftright(qy, l) % 2 = 1")).select("qid", "at_most", "l", F.expr("shiftright(qy, l) - 1").alias("p"))
    got = asof_join(parts, upto, ["l", "p"], "at_most", "at", "_h").groupBy("qid").agg(F.sum("_h.n").alias("n"))
    return join_on(queries.select("qid"), got, ["qid"]).select("qid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rank_all(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, less, equal, more)``: symbols below, equal to and above ``c`` at positions before ``p``. ``queries`` has ``qid, c, p``."""
    two = queries.select("qid", "c", "p", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    two = two.select(F.struct("qid", "k").alias("qid"), F.col("p").alias("qx"), (F.col("c") + F.col("k")).alias("qy"))
    got = dominance(seq, two, "pos", "c").select("qid.qid", "qid.k", "n")
    got = got.groupBy("qid").agg(F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("less"), F.sum(F.when(F.col("k") == 1, F.col("n"))).alias("le"))
    length = seq.count()
    out = join_on(queries, got, ["qid"])
    return out.select("qid", "less", (F.col("le") - F.col("less")).alias("equal"), (F.least(F.col("p"), F.lit(length)) - F.col("le")).cast("bigint").alias("more"))


def box_count(points: DataFrame, boxes: DataFrame, x: str, y: str) -> DataFrame:
    """``(qid, n)``: points in ``[x1, x2) x [y1, y2)``, reversed bounds swapped; by four dominance counts."""
    lo = lambda a, b: F.least(a, b)
    hi = lambda a, b: F.greatest(a, b)
    c = F.array(
        *[F.struct(F.lit(s).alias("s"), fx("x1", "x2").alias("qx"), fy("y1", "y2").alias("qy")) for s, fx, fy in ((1, hi, hi), (-1, lo, hi), (-2, hi, lo), (2, lo, lo))]
    )
    four = boxes.select("qid", F.explode(c).alias("_c")).select(F.struct("qid", F.col("_c.s").alias("s")).alias("qid"), "_c.qx", "_c.qy")
    n = dominance(points, four, x, y).groupBy("qid.qid").agg(F.sum(F.signum("qid.s") * F.col("n")).cast("bigint").alias("n"))
    return n


def in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str) -> DataFrame:
    """``(qid, x, y)`` of the points in each box ``[x1, x2) x [y1, y2)``, reversed bounds swapped.

    Boxes and points meet in cells about as wide and high as the box, of which it touches four at most; a point is looked up
    once in the cells of each shape that the boxes have (widths and heights in powers of four).
    """
    size = lambda c: F.expr(f"2 * ((length(bin({c} - 1)) + 1) div 2)").cast("int")
    b = boxes.select("qid", F.least("x1", "x2").alias("_x1"), F.greatest("x1", "x2").alias("_x2"), F.least("y1", "y2").alias("_y1"), F.greatest("y1", "y2").alias("_y2"))
    b = b.where("_x1 < _x2 and _y1 < _y2").withColumns({"_lx": size("(_x2 - _x1)"), "_ly": size("(_y2 - _y1)")})
    shapes = b.agg(F.collect_set(F.struct("_lx", "_ly"))).scalar()
    cells = lambda lo, hi, by: F.explode(F.expr(f"sequence(shiftright({lo}, {by}), shiftright({hi} - 1, {by}))"))
    b = b.withColumn("_cx", cells("_x1", "_x2", "_lx")).withColumn("_cy", cells("_y1", "_y2", "_ly"))
    p = points.select(F.col(x).cast("bigint").alias("x"), F.col(y).cast("bigint").alias("y")).where("x is not null and y is not null").select("x", "y", F.explode(shapes).alias("_l"))
    p = p.select("x", "y", "_l._lx", "_l._ly").withColumns({"_cx": F.expr("shiftright(x, _lx)"), "_cy": F.expr("shiftright(y, _ly)")})
    both = join_on(b, p, ["_lx", "_ly", "_cx", "_cy"], "inner").where("x >= _x1 and x < _x2 and y >= _y1 and y < _y2")
    return both.select("qid", "x", "y")


def kth(seq: DataFrame, ranges: DataFrame, bits: int = 4) -> DataFrame:
    """``(qid, value, at)``: the ``k``-th smallest symbol (from 0) at positions ``[b, e)`` and its first position there; null if there are fewer.

    Goes down the layers of a wavelet tree, ``bits`` bits of the symbol a round: the symbols with each next digit at positions
    before both ends are counted by one as-of join, and the range goes on in the digit that holds its ``k``-th. So the cost
    of a range doesn't depend on its length. Null symbols aren't counted.
    """
    s = seq.select("pos", F.col("c").cast("bigint").alias("c")).where("c is not null")
    ends = s.agg(F.min("c").alias("lo"), F.max("c").alias("hi")).head()
    low = int(ends["lo"] or 0)
    rounds = -(-max(1, (int(ends["hi"] or 0) - low).bit_length()) // bits)
    s = s.select("pos", (F.col("c") - low).alias("c"), shard_of(F.col("pos"), SHARD).alias("_s"))
    state = ranges.select("qid", F.col("b").cast("bigint").alias("b"), F.col("e").cast("bigint").alias("e"), F.col("k").cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("p")).where("k >= 0 and b < e")
    for r in range(rounds - 1, -1, -1):
        layer = s.withColumn("p", F.shiftright("c", r * bits))
        upto = running(layer, ["p"], "_s", ["pos"], {"n": F.lit(1).cast("bigint")}).select("p", F.col("pos").alias("at"), "n")
        asked = state.select("qid", "b", "e", "k", "p", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))).alias("d"))
        sides = F.explode(F.array(F.struct((F.col("b") - 1).alias("q"), F.lit(-1).alias("w")), F.struct((F.col("e") - 1).alias("q"), F.lit(1).alias("w")))).alias("_e")
        asked = asked.select("qid", "b", "e", "k", (F.shiftleft("p", bits) + F.col("d")).alias("p"), sides).select("qid", "b", "e", "k", "p", "_e.q", "_e.w")
        n = asof_join(asked, upto, ["p"], "q", "at", "_h", width=SHARD).groupBy("qid", "b", "e", "k", "p").agg(F.sum(F.col("w") * F.coalesce("_h.n", F.lit(0))).cast("bigint").alias("n"))
        all_ = n.groupBy("qid", "b", "e", "k").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("_d"))
        none = F.lit(-1).cast("bigint")
        pick = F.aggregate("_d", F.struct(F.col("k").alias("k"), none.alias("p")), lambda a, x: F.when((a.p >= 0) | (x.n == 0), a).when(a.k < x.n, F.struct(a.k.alias("k"), x.p.alias("p"))).otherwise(F.struct((a.k - x.n).alias("k"), none.alias("p"))))
        state = written(all_.select("qid", "b", "e", pick.alias("_a")).where("_a.p >= 0").select("qid", "b", "e", "_a.k", "_a.p"), "kth")
    at = asof_join(state.withColumn("_q", F.col("b") - 1), s.select(F.col("c").alias("p"), F.col("pos").alias("at")), ["p"], "_q", "at", "_h", ahead=True, width=SHARD)
    return join_on(ranges.select("qid"), at.select("qid", (F.col("p") + low).alias("value"), F.col("_h.at").alias("at")), ["qid"])


def range_nodes(b: Column, e: Column, levels: int) -> Column:
    """The dyadic nodes (level, number) that make up ``[b, e)``."""
    each = F.sequence(F.lit(0), F.lit(levels))

    def at(level: Column) -> Column:
        # on level l the range is [ceil(b / 2^l), e div 2^l); an odd end sticks out of the next level
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        lo = F.call_function("shiftright", b + size - 1, level)
        hi = F.call_function("shiftright", e, level)
        left = F.when((lo < hi) & (F.pmod(lo, F.lit(2)) == 1), F.struct(level.alias("l"), lo.alias("i")))
        right = F.when((lo < hi) & (F.pmod(hi, F.lit(2)) == 1) & ~((lo + 1 == hi) & (F.pmod(lo, F.lit(2)) == 1)), F.struct(level.alias("l"), (hi - 1).alias("i")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(each, at)), lambda x: x.isNotNull())


def extremes(seq: DataFrame, ranges: DataFrame, value: str = "v", levels: int = 40) -> DataFrame:
    """``(qid, min, min_at, max, max_at)`` of the values at positions ``[b, e)``; of equal values the smallest position; null for empty ranges.

    Dyadic nodes hold their extremes; a range is put together from at most two nodes a level. Positions are below ``2^levels``.
    """
    low = F.struct(F.col(value).alias("v"), F.col("pos").alias("at"))
    high = F.struct((-F.col(value)).alias("v"), F.col("pos").alias("at"))
    seq = written(seq.select("pos", value), "sequence")  # read twice
    top = int(seq.agg(F.max("pos").alias("m")).head()["m"] or 0).bit_length()
    levels = min(levels, top)
    blocks = 6
    nodes = seq.select(low.alias("lo"), high.alias("hi"), "pos", F.explode(F.sequence(F.lit(0), F.lit(min(blocks, levels)))).alias("l"))
    nodes = nodes.groupBy("l", F.expr("shiftright(pos, l)").alias("i")).agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    if levels > blocks:  # the levels above from blocks, not from single values
        up = nodes.where(F.col("l") == blocks).select("lo", "hi", "i", F.explode(F.sequence(F.lit(blocks + 1), F.lit(levels))).alias("l"))
        up = up.groupBy("l", F.expr(f"shiftright(i, l - {blocks})").alias("i")).agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"))
        nodes = nodes.unionByName(up)
    asked = ranges.select("qid", F.explode(range_nodes(F.col("b"), F.col("e"), levels)).alias("_n")).select("qid", "_n.l", "_n.i")
    got = join_on(asked, nodes, ["l", "i"], "inner").groupBy("qid").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    out = join_on(ranges.select("qid"), got, ["qid"])
    return out.select("qid", F.col("lo.v").alias("min"), F.col("lo.at").alias("min_at"), (-F.col("hi.v")).alias("max"), F.col("hi.at").alias("max_at"))


def excess(bits: DataFrame) -> DataFrame:
    """``(pos, bit, excess)``: ones less zeros up to and with each position."""
    s = running(bits.withColumn("_s", shard_of(F.col("pos"), SHARD)), [], "_s", ["pos"], {"excess": F.when(F.col("bit"), 1).otherwise(-1)})
    return s.select("pos", "bit", F.col("excess").cast("bigint").alias("excess"))


def run_lengths(array: DataFrame, value: str = "v") -> DataFrame:
    """Runs of equal values: ``(pos, v, n)``."""
    s = array.select("pos", F.col(value).alias("v")).withColumn("_s", shard_of(F.col("pos"), SHARD))
    s = neighbour(s, [], "_s", ["pos"], ["v"], "_b")
    s = s.withColumn("_new", F.when(F.col("_b.v") == F.col("v"), 0).otherwise(1).cast("bigint"))
    return running(s, [], "_s", ["pos"], {"_run": F.col("_new")}).groupBy("_run", "v").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")).drop("_run")


def run_lookup(runs: DataFrame, points: DataFrame) -> DataFrame:
    """``(pos, v)`` of each point from run lengths."""
    return asof_join(points, runs.select(F.col("pos").alias("at"), "v"), [], "pos", "at", "_h", width=SHARD).select("pos", F.col("_h.v").alias("v"))


def bit_layers(seq: DataFrame, bits: int) -> DataFrame:
    """The layers of a wavelet tree: ``(layer, idx, bit)``, layer 0 by the highest bit, each stably ordered by the bits above.

    Positions within a layer are numbered per node (value of the bits above), so layers need no global order.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("layer")
    s = seq.select("pos", "c", level).withColumn("node", F.expr(f"shiftright(c, {bits} - layer)")).withColumn("_s", shard_of(F.col("pos"), SHARD))
    s = running(s, ["layer", "node"], "_s", ["pos"], {"idx": F.lit(1).cast("bigint")}, inclusive=False)
    return s.select("layer", "node", F.col("idx").cast("bigint").alias("idx"), F.expr(f"cast(shiftright(c, {bits} - 1 - layer) % 2 as int)").alias("bit"))

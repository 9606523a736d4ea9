"""Trees as adjacency tables ``(id, parent)``: numbering, lowest common ancestors, balanced parentheses, Cartesian trees.

A root has a null parent (or is its own). Numbers and depths follow from the tour of the tree, which has two rows a node
whatever its depth; a node with very many children is cut into shards of ids like any hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .joins import asof_join
from .sequence import excess, extremes, range_nodes
from .sharding import join_on, neighbour, running, scan, shard_of

SHARD = 1 << 14
#: Copies of a row that many rows may ask for.
SALTS = 32
#: Beyond every position of a bracket sequence whose levels are searched from the right.
_FAR = (1 << 40) - 1


def edges(tree: DataFrame) -> DataFrame:
    """``(id, parent)`` without roots."""
    return tree.select("id", "parent").where("id is not null and parent is not null and id <> parent")


def children(tree: DataFrame) -> DataFrame:
    """``(id, children, is_leaf)`` of every node."""
    n = edges(tree).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    out = join_on(tree.select("id").where("id is not null"), n, ["id"])
    return out.select("id", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"), F.col("children").isNull().alias("is_leaf"))


def child_at(tree: DataFrame) -> DataFrame:
    """``(parent, i, id)``: the i-th child (from 0, by id) of each node."""
    e = edges(tree).withColumn("_s", shard_of(F.col("id"), SHARD))
    return running(e, ["parent"], "_s", ["id"], {"i": F.lit(1).cast("bigint")}, inclusive=False).select("parent", F.col("i").cast("bigint").alias("i"), "id")


def _tour_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of events and their successors, in groups of ``_b`` sorted by it: for each event the first event of another group that
    follows it (null if none does), the events to there, and the change of depth from the event to there."""

    def solve(e: np.ndarray, nxt: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(e)
        e, nxt, ends = e[order], nxt[order], ends[order]
        at = np.minimum(np.searchsorted(e, nxt), len(e) - 1)
        ptr = np.where(~ends & (e[at] == nxt), at, -1)
        count = np.where(ends, 0, 1)
        depth = np.where(ends, 0, 1 - 2 * (nxt & 1))
        target, last = nxt.copy(), ends.copy()
        for _ in range(len(e).bit_length() + 1):
            go = np.flatnonzero(ptr >= 0)
            if not len(go):
                break
            to = ptr[go]
            count[go], depth[go] = count[go] + count[to], depth[go] + depth[to]
            target[go], last[go], ptr[go] = target[to], last[to], ptr[to]
        else:
            raise ValueError("the table has a cycle")
        return pa.RecordBatch.from_arrays([pa.array(e), pa.array(target, mask=last), pa.array(count), pa.array(depth)], ["e", "target", "count", "depth"])

    held: list[tuple[np.ndarray, ...]] = []
    group = None
    for b in batches:
        g, e, n = (b.column(c) for c in ("_b", "e", "next"))
        g, ends = g.to_numpy(), n.is_null().to_numpy(zero_copy_only=False)
        e, n = e.to_numpy(), n.fill_null(0).to_numpy(zero_copy_only=False)
        for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
            if len(part):
                if held and g[part[0]] != group:
                    yield solve(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                group = g[part[0]]
                held.append((e[part], n[part], ends[part]))
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def _nodes(tree: DataFrame) -> DataFrame:
    """``(id, parent)`` of every node once (of repeated ids the smallest parent counts); parents that are no nodes are null."""
    nodes = tree.where("id is not null").groupBy("id").agg(F.min(F.when(F.col("parent") != F.col("id"), F.col("parent"))).alias("parent"))
    nodes = written(nodes, "nodes")  # read several times
    strange = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    if strange.isEmpty():
        return nodes
    hit = join_on(nodes, strange.select(F.col("id").alias("parent"), F.lit(True).alias("_none")), ["parent"])
    return hit.select("id", F.when(F.col("_none").isNull(), F.col("parent")).alias("parent"))


def tour(tree: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The depth-first tour, children and roots in order of id: ``(pos, id, enters, depth, node)``.

    A node is entered and left, ``depth`` counts the nodes entered and not left yet after that, ``node`` is the deepest of them
    (null if none). Each event's successor follows from its siblings; the list of events is ranked by pointer jumping: within
    groups of ``width`` ids first, then among the events at which a group is entered, in about log2(their number) rounds. Rows
    are two a node however deep the tree is. A cycle raises ``ValueError``.
    """
    nodes = _nodes(tree)
    # one scan of the siblings of each parent, before which the parent itself stands
    kids = nodes.select(F.struct("parent").alias("_p"), "id", F.lit(1).alias("_t"), shard_of(F.col("id"), SHARD).alias("_s"))
    heads = nodes.select(F.struct(F.col("id").alias("parent")).alias("_p"), "id", F.lit(0).alias("_t"), F.lit(-(2**62)).alias("_s"))
    s = scan(kids.unionByName(heads), ["_p"], "_s", ["_t", "id"], after=("_after", ["id"]))
    enter, leave = (lambda c: F.shiftleft(c, 1)), (lambda c: F.shiftleft(c, 1) + 1)
    into = F.when(F.col("_after").isNotNull(), enter(F.col("_after.id")))
    e = s.select(
        F.when(F.col("_t") == 0, enter(F.col("id"))).otherwise(leave(F.col("id"))).alias("e"),
        F.coalesce(into, F.when(F.col("_t") == 0, leave(F.col("id"))).otherwise(leave(F.col("_p.parent")))).alias("next"), shard_of(F.col("id"), width).alias("_b"),
    )
    schema = "e bigint, target bigint, count bigint, depth bigint"
    near = written(e.repartition("_b").sortWithinPartitions("_b").mapInArrow(_tour_in, schema), "tour")
    n = near.count()
    doors = near.where("target is not null").select(F.col("target").alias("e")).distinct()
    jump = near.join(doors, "e", "left_semi")
    for k in range(n.bit_length() + 2):
        jump = written(jump, "jump")
        if jump.where("target is not null").isEmpty():
            break
        to = jump.select(F.col("e").alias("target"), F.col("target").alias("_t"), F.col("count").alias("_c"), F.col("depth").alias("_d"))
        jump = join_on(jump, to, ["target"]).select("e", F.col("_t").alias("target"), (F.col("count") + F.coalesce("_c", F.lit(0))).alias("count"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
    else:
        raise ValueError("the table has a cycle")
    rest = jump.select(F.col("e").alias("target"), F.col("count").alias("_c"), F.col("depth").alias("_d"))
    far = join_on(near, rest, ["target"])
    after, down = F.col("count") + F.coalesce("_c", F.lit(0)), F.col("depth") + F.coalesce("_d", F.lit(0))
    far = far.select(F.shiftright("e", 1).alias("id"), (F.col("e") % 2 == 0).alias("enters"), (F.lit(n - 1) - after).alias("pos"), (-down).alias("depth"))
    return join_on(far, nodes, ["id"]).select("pos", "id", "enters", "depth", F.when(F.col("enters"), F.col("id")).otherwise(F.col("parent")).alias("node"))


def dfs(tree: DataFrame) -> DataFrame:
    """``(id, parent, depth, size, pre, post)``: depth-first numbers, children and roots in order of id; roots have depth 0.

    Of repeated ids the smallest parent counts; a node whose parent isn't in the table is a root.
    """
    t = tour(tree)
    at = lambda c, enters: F.max(F.when(F.col("enters") == enters, F.col(c)))
    each = t.groupBy("id").agg(at("node", False).alias("parent"), (at("depth", True) - 1).alias("depth"), at("pos", True).alias("_a"), at("pos", False).alias("_b"))
    each = each.select("id", "parent", "depth", F.shiftright(F.col("_b") - F.col("_a") + 1, 1).alias("size"), F.shiftright(F.col("_a") + F.col("depth"), 1).alias("pre"))
    return each.select("*", (F.col("pre") + F.col("size") - 1 - F.col("depth")).alias("post"))


def depths(tree: DataFrame) -> DataFrame:
    """``(id, depth)``, roots at 0."""
    return tour(tree).where("enters").select("id", (F.col("depth") - 1).alias("depth"))


def lca(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(qid, lca)`` of the nodes ``a`` and ``b`` of each pair: their deepest common ancestor, null if there is none.

    It is the node at the least depth of the tour between the entries of the two. Unknown nodes have none.
    """
    t = written(tour(tree), "tour")
    ends = pairs.select("qid", F.explode(F.array("a", "b")).alias("id"))
    got = join_on(ends, t.where("enters").select("id", "pos"), ["id"], "inner").groupBy("qid").agg(F.min("pos").alias("b"), (F.max("pos") + 1).alias("e"), F.count(F.lit(1)).alias("n"))
    low = extremes(t.select("pos", F.col("depth").alias("v")), got.where("n = 2").select("qid", "b", "e")).select("qid", F.col("min_at").alias("pos"))
    found = join_on(low, t.select("pos", "node"), ["pos"]).select("qid", F.col("node").alias("lca"))
    return join_on(pairs.select("qid"), found, ["qid"])


def parentheses(numbered: DataFrame) -> DataFrame:
    """Balanced parentheses of a tree numbered by :func:`dfs`: ``(pos, bit, id)``, opening ones true."""
    first = 2 * F.col("pre") - F.col("depth")
    both = F.array(F.struct(first.alias("pos"), F.lit(True).alias("bit")), F.struct((first + 2 * F.col("size") - 1).alias("pos"), F.lit(False).alias("bit")))
    return numbered.select("id", F.explode(both).alias("_b")).select("_b.pos", "_b.bit", "id")


def _levels(bits: DataFrame) -> DataFrame:
    return excess(bits).withColumn("level", F.col("excess") + F.when(F.col("bit"), 0).otherwise(1))


def matches(bits: DataFrame) -> DataFrame:
    """``(pos, bit, match)`` of balanced parentheses: within a level of nesting an opening one is followed by its closing one."""
    s = _levels(bits).withColumn("_s", shard_of(F.col("pos"), SHARD))
    s = neighbour(s, ["level"], "_s", ["pos"], ["pos"], "_after", ahead=True)
    s = neighbour(s, ["level"], "_s", ["pos"], ["pos"], "_before")
    return s.select("pos", "bit", F.when(F.col("bit"), F.col("_after.pos")).otherwise(F.col("_before.pos")).alias("match"))


def enclosing(bits: DataFrame) -> DataFrame:
    """``(pos, enclose)`` of opening parentheses: the nearest opening one around each, null at the outermost level."""
    o = _levels(bits).where("bit").select("pos", "level")
    q = o.select("pos", (F.col("level") - 1).alias("level"))
    got = asof_join(q, o.select(F.col("pos").alias("at"), "level"), ["level"], "pos", "at", "_h", width=SHARD)
    return got.select("pos", F.col("_h.at").alias("enclose"))


def range_enclosing(bits: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(qid, pos)``: of opening parentheses ``i < j`` the first opening one after the close of ``i`` that encloses ``j``; null if there is none,
    also where ``i`` encloses ``j``. ``pairs`` has ``qid, i, j``.

    It is the last position of the lowest level between the close of ``i`` and ``j``, if that opens.
    """
    s = written(_levels(bits).select("pos", "bit", "level"), "levels")
    close = matches(bits).where("bit").select(F.col("pos").alias("i"), F.col("match").alias("_c"))
    q = join_on(pairs.select("qid", "i", "j"), close, ["i"], "inner").where("_c < j")
    # of equal levels the smallest place counts: places from the right
    got = extremes(s.select((F.lit(_FAR) - F.col("pos")).alias("pos"), F.col("level").alias("v")), q.select("qid", (F.lit(_FAR) - F.col("j") + 1).alias("b"), (F.lit(_FAR) - F.col("_c")).alias("e")), levels=_FAR.bit_length())
    hit = join_on(got.select("qid", (F.lit(_FAR) - F.col("min_at")).alias("pos")), s.where("bit").select("pos", "bit"), ["pos"])
    return join_on(pairs.select("qid"), hit.select("qid", F.when(F.col("bit"), F.col("pos")).alias("pos")), ["qid"])


def _smaller_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard and position: each one's previous and next smaller position within its shard.

    Only rows that no smaller value of the shard follows or precedes matter to other shards.
    """

    def solve(pos: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        n = len(pos)
        prev, nxt = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        stack: list[int] = []
        values = v.tolist()
        for i, x in enumerate(values):
            while stack and values[stack[-1]] > x:
                nxt[stack.pop()] = i
            if stack:
                prev[i] = stack[-1]
            stack.append(i)
        mask_p, mask_n = prev < 0, nxt < 0
        cols = [pa.array(pos), pa.array(v), pa.array(pos[prev], mask=mask_p), pa.array(v[prev], mask=mask_p), pa.array(pos[nxt], mask=mask_n), pa.array(v[nxt], mask=mask_n)]
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in cols], ["pos", "v", "prev", "prev_v", "next", "next_v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    shard = None
    for b in batches:
        s, p, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "pos", "v"))
        for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
            if len(part):
                if held and s[part[0]] != shard:
                    yield solve(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                shard = s[part[0]]
                held.append((p[part], v[part]))
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def _beyond(open_: DataFrame, nodes: DataFrame, levels: int, ahead: bool) -> DataFrame:
    """Of rows ``(pos, v, _s)`` the nearest shard before (``ahead``: after) that has a value not above (below) ``v``: ``(pos, v, t)``.

    The shards on that side are a few dyadic nodes; the nearest one whose least value fits is searched down by levels.
    """
    fits = (lambda: F.col("m") < F.col("v")) if ahead else (lambda: F.col("m") <= F.col("v"))
    s = F.col("_s")
    around = range_nodes(s + 1, F.lit(1 << levels).cast("bigint"), levels) if ahead else range_nodes(F.lit(0).cast("bigint"), s, levels)
    # a node may be asked for by very many rows: its row is there once per salt
    salted = nodes.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod("pos", F.lit(SALTS)).cast("int").alias("_z")
    each = open_.select("pos", "v", salt, F.explode(around).alias("_n")).select("pos", "v", "_z", "_n.l", "_n.i")
    start = F.call_function("shiftleft", F.col("i"), F.col("l"))
    hit = join_on(each, salted, ["l", "i", "_z"], "inner").where(fits()).groupBy("pos", "v").agg((F.min_by if ahead else F.max_by)(F.struct("l", "i"), start).alias("_n"))
    found = hit.select("pos", "v", "_n.l", "_n.i", salt)
    for level in range(levels, 0, -1):
        # the child on the near side if it fits, else the other
        near, far = (2 * F.col("i"), 2 * F.col("i") + 1) if ahead else (2 * F.col("i") + 1, 2 * F.col("i"))
        here = F.col("l") == level
        step = found.select("pos", "v", "_z", F.when(here, level - 1).otherwise(F.col("l")).alias("l"), F.when(here, near).alias("_c"), F.when(here, far).otherwise(F.col("i")).alias("i"))
        child = salted.where(F.col("l") == level - 1).select(F.col("i").alias("_c"), "_z", "m")
        found = join_on(step, child, ["_c", "_z"]).select("pos", "v", "_z", "l", F.when(fits(), F.col("_c")).otherwise(F.col("i")).alias("i"))
    return found.select("pos", "v", F.col("i").alias("t"))


def smaller(seq: DataFrame, width: int = SHARD) -> DataFrame:
    """``(pos, v, prev, prev_v, next, next_v)``: nearest position before with a value not above, and after with a smaller value.

    Solved within shards. A row that is open in its shard has an answer only if an earlier (later) shard's least value fits,
    which a scan of the shards' least values tells; of those that have, the nearest such shard is searched in dyadic nodes of the
    least values, and the position in that shard by an as-of join over values. Null values aren't positions.
    """
    schema = "pos bigint, v bigint, prev bigint, prev_v bigint, next bigint, next_v bigint"
    rows = seq.select(F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("bigint").alias("v")).where("v is not null")
    s = rows.withColumn("_s", shard_of(F.col("pos"), width)).repartition("_s").sortWithinPartitions("_s", "pos")
    got = written(s.mapInArrow(_smaller_in, schema), "smaller")
    top = got.agg(F.max("pos").alias("m")).head()["m"]
    levels = int((top or 0) // width).bit_length()
    if not levels:
        return got
    got = got.withColumn("_s", shard_of(F.col("pos"), width))
    least = written(got.groupBy("_s").agg(F.min("v").alias("m")), "least")
    line = Window.orderBy("_s")  # a row per shard
    sides = least.select("_s", F.min("m").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("m").over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    nodes = least.select("m", "_s", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("l")).groupBy("l", F.expr("shiftright(_s, l)").alias("i")).agg(F.min("m").alias("m"))
    nodes = written(nodes, "nodes")
    own = got
    for name, ahead in (("prev", False), ("next", True)):
        side, other = ("_after", "prev") if ahead else ("_before", "next")
        open_ = join_on(own.where(F.col(name).isNull()).select("pos", "v", "_s"), sides.select("_s", side), ["_s"], "inner")
        open_ = open_.where(F.col(side) < F.col("v") if ahead else F.col(side) <= F.col("v"))
        t = _beyond(open_, nodes, levels, ahead).withColumn("_q", F.col("v") - int(ahead))
        # in the shard found, only rows that nothing smaller precedes (follows) can be the nearest
        steps = own.where(F.col(other).isNull()).groupBy(F.col("_s").alias("t"), F.col("v").alias("at")).agg(F.max("pos").alias("to"))
        hit = asof_join(t, steps, ["t"], "_q", "at", "_h").select("pos", F.col("_h.to").alias(f"_{name}"), F.col("_h.at").alias(f"_{name}_v"))
        got = join_on(got, hit, ["pos"]).withColumns({name: F.coalesce(name, f"_{name}"), f"{name}_v": F.coalesce(f"{name}_v", f"_{name}_v")}).drop(f"_{name}", f"_{name}_v")
        got = written(got, "smaller")
    return got.drop("_s")


def cartesian_parents(seq: DataFrame) -> DataFrame:
    """``(pos, v, parent)`` of the min-Cartesian tree: the larger of the nearest smaller values to both sides; null at the root.

    Of equal values the earlier is the ancestor.
    """
    s = smaller(seq)
    # of two bounds the larger value is the parent, of equal ones the later position
    left = F.col("next").isNull() | (F.col("prev").isNotNull() & (F.col("prev_v") > F.col("next_v")))
    return s.select("pos", "v", F.when(left, F.col("prev")).otherwise(F.col("next")).alias("parent"))

"""Filling containers of fixed capacity with items under several limits at once (vector bin packing).

An item has a number of tokens, of loss-bearing tokens, and is one segment. A container takes items until one of its
limits (tokens, segments, loss-bearing tokens) is met. Method: one container is filled at a time; the next item is, of
those that fit, the one whose vector has the largest dot product with what is left of the limits, each measured in parts
of its limit. Items are kept by token count in bands of equal loss share, in which the dot product rises with the count,
so only the largest item that fits in each band has to be looked at. A task packs its items in pools of bounded size,
and what a pool leaves in containers that aren't well filled goes on to its next pool.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

CAPACITY = 8192
SEGMENTS = 64
#: Loss-bearing tokens of a container; the rest is left to context.
LOSS_LIMIT = 7168
BANDS = 8
#: Items that a task packs at a time.
POOL = 1 << 16
#: A container below this share of the capacity is opened again with the next pool.
FULL = 0.98
#: Stands for a null key inside a task.
NO_KEY = -(2**63)


class _Band:
    """Items of one band by token count; ``largest(x)`` is the largest count of at most ``x`` that has an item, or 0."""

    def __init__(self, top: int):
        self.items: list[list[int]] = [[] for _ in range(top + 1)]
        self.below = list(range(top + 1))

    def add(self, tokens: int, item: int) -> None:
        self.items[tokens].append(item)

    def close(self) -> None:
        last = 0
        for t in range(len(self.below)):
            if t and self.items[t]:
                last = t
            self.below[t] = last

    def largest(self, x: int) -> int:
        below, items = self.below, self.items
        at = below[x]
        while at and not items[at]:
            at = below[at - 1]
        below[x] = at  # shortens the way for later calls
        return at


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS_LIMIT, bands: int = BANDS) -> list[list[int]]:
    """Containers, as lists of item numbers in the order of placing. Every item has 1 to ``capacity`` tokens.

    An item with more loss-bearing tokens than ``loss_limit`` gets a container of its own: it couldn't be placed otherwise,
    and items that fit the capacity are never split for it.
    """
    made = [[int(i)] for i in np.flatnonzero(loss > loss_limit)]
    fit = np.flatnonzero(loss <= loss_limit)
    share = np.minimum((loss[fit] * bands) // np.maximum(tokens[fit], 1), bands - 1)
    pools = [_Band(capacity) for _ in range(bands)]
    for i, k, t in zip(fit.tolist(), share.tolist(), tokens[fit].tolist()):
        pools[k].add(t, i)
    for p in pools:
        p.close()
    left = len(fit)
    tokens_, loss_ = tokens.tolist(), loss.tolist()
    while left:
        room, places, may, inside = capacity, segments, loss_limit, []
        while places and room:
            best, score, of = 0, -1.0, None
            a, b, c = room / capacity, places / segments, may / max(loss_limit, 1)
            for k, p in enumerate(pools):
                # loss is below (k+1)/bands of the tokens, so this many tokens fit under the loss limit for certain
                t = p.largest(min(room, may * bands // (k + 1)))
                if t:
                    i = p.items[t][-1]
                    s = a * t / capacity + b / segments + c * loss_[i] / max(loss_limit, 1)
                    if s > score:
                        best, score, of = t, s, p
            if not best:
                break
            i = of.items[best].pop()
            inside.append(i)
            room, places, may, left = room - tokens_[i], places - 1, may - loss_[i], left - 1
        if not inside:  # only items remain whose band is too coarse to show that they fit an empty container
            for p in pools:
                t = p.largest(capacity)
                if t:
                    inside, left = [p.items[t].pop()], left - 1
                    break
        made.append(inside)
    return made


def cut(n: np.ndarray, loss: np.ndarray, capacity: int = CAPACITY, loss_limit: int = LOSS_LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of items: each piece's item number, first token and tokens.

    An item of at most ``capacity`` tokens is one piece. A longer one is cut from its start into pieces that are as long as both
    limits allow; its loss-bearing tokens are its last ones.
    """
    context = n - loss
    spare = capacity - loss_limit  # a piece with so many tokens of context can be full
    full = np.where(n > capacity, np.minimum(np.where(context >= spare, np.maximum(context - spare, 0) // capacity + 1, 0), n // capacity), 0)
    rest = n - full * capacity
    mixed = np.where(n > capacity, np.minimum(rest, np.maximum(context - full * capacity, 0) + loss_limit), n)  # the piece after the full ones
    last = -(-(rest - mixed) // loss_limit)  # pieces of loss-bearing tokens only
    count = np.where(n > capacity, full + (mixed > 0) + last, 1)
    item = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    after = piece - full[item]
    begin = np.where(after <= 0, piece * capacity, full[item] * capacity + mixed[item] + (after - 1) * loss_limit)
    size = np.minimum(np.where(after < 0, capacity, np.where(after == 0, mixed[item], loss_limit)), n[item] - begin)
    return item, begin, size


def _assign(capacity: int, segments: int, loss_limit: int, pool: int):
    names = ["doc_id", "piece", "from_token", "n_tokens", "loss_tokens", "container", "segment", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held = np.zeros((0, 5), np.int64)  # doc, piece, from, tokens, loss

        def out(rows: np.ndarray, container, segment, place) -> pa.RecordBatch:
            doc = pa.array(rows[:, 0], mask=rows[:, 0] == NO_KEY)
            cols = [doc, rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4], container, segment, place]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names)

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            if not len(held):
                return
            held = held[np.lexsort((held[:, 1], held[:, 0]))]
            made = pack(held[:, 3], held[:, 4], capacity, segments, loss_limit)
            sums = [int(held[m, 3].sum()) for m in made]
            if final:
                shut = made
            else:
                # well filled, or not to be filled further; then the fuller ones, so that half of the pool is free again
                ranked = sorted(range(len(made)), key=lambda i: (-sums[i], made[i]))
                done = {i for i in ranked if sums[i] >= FULL * capacity or len(made[i]) >= segments or int(held[made[i], 4].sum()) > loss_limit}
                left = len(held) - sum(len(made[i]) for i in done)
                for i in ranked:
                    if left <= pool // 2:
                        break
                    if i not in done:
                        done.add(i)
                        left -= len(made[i])
                shut = [made[i] for i in sorted(done)]
            if shut:
                size = np.array([len(m) for m in shut])
                rows = held[np.concatenate([np.array(m) for m in shut])]
                lo = np.append(0, np.cumsum(size))[:-1]
                ends = np.cumsum(rows[:, 3]) - rows[:, 3]
                yield out(rows, number + np.repeat(np.arange(len(shut)), size), np.arange(len(rows)) - np.repeat(lo, size), ends - np.repeat(ends[lo], size))
                number += len(shut)
                keep = np.ones(len(held), bool)
                keep[np.concatenate([np.array(m) for m in shut])] = False
                held = held[keep]

        for batch in batches:
            doc = pc.fill_null(batch.column("doc_id"), NO_KEY).to_numpy(zero_copy_only=False)
            n, loss = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_tokens", "loss_tokens"))
            empty = n == 0
            if empty.any():
                z = np.zeros(int(empty.sum()), np.int64)
                null = pa.nulls(len(z), pa.int64())
                yield out(np.stack([doc[empty], z, z, z, z], 1), null, null, null)
            doc, n, loss = doc[~empty], n[~empty], loss[~empty]
            at, begin, size = cut(n, loss, capacity, loss_limit)
            piece = np.arange(len(at)) - np.searchsorted(at, at)
            # the loss-bearing tokens are the last ones of a document
            bears = np.clip(begin + size - np.maximum(begin, (n - loss)[at]), 0, size)
            rows = np.stack([doc[at], piece, begin, size, bears], 1)
            held = np.concatenate([held, rows])
            while len(held) >= pool:
                yield from flush(False)
        yield from flush(True)

    return run


def fill(
    sizes: DataFrame, key: str = "doc_id", n: str = "n_tokens", loss: str = "loss_tokens", capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS_LIMIT, pool: int = POOL
) -> DataFrame:
    """Assigns every item to a container: ``(doc_id, piece, from_token, n_tokens, loss_tokens, container, segment, place)``.

    ``segment`` is the item's number in its container and ``place`` the tokens before it there. An item is split only if
    it has more than ``capacity`` tokens, and then so that its pieces keep every limit (:func:`cut`). An item that fits the capacity
    but has more loss-bearing tokens than ``loss_limit`` is alone in its container, the only kind above that limit. Items without tokens (or null) need no
    container: one row with null ``container``. Null loss counts as 0, more than the tokens as the tokens. Equal keys are
    separate items. A task leaves at most a few containers open to the end; all others are well filled.
    """
    if capacity < 1 or segments < 1 or not 1 <= loss_limit <= capacity:
        raise ValueError("capacity and segments must be at least 1, loss_limit from 1 to capacity")
    t = F.greatest(F.coalesce(F.col(n).cast("bigint"), F.lit(0)), F.lit(0))
    use = F.least(F.greatest(F.coalesce(F.col(loss).cast("bigint"), F.lit(0)), F.lit(0)), t)
    rows = sizes.select(F.col(key).cast("bigint").alias("doc_id"), t.alias("n_tokens"), use.alias("loss_tokens"))
    schema = "doc_id bigint, piece bigint, from_token bigint, n_tokens bigint, loss_tokens bigint, container bigint, segment bigint, place bigint"
    return rows.mapInArrow(_assign(capacity, segments, loss_limit, pool), schema)


def split_items(assigned: DataFrame) -> DataFrame:
    """``(doc_id)`` of the items that were longer than a container, each once: those that have a second piece."""
    return assigned.where("piece = 1").select("doc_id").distinct()


def violations(assigned: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS_LIMIT) -> DataFrame:
    """One row that counts what an assignment breaks, all 0 if it is right, and ``items``, the number of distinct keys.

    ``over_capacity``, ``over_segments`` and ``over_loss``: containers above a limit (of loss: with two items or more, and pieces
    of a split item above it); ``misplaced``: containers whose items don't lie one behind the other; ``torn``: items whose pieces aren't each
    token once; ``needless``: items that are split but fit the capacity. Keys are unique. Read twice, so ``assigned`` is written first.
    """
    a = written(assigned, "assigned")
    count = lambda c: F.count(F.when(c, True))
    whole = a.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("from_token") + F.col("n_tokens")).alias("end"), F.max("loss_tokens").alias("loss")
    )
    split = F.col("pieces") > 1
    items = whole.agg(
        F.count(F.lit(1)).alias("items"), count((F.col("pieces") != F.col("last") + 1) | (F.col("n") != F.col("end"))).alias("torn"),
        count(split & (F.col("n") <= capacity)).alias("needless"), count(split & (F.col("loss") > loss_limit)).alias("over_loss"),
    )
    used = a.where("container is not null").groupBy("container").agg(
        F.sum("n_tokens").alias("n"), F.sum("loss_tokens").alias("loss"), F.count(F.lit(1)).alias("k"), F.max(F.col("place") + F.col("n_tokens")).alias("end")
    )
    bad = used.agg(
        count(F.col("n") > capacity).alias("over_capacity"), count(F.col("k") > segments).alias("over_segments"),
        count((F.col("loss") > loss_limit) & (F.col("k") > 1)).alias("over_loss"), count(F.col("n") != F.col("end")).alias("misplaced"),
    )
    names = ["items", "torn", "needless", "over_capacity", "over_segments", "over_loss", "misplaced"]
    return items.unionByName(bad, allowMissingColumns=True).agg(*[F.sum(c).alias(c) for c in names])

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import packing


@pytest.mark.parametrize("segments,limit", [(64, 8192), (10, 3000), (1, 8192), (64, 0)])
def test_pack(segments, limit):
    rng = np.random.default_rng(segments)
    t = np.clip(rng.lognormal(6, 1, 3000).astype(int), 1, 8192)
    loss = (t * rng.random(3000)).astype(int)
    made = packing.pack(t, loss, segments=segments, loss_limit=limit)
    assert sorted(i for m in made for i in m) == list(range(3000))
    for m in made:
        assert m and t[m].sum() <= 8192 and len(m) <= segments and (loss[m].sum() <= limit or len(m) == 1)


def test_pack_fills_well():
    rng = np.random.default_rng(1)
    t = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 8192)
    made = packing.pack(t, np.zeros(20_000, int))
    assert t.sum() / 8192 / len(made) > 0.99


def test_fill(spark):
    rng = np.random.default_rng(2)
    sizes = [(i, int(n), int(n * 0.7)) for i, n in enumerate(np.clip(rng.lognormal(6, 1.2, 5000), 1, 60_000))]
    odd = [(5000, 8192, 0), (5001, 8193, 8193), (5002, 0, 0), (5003, None, None), (5004, 100, None), (5005, 10, 99), (None, 12, 1), (5006, 30_000, 5), (5007, 7, 1), (5007, 7, 1)]
    df = spark.createDataFrame(sizes + odd, "doc_id bigint, n_tokens bigint, loss_tokens bigint").withColumns({"piece": F.lit("x"), "container": F.lit(0)}).repartition(3)
    out = packing.fill(df, pool=1000).toPandas()
    filled = out[out.container.notna()]
    by = filled.groupby("container")
    assert by.n_tokens.sum().max() <= 8192 and by.size().max() <= packing.SEGMENTS
    # only items that fit the capacity whole may exceed the limit on loss, each alone
    over = filled[filled.container.isin(by.loss_tokens.sum()[lambda x: x > packing.LOSS_LIMIT].index)]
    whole = {k for k, n, loss in sizes + odd if n and n <= 8192 and (loss or 0) > packing.LOSS_LIMIT}
    assert len(over) == over.container.nunique() and set(over.doc_id) == whole and (over.piece == 0).all()
    bad = packing.violations(packing.fill(df.where("doc_id <> 5007"), pool=1000)).head().asDict()
    assert bad.pop("items") == len({k for k, _, _ in sizes + odd} - {None, 5007}) and not any(bad.values())
    assert filled.n_tokens.sum() / 8192 / filled.container.nunique() > 0.95
    total = {}
    for k, n, _ in sizes + odd:
        total[k] = total.get(k, 0) + (n or 0)
    got = out.groupby("doc_id", dropna=False).n_tokens.sum()
    assert {None if np.isnan(k) else int(k): v for k, v in got.items()} == total
    pieces = out.groupby("doc_id").piece.max()
    assert {k for k, v in pieces.items() if v > 0} == {k for k, n, _ in sizes + odd if k is not None and n and n > 8192}
    assert out[out.container.isna()].n_tokens.max() == 0 and len(out[out.doc_id == 5007]) == 2
    for _, c in by:
        c = c.sort_values("segment")
        assert list(c.segment) == list(range(len(c))) and list(c.place) == [0, *c.n_tokens.cumsum()[:-1]]
    p = out[out.doc_id == 5006].sort_values("piece")
    assert list(p.from_token) == [0, 8192, 16384, 24576] and p.loss_tokens.sum() == 5 and list(p.loss_tokens)[-1] == 5
    assert {r["doc_id"] for r in packing.split_items(packing.fill(df)).collect()} == {k for k, v in pieces.items() if v > 0}
    assert packing.fill(df.limit(0)).collect() == []


@pytest.mark.parametrize("capacity,limit", [(10, 7), (10, 10), (10, 1), (8192, 7168)])
def test_cut(capacity, limit):
    rng = np.random.default_rng(capacity)
    n = rng.integers(1, 8 * capacity, 3000)
    loss = (n * rng.choice([0, 0.3, 0.9, 1], 3000)).astype(np.int64)
    item, begin, size = packing.cut(n, loss, capacity, limit)
    for i in range(3000):
        b, s = begin[item == i], size[item == i]
        assert list(b) == [0, *np.cumsum(s)[:-1]] and s.sum() == n[i] and s.min() > 0 and s.max() <= capacity
        assert (len(b) > 1) == (n[i] > capacity)
        if len(b) > 1:
            assert (np.clip(b + s - np.maximum(b, n[i] - loss[i]), 0, s) <= limit).all()


def test_violations_are_seen(spark):
    a = [(1, 0, 0, 9000, 0, 5, 0, 0), (2, 0, 0, 4000, 4000, 6, 0, 0), (3, 0, 0, 4000, 4000, 6, 1, 4001), (4, 0, 0, 10, 0, 7, 0, 0), (4, 1, 11, 10, 0, 8, 0, 0), (5, 0, 0, 0, 0, None, None, None)]
    a += [(100 + i, 0, 0, 1, 1, 9, i, i) for i in range(65)]
    df = spark.createDataFrame(a, "doc_id long, piece long, from_token long, n_tokens long, loss_tokens long, container long, segment long, place long")
    assert packing.violations(df).head().asDict() == {"items": 70, "torn": 1, "needless": 1, "over_capacity": 1, "over_segments": 1, "over_loss": 1, "misplaced": 1}


def test_items_that_fit_nothing(spark):
    # each takes a container of its own, by length or by loss: pools must not fill up with them
    df = spark.range(6000).selectExpr("id as doc_id", "cast(5000 + id % 3 as bigint) as n_tokens", "cast(0 as bigint) as loss_tokens")
    df = df.unionByName(spark.range(3000).selectExpr("id + 10000 as doc_id", "cast(7500 as bigint) as n_tokens", "cast(7400 as bigint) as loss_tokens")).coalesce(1)
    out = packing.fill(df, pool=500).groupBy("container").count()
    assert out.count() == 9000 and out.agg({"count": "max"}).head()[0] == 1


def test_found_is_by_length(spark, data):
    from rangeloom.llm import plans

    ids = plans.queries()["p7_ids"](spark, data).where(F.size("ids") > 8192).select("doc_id").collect()
    assert sorted(map(tuple, plans.queries()["p8_found"](spark, data).collect())) == sorted(map(tuple, ids))

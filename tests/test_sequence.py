import random

import pytest

from rangeloom.operators import points as pts
from rangeloom.operators import sequence as sq


def seq(spark, v, name="c"):
    return spark.createDataFrame(list(enumerate(v)), f"pos bigint, {name} bigint")


def bits(spark, v):
    return spark.createDataFrame([(i, bool(x)) for i, x in enumerate(v)], "pos bigint, bit boolean")


def test_golden_sequence(spark):
    v = [2, 7, 1, 7, 3, 0, 4, 4]
    at = {(r["c"], r["rank"]): r["pos"] for r in sq.symbol_ranks(seq(spark, v)).collect()}
    assert at == {(2, 0): 0, (7, 0): 1, (1, 0): 2, (7, 1): 3, (3, 0): 4, (0, 0): 5, (4, 0): 6, (4, 1): 7}
    ranges = [(b * 10 + e, b, e) for b in range(8) for e in range(b + 1, 9)]
    got = {r["qid"]: r for r in sq.extremes(seq(spark, v, "v"), spark.createDataFrame(ranges, "qid bigint, b bigint, e bigint")).collect()}
    for q, b, e in ranges:
        part = v[b:e]
        assert (got[q]["min"], got[q]["min_at"]) == (min(part), b + part.index(min(part)))
        assert (got[q]["max"], got[q]["max_at"]) == (max(part), b + part.index(max(part)))


def test_rank_all(spark):
    q = spark.createDataFrame([(0, 2, 1), (1, 2, 2), (2, 6, 8), (3, 0, 5), (4, 99, 100), (5, 3, 0)], "qid bigint, c bigint, p bigint")
    got = {r["qid"]: (r["less"], r["equal"], r["more"]) for r in sq.rank_all(seq(spark, [1, 2]), q).collect()}
    assert got[0] == (1, 0, 0) and got[1] == (1, 1, 0) and got[4] == (2, 0, 0) and got[5] == (0, 0, 0)
    nine = {r["qid"]: (r["less"], r["equal"], r["more"]) for r in sq.rank_all(seq(spark, range(1, 10)), q).collect()}
    assert nine[2] == (5, 1, 2)


@pytest.mark.parametrize("make", [lambda n: [1] * n, lambda n: [0] * n, lambda n: [i % 2 == 0 for i in range(n)], lambda n: [i % 3 < 2 for i in range(n)], lambda n: [i % 3 == 2 for i in range(n)]])
def test_bit_patterns(spark, make, monkeypatch):
    monkeypatch.setattr(sq, "SHARD", 16)
    v = make(100)
    ones = [i for i, x in enumerate(v) if x]
    for r in sq.bit_ranks(bits(spark, v)).collect():
        assert r["rank1"] == sum(map(bool, v[: r["pos"]])) and r["rank0"] == r["pos"] - r["rank1"]
    assert {r["r"]: r["pos"] for r in sq.select_bits(bits(spark, v)).collect()} == dict(enumerate(ones))
    for r in sq.next_bits(bits(spark, v)).collect():
        assert r["next1"] == next((i for i in ones if i >= r["pos"]), -1)
    e = {r["pos"]: r["excess"] for r in sq.excess(bits(spark, v)).collect()}
    assert all(e[i] == sum(1 if x else -1 for x in v[: i + 1]) for i in range(100))


@pytest.mark.parametrize("v", [[0] * 40, [1] * 40, [0, 1] * 20, list(range(40)), [7, 0, 0, 0, 12, 0, 3] * 6])
def test_prefix_sums(spark, v, monkeypatch):
    monkeypatch.setattr(sq, "SHARD", 8)
    assert {r["pos"]: r["psum"] for r in sq.prefix_sums(seq(spark, v, "v")).collect()} == {i: sum(v[:i]) for i in range(len(v))}
    targets = spark.createDataFrame([(t,) for t in range(0, sum(v) + 3)], "target bigint")
    sums = [sum(v[:i]) for i in range(len(v) + 1)]
    for r in sq.prefix_sum_rank(seq(spark, v, "v"), targets).collect():
        assert r["rank"] == next((i for i, s in enumerate(sums) if s >= r["target"]), len(v))


def test_runs_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(sq, "SHARD", 8)
    v = [3, 3, 3, 1, 1, 2] + [5] * 30 + [3]
    runs = sq.run_lengths(seq(spark, v, "v"))
    assert sorted(map(tuple, runs.select("pos", "v", "n").collect())) == [(0, 3, 3), (3, 1, 2), (5, 2, 1), (6, 5, 30), (36, 3, 1)]
    points = spark.createDataFrame([(i,) for i in range(len(v))], "pos bigint")
    assert {r["pos"]: r["v"] for r in sq.run_lookup(runs, points).collect()} == dict(enumerate(v))


def test_kth_and_boxes(spark):
    rng = random.Random(1)
    v = [rng.randrange(18) for _ in range(300)]
    ranges = [(i, *sorted(rng.sample(range(301), 2)), rng.randrange(40)) for i in range(50)]
    got = {r["qid"]: (r["value"], r["at"]) for r in sq.kth(seq(spark, v), spark.createDataFrame(ranges, "qid bigint, b bigint, e bigint, k bigint")).collect()}
    for q, b, e, k in ranges:
        part = sorted((x, i) for i, x in enumerate(v[b:e], b))
        want = (part[k][0], min(i for x, i in part if x == part[k][0])) if k < len(part) else (None, None)
        assert got[q] == want
    boxes = [(i, *(rng.randrange(-5, 320) for _ in range(2)), *(rng.randrange(-2, 22) for _ in range(2))) for i in range(50)]
    df = spark.createDataFrame(boxes, "qid bigint, x1 bigint, x2 bigint, y1 bigint, y2 bigint")
    counts = {r["qid"]: r["n"] for r in sq.box_count(seq(spark, v), df, "pos", "c").collect()}
    listed = [tuple(r) for r in sq.in_boxes(seq(spark, v), df, "pos", "c").collect()]
    for q, x1, x2, y1, y2 in boxes:
        inside = sorted((q, i, x) for i, x in enumerate(v) if min(x1, x2) <= i < max(x1, x2) and min(y1, y2) <= x < max(y1, y2))
        assert counts[q] == len(inside) and sorted(t for t in listed if t[0] == q) == inside


def test_golden_points(spark):
    xy = list(zip([0, 0, 1, 1, 4, 4, 3, 3, 5, 6], [0, 1, 0, 1, 4, 3, 4, 3, 3, 4]))
    p = spark.createDataFrame(xy, "x bigint, y bigint")
    ask = {(0, 0): 0, (1, 1): 1, (2, 2): 4, (4, 4): 5, (5, 4): 6, (4, 5): 6, (6, 4): 7, (7, 4): 7, (7, 5): 10}
    q = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(ask)], "qid bigint, qx bigint, qy bigint")
    assert [r["n"] for r in sq.dominance(p, q, "x", "y").orderBy("qid").collect()] == list(ask.values())
    grid = {(r["i"], r["j"]): r["n"] for r in pts.grid_count(p, [1, 4, 7], [1, 4, 5]).collect()}
    assert grid == {(i, j): sum(a < x and b < y for a, b in xy) for i, x in enumerate([1, 4, 7]) for j, y in enumerate([1, 4, 5])}
    assert sq.dominance(p.limit(0), q, "x", "y").agg({"n": "sum"}).head()[0] == 0


def test_heatmap(spark):
    rng = random.Random(3)
    xy = [(rng.randrange(40), rng.randrange(40)) for _ in range(500)]
    p = spark.createDataFrame(xy + [(None, 3)], "x bigint, y bigint")

    def edges(lo, hi, n):
        d, r = divmod(hi - lo, n)
        out = [lo]
        for i in range(n):
            out.append(out[-1] + d + (i < r))
        return out

    ex, ey = edges(3, 33, 7), edges(0, 40, 9)
    got = {(r["bx"], r["by"]): r["n"] for r in pts.heatmap(p, 3, 33, 0, 40, 7, 9).collect()}
    assert got == {(i, j): sum(ex[i] <= x < ex[i + 1] and ey[j] <= y < ey[j + 1] for x, y in xy) for i in range(7) for j in range(9)}
    with pytest.raises(ValueError):
        pts.heatmap(p, 0, 3, 0, 40, 4, 2)


def test_bit_layers(spark):
    v = [5, 1, 7, 3, 0, 6, 2, 4, 5]
    rows = sq.bit_layers(seq(spark, v), 3).orderBy("layer", "node", "idx").collect()
    by = {}
    for r in rows:
        by.setdefault(r["layer"], []).append(r["bit"])
    assert by[0] == [x >> 2 & 1 for x in v] and by[1] == [x >> 1 & 1 for x in sorted(v, key=lambda x: x >> 2)] and by[2] == [x & 1 for x in sorted(v, key=lambda x: x >> 1)]

"""Golden cases of a signal, and random signals against plain arrays."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.api import Track
from rangeloom.operators import signal as sg
from rangeloom.operators.joins import asof_join, overlap_join

SCHEMA = "chrom string, st bigint, ed bigint, val double"
FIRST = [("chr19", 2000 + 300 * i, 2300 + 300 * i, -1 + 0.25 * i) for i in range(9)]


def track(spark, rows):
    return Track(spark.createDataFrame(rows, SCHEMA))


def test_sums_and_counts(spark):
    t = track(spark, FIRST)
    assert t.at("chr19", 2100)["prefix_sum"] == -100
    assert t.at("chr19", 4700)["coverage"] == 2700
    assert [t.at("chr19", p)["started"] for p in (1999, 2000, 2299, 2300)] == [0, 1, 1, 2]
    assert sg.track_summary(t.signal).head()["last_position"] == 4700


def test_three_chroms(spark):
    rows = FIRST[:5] + [("chr20", 3500, 3800, 0.02), ("chr20", 3800, 4100, 0.5), ("chr20", 4100, 4400, 0.75), ("chr21", 4400, 4700, 1.0)]
    t = track(spark, rows)
    assert t.at("chr20", 3900)["prefix_sum"] == 56
    assert {r["chrom"]: r["intervals"] for r in sg.track_summary(t.signal).collect()} == {"chr19": 5, "chr20": 3, "chr21": 1}
    assert t.chrom_id("chr20") == 1 and t.chrom_id("chrX") == -1


def test_averages(spark):
    t = track(spark, [("chr1", 14769, 14776, -1.0), ("chr1", 14776, 14779, -2.0), ("chr1", 14779, 14781, -4.0)])
    assert t.summary("avg", "chr1", 14770, 14780, 2) == [-1.0, -2.2]
    assert t.summary("min", "chr1", 14770, 14780, 2) == [-1.0, -4.0]
    assert t.summary("max", "chr1", 14770, 14780, 2) == [-1.0, -1.0]
    assert t.summary("cov", "chr1", 14770, 14780, 2) == [5, 5]


def test_deviation_and_gap(spark):
    t = track(spark, [("chr1", 1, 2, 2.0), ("chr1", 2, 5, 4.0), ("chr1", 6, 8, 5.0), ("chr1", 8, 9, 7.0), ("chr1", 9, 10, 9.0)])
    r = t.region("chr1", 0, 10)
    assert (r["sum"], r["sqrsum"], r["stdev"], r["cov"], r["avg"]) == (40, 232, 2, 8, 5)
    assert t.summary("lst", "chr1", 5, 8) == [(6, 8, 5.0)]
    assert [t.at("chr1", p)["next"] for p in (5, 0, 10)] == [6, 1, -1]
    assert [t.at("chr1", p)["prev"] for p in (5, 0)] == [4, -1]
    assert t.interval("chr1", 2) == {"st": 6, "ed": 8, "val": 5.0, "annotation": ""} and t.interval("chr1", 5) is None
    with pytest.raises(ValueError):
        t.summary("avg", "chr1", 5, 5)
    assert t.region("chr9", 0, 10)["sum"] == 0 and t.region("chr9", 0, 10)["avg"] is None


def dense_case(v):
    return [("c", i, i + 1, float(x)) for i, x in enumerate(v) if x]


@pytest.mark.parametrize("v", [[1, 1, 1, 0, 0, 9, 9, 2, 2, 2, 3], [0, 0, 0, 2, 2, 0, 3, 3, 0, 4, 5, 0, 0, 0]])
def test_dense(spark, v):
    s = sg.merged_equal(spark.createDataFrame(dense_case(v), SCHEMA)).drop("n")
    points = spark.createDataFrame([("c", p) for p in range(len(v) + 1)], "chrom string, pos bigint")
    for r in sg.at_positions(s, points).collect():
        p = r["pos"]
        assert r["value"] == (v[p] if p < len(v) else 0)
        assert r["prefix_sum"] == sum(v[:p]) and r["coverage"] == sum(x != 0 for x in v[:p])
        assert r["next"] == next((i for i in range(p, len(v)) if v[i]), -1)
        assert r["prev"] == next((i for i in range(min(p, len(v) - 1), -1, -1) if v[i]), -1)
    back = sg.dense(s).orderBy("pos").collect()
    assert [(r["pos"], r["v"]) for r in back] == [(i, x) for i, x in enumerate(v) if x]


def naive_edges(st, ed, n):
    length, out, pos, sl = ed - st, [st], st, 0
    dt, r = divmod(length, n)
    for _ in range(n):
        if sl + (n - r) <= r:
            sl += 2 * (n - r)
            pos += dt + 1
        else:
            sl -= 2 * r
            pos += dt
        out.append(pos)
    return out


def test_random_signal(spark):
    rng = random.Random(5)
    size, v, p = 3000, [None] * 3000, 40
    rows = []
    while p < size - 60:
        n = rng.randint(1, 30)
        x = rng.choice([0.0, -1.5, 2.25, 7.125, -0.001])
        rows.append(("c", p, p + n, x))
        v[p : p + n] = [x] * n
        p += n + rng.choice([0, 0, 1, 25])
    signal = spark.createDataFrame(rows, SCHEMA)
    regions = [(i, "c", *sorted(rng.sample(range(size), 2)), rng.choice([1, 3, 7, 50])) for i in range(60)]
    regions += [(100, "c", 0, size, 13), (101, "c", 0, 5, 2), (102, "c", size - 5, size, 3), (103, "c", rows[3][2], rows[3][2] + 1, 4), (104, "c", 500, 507, 7), (105, "c", 500, 507, 20), (106, "x", 1, 9, 2)]
    got = {(r["region_id"], r["bin"]): r for r in sg.window_summary(signal, spark.createDataFrame(regions, "region_id bigint, chrom string, st bigint, ed bigint, n bigint")).collect()}
    count = 0
    for i, chrom, st, ed, n in regions:
        base = v if chrom == "c" else [None] * size
        if ed - st > n:
            e = naive_edges(st, ed, n)
            for b in range(n):
                r, part = got[i, b], [x for x in base[e[b] : e[b + 1]] if x is not None]
                assert r["cov"] == len(part) and math.isclose(r["sum"], sum(part), abs_tol=1e-9)
                assert r["min_or_null"] == min(part, default=None) and r["max_or_null"] == max(part, default=None)
                assert r["started"] == sum(e[b] < s <= e[b + 1] for c, s, _, _ in rows if c == chrom)
                if part:
                    m = sum(part) / len(part)
                    assert math.isclose(r["avg"], m, abs_tol=1e-9)
                    assert math.isclose(r["stdev"], math.sqrt(sum((x - m) ** 2 for x in part) / len(part)), abs_tol=1e-6)
                else:
                    assert r["avg"] is None and r["stdev"] is None and r["min"] == 0
        else:
            e = naive_edges(0, n, ed - st)
            for k in range(ed - st):
                for b in range(e[k], e[k + 1]):
                    assert got[i, b]["avg"] == base[st + k] and got[i, b]["cov"] == (base[st + k] is not None)
        count += n
    assert count == len(got)


def test_overlap_join_random(spark):
    rng = random.Random(2)
    make = lambda n: [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 5, 400])) for i in range(n) for s in [rng.randrange(1000)]]
    a, b = make(80) + [(99, None, 1, 5), (98, "a", None, 5)], make(80) + [(99, None, 1, 5)]
    left, right = (spark.createDataFrame(x, "id bigint, chrom string, st bigint, ed bigint") for x in (a, b))
    want = {(x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and None not in x and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]}
    for width in (8, 64, 1 << 14):
        rows = [(r["id"], r["r_id"]) for r in overlap_join(left, right, width=width).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        semi = {r["id"] for r in overlap_join(left, right, how="left_semi", width=width).collect()}
        anti = sorted(r["id"] for r in overlap_join(left, right, how="left_anti", width=width).collect())
        assert semi == {x for x, _ in want} and anti == sorted({x[0] for x in a} - semi)
    with pytest.raises(ValueError):
        overlap_join(left.withColumn("r_id", F.lit(1)), right)
    assert overlap_join(left.limit(0), right).count() == 0


def test_asof_random(spark):
    rng = random.Random(3)
    at = sorted(rng.sample(range(5000), 60))
    rows = spark.createDataFrame([("k", x, i) for i, x in enumerate(at)] + [(None, 2, 7), ("k", None, 8)], "k string, at bigint, i bigint")
    points = spark.createDataFrame([("k", p) for p in range(-5, 5100, 7)] + [("k", at[4]), ("z", 3), (None, 3), ("k", None)], "k string, pos bigint")
    for width in (16, 1 << 16):
        for ahead in (False, True):
            out = asof_join(points, rows, ["k"], "pos", "at", "hit", ahead, width).collect()
            assert len(out) == points.count()
            for r in out:
                hits = [x for x in at if (x > r["pos"] if ahead else x <= r["pos"])] if r["k"] == "k" and r["pos"] is not None else []
                assert (r["hit"]["at"] if r["hit"] else None) == ((hits[0] if ahead else hits[-1]) if hits else None)


def test_violations(spark):
    df = spark.createDataFrame([(1, "c", 0, 5), (1, "c", 5, 9), (1, "c", 8, 10), (1, "c", 12, 12), (None, "c", 1, 4), (None, "c", 1, 4), (1, None, 1, 2)], "track_id bigint, chrom string, st bigint, ed bigint")
    assert {(r[0], r[2], r[4]) for r in sg.overlap_violations(df).collect()} == {(1, 8, "overlap"), (1, 12, "empty"), (None, 1, "overlap")}

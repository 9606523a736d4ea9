"""Problems on intervals, skew, grids and failing lines: small cases with nulls, ties, empty tables and clashing columns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import coverage, grid, skew
from rangeloom.sources import interval_text

IV = "track_id bigint, chrom string, st bigint, ed bigint, val double"


def naive(rows):
    by = {}
    for t, c, s, e, *_ in rows:
        if s is not None and e is not None and s < e:
            by.setdefault((t, c), []).append((s, e))
    out = {}
    for k, v in by.items():
        v.sort()
        periods = [[*v[0], False]]
        for s, e in v[1:]:
            p = periods[-1]
            if s <= p[1]:
                p[2] = p[2] or s < p[1]
                p[1] = max(p[1], e)
            else:
                periods.append([s, e, False])
        out[k] = [tuple(p) for p in periods]
    return out


@pytest.mark.parametrize("width", [4, 64, 1 << 16])
def test_periods(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), s, s + rng.choice([-3, 0, 1, 2, 9, 150]), 1.0) for s in (rng.randrange(-500, 2500) for _ in range(400))]
    rows += [(1, "a", None, 5, 1.0), (1, "a", 5, None, 1.0), (7, "z", 0, 100_000, None), (7, "z", 0, 100_000, None), (7, "z", 100_000, 100_001, 1.0), (8, "z", 3, 4, 1.0)]
    df = spark.createDataFrame(rows, IV).withColumns({"_k": F.lit(1), "shard": F.lit(2), "pos": F.lit(3), "_p": F.lit("x")})
    got = {}
    for r in coverage.periods_and_gaps(df, shard_width=width).collect():
        got.setdefault((r["track_id"], r["chrom"]), []).append(r)
    want = naive(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        g = sorted(got[k], key=lambda r: r["st"])
        assert [(r["st"], r["ed"], r["multi"]) for r in g] == v
        assert [r["gap_ed"] for r in g] == [p[0] for p in v[1:]] + [None]


def test_periods_one_hot_entity(spark):
    df = spark.range(200_000).select(F.lit(1).cast("bigint").alias("track_id"), F.lit("a").alias("chrom"), (F.col("id") % 50_000 * 3).alias("st"), (F.col("id") % 50_000 * 3 + 2).alias("ed"))
    r = coverage.periods_and_gaps(df).agg(F.count("*"), F.sum("ed") - F.sum("st"), F.count_if("multi"), F.count("gap_ed")).head()
    assert tuple(r) == (50_000, 100_000, 50_000, 49_999)


def test_periods_empty(spark):
    df = spark.createDataFrame([], IV)
    assert coverage.found(df).collect() == [] and coverage.covered_periods(df).collect() == []


def test_heavy_keys(spark):
    rows = [("h",)] * 300 + [("m",)] * 50 + [(None,)] * 30 + [(f"k{i}",) for i in range(620)]
    df = spark.createDataFrame(rows, "chrom string").repartition(7)
    assert {(r["chrom"], r["n"]) for r in skew.heavy_keys(df).collect()} == {("h", 300), ("m", 50)}
    assert {r["chrom"] for r in skew.heavy_keys(df, share=0.3).collect()} == {"h"}
    assert skew.heavy_keys(df.limit(0)).collect() == []
    for of, want in ((0.05, {("h", 300), ("m", 50)}), (0.3, {("h", 300)})):
        got = skew.heavy_profiles(df.select("chrom", F.lit(1).alias("st"), F.lit(2).alias("ed"), F.lit(0.5).alias("val")), of=of)
        assert {(r["chrom"], r["rows"]) for r in got.collect()} == want


def test_profile(spark):
    rng = random.Random(1)
    rows = [(1, rng.choice(["h"] * 8 + [f"k{i}" for i in range(30)]), s, s + rng.choice([-1, 0, 3, 40]), rng.choice([None, math.nan, 0.5, -2.0, 3.125])) for s in (rng.randrange(900) for _ in range(500))]
    rows += [(1, None, 1, 2, 1.0), (1, "k1", None, 3, 2.0), (1, "only", None, None, None)]
    df = spark.createDataFrame(rows, IV).withColumns({"_k": F.lit(0), "rows": F.lit(0), "covered": F.lit(9)})
    got = {r["chrom"]: r for r in skew.key_profile(df).collect()}
    assert set(got) == {r[1] for r in rows if r[1]}
    for k, g in got.items():
        own = [r for r in rows if r[1] == k]
        v = [r[4] for r in own if r[4] is not None and not math.isnan(r[4])]
        covered = {p for r in own if r[2] is not None and r[3] is not None for p in range(r[2], r[3])}
        assert (g["rows"], g["covered"], g["valued"]) == (len(own), len(covered), len(v))
        assert g["val_sum"] == (sum(v) if v else None) and g["val_min"] == min(v, default=None)
    assert skew.key_profile(df.limit(0)).collect() == []


def test_grid(spark):
    rng = random.Random(4)
    rows = [(t, rng.choice(["a", "b"]), s, s + rng.choice([0, 1, 30, 700]), rng.choice([None, math.nan, 1.0, 2.0])) for t in (1, 2, None) for s in (rng.randrange(40_000) for _ in range(12))]
    rows += [(3, "a", 5, 6, 1.0), (4, None, 5, 6, 1.0), (1, "a", 30_000_000, 30_000_001, 4.0), (9, "a", 1, 2, 1.0)]
    steps = spark.createDataFrame([(1, 10), (2, 100), (3, 7), (4, 5), (5, 0), (9, None)], "track_id bigint, step bigint")
    df = spark.createDataFrame(rows, IV).withColumns({"cell": F.lit(0), "_sh": F.lit(0), "step": F.lit(0), "before": F.lit(0)})
    step_of, filled = {1: 10, 2: 100, 3: 7, 4: 5}, {}
    for t, c, s, e, v in rows:
        if t in step_of and c and s < e and v is not None and not math.isnan(v):
            for k in range(s // step_of[t], (e - 1) // step_of[t] + 1):
                filled.setdefault((t, c), set()).add(k)
    missing = {(*k, x * step_of[k[0]]) for k, f in filled.items() for x in range(min(f), max(f)) if x not in f}
    got = [tuple(r) for r in grid.missing_cells(df, steps).collect()]
    assert len(got) == len(set(got)) and set(got) == missing
    s = grid.regular_series(df, steps).where("track_id = 2").orderBy("chrom", "cell_st").collect()
    last = {}
    for r in s:
        k = (r["track_id"], r["chrom"])
        if r["filled"]:
            assert r["val"] == last[k][0] and r["age"] == (r["cell_st"] - last[k][1]) // 100
        else:
            last[k] = (r["val"], r["cell_st"])
    assert grid.missing_cells(df.limit(0), steps).collect() == []


LINES = [
    ("c1\t1\t5\t1.5", None), ("c1\t1\t5\t1.5\tnote", None), ("c1\t1\t5\t-.5e3\t\r", None), ('"c1"\t1\t5\t"2."\t"a\tb ""q"""', None), (" c1 \t 1\t5 \t1\t x ", None), ("c1\t0001\t5\t+0\t" + "x" * 200_000, None),
    ('c1\t1\t5\t1\tx"y', "quoting"), ('c1\t1\t5\t1\t"open', "quoting"), ('"c1"x\t1\t5\t1', "quoting"), ('"', "quoting"),
    ("c1\t1\t5", "column_count"), ("c1 1 5 2", "column_count"), ("c1\t1\t5\t1\ta\t", "column_count"), ("x", "column_count"),
    ("C1\t1\t5\t1", "chrom"), ("\t1\t5\t1", "chrom"), ('" c1"\t1\t5\t1', "chrom"), ("nope\tx\ty\tz", "chrom"), ("c1 \t1\t5\t1", "chrom"),
    ("c1\t5\t5\t1", "position"), ("c1\t1\t101\t1", "position"), ("c1\t-1\t5\t1", "position"), ("c1\t1\t99999999999999999999\t1", "position"), ("c1\t\t5\t1", "position"), ("c1\t1\t5.0\tx", "position"), ("c1\t1\t٥\t1", "position"),
    ("c1\t1\t5\t", "val"), ("c1\t1\t5\tNaN", "val"), ("c1\t1\t5\t1,5", "val"), ("c1\t1\t5\t0x1", "val"), ("c1\t1\t5\t.", "val"), ("c1\t1\t5\t1d", "val"), ("c1\t1\t5\t1e", "val"), ("c1\t1\t5\t1 ", "val"), ("c1\t1\t5\t1\n", "val"),
]
NO_ROWS = [None, "", " \t\r", "# x", "  #", "track", "track name=1", "\tbrowser position", "track\r"]


def test_lines(spark):
    all_ = [(i, x) for i, (x, _) in enumerate(LINES)] + [(1000 + i, x) for i, x in enumerate(NO_ROWS)] + [(2000, "tracks\t1\t5\t1"), (2001, " ")]
    df = spark.createDataFrame(all_, "line_id bigint, line string").withColumns({"chrom": F.lit("q"), "raw": F.lit("q"), "_f": F.lit(1), "st": F.lit(1)})
    sizes = spark.createDataFrame([("c1", 100, "k")], "chrom string, chrom_len bigint, chrom_class string")
    got = {r["line_id"]: r for r in interval_text.classify(df, sizes).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {i: why for i, (_, why) in enumerate(LINES)} | {2000: "chrom", 2001: "column_count"}
    assert got[0]["annotation"] is None and got[1]["annotation"] == "note" and got[2]["annotation"] == "" and got[3]["annotation"] == 'a\tb "q"' and got[4]["annotation"] == "x"
    assert (got[3]["chrom"], got[3]["val"], got[2]["val"], got[5]["st"]) == ("c1", 2.0, -500.0, 1) and len(got[5]["annotation"]) == 200_000
    assert interval_text.valid_rows(df, sizes).count() + interval_text.failing_lines(df, sizes).count() == len(got)
    assert interval_text.classify(df.limit(0), sizes).collect() == []
    with pytest.raises(ValueError):
        interval_text.classify(df, sizes, keep=("line_id", "chrom"))


def test_one_reading_over_very_many_cells(spark):
    df = spark.createDataFrame([(1, "c", 0, 1_000_000, 2.0), (1, "c", 1_000_003, 1_000_004, 4.0)], "track_id bigint, chrom string, st bigint, ed bigint, val double")
    steps = spark.createDataFrame([(1, 1)], "track_id bigint, step bigint")
    each = grid.cells(df, steps)
    assert each.agg(F.count(F.lit(1)), F.max("cell")).head() == (1_000_001, 1_000_003)

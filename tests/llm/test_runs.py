import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import runs

SCHEMA = "track_id bigint, chrom string, st bigint, ed bigint, val double"


def naive(rows):
    events = {}
    for t, c, s, e, v in rows:
        if s is not None and e is not None:
            v = None if v is None or math.isnan(v) else v
            old = events.get((t, c, s, e))
            events[t, c, s, e] = v if old is None else old if v is None else min(old, v)
    out, last = [], None
    for (t, c, s, e), v in sorted(events.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] is None, x[0][1] or "", *x[0][2:])):
        if last and last[0] == (t, c) and None not in (v, last[3]) and abs(v - last[3]) < 0.0025 and s <= last[2] + 100:
            out[-1][3:5] = [e, out[-1][4] + 1]
        else:
            out.append([t, c, s, e, 1, v is not None])
        last = ((t, c), s, e, v)
    return {tuple(x) for x in out}


@pytest.mark.parametrize("width", [64, 1 << 16])
def test_runs(spark, width):
    rng = random.Random(width)
    rows = []
    for t, c in [(1, "a"), (1, "b"), (None, "a"), (2, None)]:
        p = 0
        for _ in range(200):
            p += rng.choice([0, 0, 50, 100, 101, 300])
            n = rng.randint(1, 60)
            rows += [(t, c, p, p + n, rng.choice([1.0, 1.002, 1.003, None, math.nan]))] * rng.choice([1, 1, 2])
            p += n
    rows += [(1, "a", None, 4, 1.0), (1, "a", 4, None, 1.0), (3, "z", 1, 2, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_k": F.lit(0), "_s": F.lit(0), "n": F.lit("x"), "run_st": F.lit(0)})
    got = runs.collapse(df, shard_width=width).collect()
    assert {(r["track_id"], r["chrom"], r["run_st"], r["run_ed"], r["n"], r["valued"]) for r in got} == naive(rows) and len(got) == len(naive(rows))
    assert all(r["length"] == r["run_ed"] - r["run_st"] for r in got)


def test_empty(spark):
    assert runs.collapse(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_hot_sequence(spark):
    df = spark.range(300_000).select(F.lit(1).cast("bigint").alias("track_id"), F.lit("a").alias("chrom"), (F.col("id") * 10).alias("st"), (F.col("id") * 10 + 10).alias("ed"), F.floor(F.col("id") / 1000).cast("double").alias("val"))
    r = runs.collapse(df).agg(F.count("*"), F.min("n"), F.max("n"), F.sum("length")).head()
    assert tuple(r) == (300, 1000, 1000, 3_000_000)

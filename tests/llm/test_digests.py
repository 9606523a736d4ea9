import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import digests

SCHEMA = "track_id bigint, chrom string, val double"


def exact(v, q):
    return np.sort(v)[max(1, -(-len(v) * q // 100)) - 1]


def test_bounds_and_errors(spark):
    rng = np.random.default_rng(0)
    parts = {"normal": rng.normal(size=30_000), "ties": rng.integers(0, 4, 20_000).astype(float), "wide": rng.lognormal(0, 4, 25_000), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in parts.items() for x in v] + [("none", None), ("none", math.nan)], "chrom string, val double").repartition(9)
    got = {r["chrom"]: r for r in digests.percentiles(digests.digest(df, ["chrom"]), ["chrom"]).collect()}
    assert set(got) == set(parts)
    cert = {r["chrom"]: r for r in digests.certified(df, ["chrom"]).collect()}
    for k, v in parts.items():
        for q in (50, 90, 95, 99):
            assert got[k][f"lo{q}"] <= exact(v, q) <= got[k][f"hi{q}"] and got[k]["n"] == len(v)
            p, r = cert[k][f"p{q}"], max(1, -(-len(v) * q // 100))
            lt, le = (v < p).sum(), (v <= p).sum()
            assert math.isclose(cert[k][f"err{q}"], max(0, r - le, lt + 1 - r) / len(v), abs_tol=1e-12)
            assert cert[k][f"err{q}"] <= np.pi / digests.DELTA
    assert cert["few"]["p50"] == 2.0 and cert["ties"]["err50"] == 0


def test_days_combine(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=8000)
    df = spark.createDataFrame([("a", i % 7, float(x)) for i, x in enumerate(v)], "chrom string, day int, val double")
    both = digests.percentiles(digests.merge(digests.digest(df, ["chrom", "day"]), ["chrom"]), ["chrom"]).head()
    for q in (50, 95):
        assert both["n"] == 8000 and both[f"lo{q}"] <= exact(v, q) <= both[f"hi{q}"]
        assert abs((v <= both[f"p{q}"]).mean() - q / 100) < 0.02


@pytest.mark.parametrize("delta", [200, 20, 8])
def test_skewed_is_exact(spark, delta):
    rng = np.random.default_rng(delta)
    rows, want = [], set()
    for t in range(60):
        n = int(rng.integers(20, 400))
        v = np.round(rng.lognormal(0, 1.1, n), 1) * rng.choice([1, 1, -1]) + rng.choice([0, 0, -0.5])
        if n >= 30 and exact(v, 50) > 0 and exact(v, 95) >= 6 * exact(v, 50):
            want.add((t if t else None, "c"))
        rows += [(t if t else None, "c", float(x)) for x in v] + [(t if t else None, "c", None), (t if t else None, "c", math.nan)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_v": F.lit("x"), "digest": F.lit(0), "n": F.lit(1)}).repartition(5)
    got = [tuple(r) for r in digests.skewed(df, delta=delta).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_exact_ranks_after_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(digests, "ROUNDS", 0)
    v = [float(x) for x in range(1, 101)] + [1000.0] * 10
    df = spark.createDataFrame([(1, "c", x) for x in v], SCHEMA)
    assert exact(np.array(v), 50) == 55 and exact(np.array(v), 95) == 1000
    assert digests.skewed(df, delta=8, factor=18.0).count() == 1 and digests.skewed(df, delta=8, factor=18.2).count() == 0


def test_empty_and_hot(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert digests.skewed(df).collect() == [] and digests.certified(df, ["chrom"]).collect() == []
    hot = spark.range(900_000).select(F.lit("h").alias("chrom"), (F.col("id") % 1000).cast("double").alias("val"))
    r = digests.certified(hot, ["chrom"]).head()
    assert r["n"] == 900_000 and all(r[f"err{q}"] < np.pi / digests.DELTA for q in (50, 90, 95, 99))


def test_keys_beyond_the_broadcast(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("chrom"), (F.col("id") * 7919 % 5000).cast("double").alias("val"))
    want = sorted(map(tuple, digests.certified(df, ["chrom"], delta=20).collect()))
    monkeypatch.setattr(digests, "KNOWN", 0)
    assert sorted(map(tuple, digests.certified(df, ["chrom"], delta=20).collect())) == want
    assert [r["within"] for r in digests.bounded(df, ["chrom"], delta=20).collect()] == [True] * 3


def test_merge_gathers_more_than_once(spark):
    """More digests in one task than it gathers at once; keys go on from one gathering to the next."""
    n, many = 24_000, 40
    df = spark.range(n * many, numPartitions=8).select((F.col("id") % n).alias("track_id"), F.lit("c").alias("chrom"), F.floor(F.col("id") / n).cast("double").alias("val"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        made = digests.digest(df, ["track_id", "chrom"])
        got = digests.percentiles(made, ["track_id", "chrom"]).groupBy("n", "lo50", "hi50", "lo95", "hi95").count().collect()
        assert [tuple(r) for r in got] == [(many, 19.0, 19.0, 37.0, 37.0, n)]
        again = digests.percentiles(digests.merge(made.select("digest", "chrom", F.coalesce("track_id", F.lit(0)).alias("track_id")), ["chrom"]), ["chrom"]).head()
        assert again["n"] == n * many and again["lo50"] <= 19 <= again["hi50"] and again["lo95"] <= 37 <= again["hi95"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merge_of_batches_in_any_order_of_columns(monkeypatch):
    """A key whose digests lie in several gatherings comes out once, in columns that may not be null too."""
    monkeypatch.setattr(digests, "GATHER", 1)
    values = [np.arange(5 * i, 5 * i + 5, dtype=float) for i in range(6)]
    blobs = [digests.Centroids.of_values(np.zeros(5, np.int64), v).packed(1)[0] for v in values]
    schema = pa.schema([pa.field("chrom", pa.string(), False), pa.field("digest", pa.binary()), pa.field("_salt", pa.int32(), False)])
    chrom, salt = ["a", "a", "a", "b", "b", "c"], [0, 0, 1, 1, 1, 1]
    batches = [pa.RecordBatch.from_arrays([pa.array([c]), pa.array([b]), pa.array([s], pa.int32())], schema=schema) for c, b, s in zip(chrom, blobs, salt)]
    out = [r for b in digests._merge(["chrom", "_salt"], 200)(iter(batches)) for r in b.to_pylist()]
    assert [(r["chrom"], r["_salt"], digests.unpack(r["digest"])[0].tolist()) for r in out] == [
        ("a", 0, list(range(10))), ("a", 1, list(range(10, 15))), ("b", 1, list(range(15, 25))), ("c", 1, list(range(25, 30)))
    ]


@pytest.mark.parametrize("rounds", [0, 4])
def test_every_error_within_the_bound(spark, monkeypatch, rounds):
    """Means of uneven centroids, whose ranks are two off in about a hundred: more than pi / delta."""
    monkeypatch.setattr(digests, "ROUNDS", rounds)
    parts = {}
    for seed in (267, 2144, 1):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(80, 127))
        parts[str(seed)] = np.round(rng.lognormal(0, 2, n), 3)
    df = spark.createDataFrame([(k, float(x)) for k, v in parts.items() for x in v], "chrom string, val double").coalesce(1)
    cert = {r["chrom"]: r for r in digests.certified(df, ["chrom"]).collect()}
    assert set(cert) == set(parts)
    for k, v in parts.items():
        for q in (50, 90, 95, 99):
            p, rank = cert[k][f"p{q}"], max(1, -(-len(v) * q // 100))
            err = max(0, rank - (v <= p).sum(), (v < p).sum() + 1 - rank) / len(v)
            assert math.isclose(cert[k][f"err{q}"], err, abs_tol=1e-12) and err <= math.pi / digests.DELTA
    assert sorted(map(tuple, digests.bounded(df, ["chrom"]).collect())) == sorted((k, len(v), True) for k, v in parts.items())

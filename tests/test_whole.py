"""Queries that once answered a part of their job only, against SQL of the whole job over the same tables."""

import pytest

from rangeloom.operators import signal as sg
from rangeloom.plans import files, sequences, signals, trees

from .oracle import assert_same, views

SEQ = "WITH q AS (SELECT p_partkey pos, p_size::BIGINT c FROM part), g AS (SELECT p_partkey qid, p_partkey b, p_partkey + 150 e, p_partkey % 60 k FROM part)"
RANGES = {
    "seq_kth": SEQ + ', o AS (SELECT qid, k, c, pos, row_number() OVER (PARTITION BY qid ORDER BY c, pos) - 1 i FROM g JOIN q ON pos >= b AND pos < e), v AS (SELECT qid, c FROM o WHERE i = k) SELECT g.qid, v.c AS "value", min(o.pos) AS at FROM g LEFT JOIN v ON g.qid = v.qid LEFT JOIN o ON o.qid = v.qid AND o.c = v.c GROUP BY ALL',
    "seq_minmax": SEQ + " SELECT qid, min(c) AS min, arg_min(pos, c * 1000000000 + pos) AS min_at, max(c) AS max, arg_min(pos, -c * 1000000000 + pos) AS max_at FROM g LEFT JOIN q ON pos >= b AND pos < e GROUP BY qid",
    "seq_box_count": SEQ + " SELECT qid, count(pos) AS n FROM g LEFT JOIN q ON pos >= b AND pos < e AND c >= k AND c < k + 17 GROUP BY qid",
    "seq_box_list": SEQ + " SELECT qid, pos, c FROM g JOIN q ON pos >= b AND pos < e AND c >= k AND c < k + 17",
}


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(RANGES))
def test_ranges_from_every_position(spark, data, con, name):
    df = sequences.queries()[name](spark, data)
    assert_same(df, con, RANGES[name])
    if name != "seq_box_list":
        assert df.count() == con.execute("SELECT count(*) FROM part").fetchone()[0]


OVERLAPS = """
WITH e AS (SELECT track_id, chrom, st, ed, count(*) n FROM bed_signal WHERE st IS NOT NULL AND ed IS NOT NULL AND chrom IS NOT NULL GROUP BY ALL),
l AS (SELECT *, max(ed) OVER (PARTITION BY track_id, chrom ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM e),
p AS (SELECT track_id, chrom, st, ed, CASE WHEN ed <= st THEN 'empty' WHEN p > st OR n > 1 THEN 'overlap' END problem FROM l) SELECT * FROM p WHERE problem IS NOT NULL"""


@pytest.mark.parametrize("width", [16, 1 << 16])
def test_nested_overlaps(spark, width, monkeypatch):
    monkeypatch.setattr(sg, "SHARD", width)
    rows = [(1, "c", 0, 100), (1, "c", 10, 20), (1, "c", 50, 60), (1, "c", 100, 110), (2, "c", 50, 60)]
    df = spark.createDataFrame(rows, "track_id bigint, chrom string, st bigint, ed bigint")
    assert {tuple(r) for r in sg.overlap_violations(df).collect()} == {(1, "c", 10, 20, "overlap"), (1, "c", 50, 60, "overlap")}


def test_validate_overlap(spark, data, con):
    assert_same(signals.queries()["validate_overlap"](spark, data), con, OVERLAPS)


def test_grid_and_heatmap_hold_every_point(spark, data, con):
    p = con.execute("SELECT l_partkey, l_suppkey FROM lineitem").fetchall()
    (x1, x2), (y1, y2) = ((min(v), max(v) + 1) for v in zip(*p))
    ex, ey = ([lo + (hi - lo) * (i + 1) // n for i in range(n)] for lo, hi, n in ((x1, x2, 8), (y1, y2, 7)))
    got = {(r["i"], r["j"]): r["n"] for r in sequences.queries()["grid_count"](spark, data).collect()}
    assert got == {(i, j): sum(x < a and y < b for x, y in p) for i, a in enumerate(ex) for j, b in enumerate(ey)}
    assert got[7, 6] == len(p)
    heat = {(r["bx"], r["by"]): r["n"] for r in sequences.queries()["heatmap"](spark, data).collect()}
    assert set(heat) == {(i, j) for i in range(17) for j in range(9)} and sum(heat.values()) == len(p)


def test_small_extents(spark):
    for rows in ([], [(5, 7), (6, 7), (None, 3)]):
        p = spark.createDataFrame(rows, "x bigint, y bigint")
        n = sum(None not in r for r in rows)
        assert sequences.heat(p).agg({"n": "sum"}).head()[0] == n and sequences.grid(p).agg({"n": "max"}).head()[0] == n


LENGTHS = signals.SIGNAL + """, z AS (SELECT chrom, sum(ed - st) cv, max(ed) le FROM s GROUP BY 1),
q AS (SELECT region_id, which, pt.chrom, CASE WHEN le > 0 THEN (pos::HUGEINT * cv // le)::BIGINT ELSE pos END pos FROM pt LEFT JOIN z ON pt.chrom = z.chrom)
SELECT region_id, which, q.chrom, pos, coalesce(idx + 1, 0) AS idx FROM q ASOF LEFT JOIN c ON q.chrom = c.chrom AND pos > cov0"""


def test_lengths_over_all_covered_bases(spark, data, con):
    df = signals.queries()["find_rlen"](spark, data)
    assert_same(df, con, LENGTHS)
    total = dict(con.execute(signals.SIGNAL + " SELECT chrom, sum(ed - st)::BIGINT FROM s GROUP BY 1").fetchall())
    far = {r["chrom"]: r["far"] for r in df.groupBy("chrom").agg({"pos": "max"}).toDF("chrom", "far").collect() if r["chrom"] in total}
    assert far and all(n >= total[c] - 1 for c, n in far.items())


def test_second_node_from_all_suppliers(spark, tmp_path):
    # 30 suppliers, 3 nations, 2 regions; only drawing from the first ten would miss the nation of the others
    at = lambda name: str(tmp_path / f"{name}.parquet")
    spark.createDataFrame([(0,), (1,)], "r_regionkey bigint").write.parquet(at("region"))
    spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "n_nationkey bigint, n_regionkey bigint").write.parquet(at("nation"))
    nation = lambda k: k // 10
    spark.createDataFrame([(k * 2, nation(k)) for k in range(30)], "s_suppkey bigint, s_nationkey bigint").write.parquet(at("supplier"))
    want = {}
    for k in range(30):
        o = (k * 31 + 7) % 30
        a, b = nation(k), nation(o)
        want[k * 2] = 1000000 + 2 * k if k == o else 1000 + a if a == b else 0 if {a, b} == {0, 1} else None
    assert {r["qid"]: r["lca"] for r in trees.queries()["lca_hierarchy"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["workload", "workload_fixed"])
def test_workload_size(spark, data, name):
    assert files.queries()[name](spark, data).count() == 50_000

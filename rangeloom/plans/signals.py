"""Queries on the composite signal of bed_signal and the regions of query_regions; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as sg
from ..operators.joins import overlap_join
from ..operators.sharding import join_on
from ..tables import stored, table, written

SIGNAL = """
WITH once AS (SELECT track_id, chrom, st, ed, min(CAST(round(val * 1000) AS BIGINT)) u FROM bed_signal
              WHERE chrom IS NOT NULL AND st < ed AND val IS NOT NULL AND NOT isnan(val) GROUP BY ALL),
ev AS (SELECT chrom, p, sum(u)::BIGINT u, sum(d)::BIGINT d FROM (SELECT chrom, st p, u, 1 d FROM once UNION ALL SELECT chrom, ed, -u, -1 FROM once) GROUP BY ALL),
lv AS (SELECT chrom, p st, lead(p) OVER w ed, sum(u) OVER w u, sum(d) OVER w d FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY p)),
s AS (SELECT chrom, st, ed, u::BIGINT u, u / 1000.0::DOUBLE val FROM lv WHERE d > 0),
c AS (SELECT *, row_number() OVER w - 1 idx, coalesce(sum(ed - st) OVER b, 0)::BIGINT cov0, coalesce(sum(u * (ed - st)) OVER b, 0)::BIGINT sum0,
             coalesce(sum(u::HUGEINT * u * (ed - st)) OVER b, 0)::HUGEINT sqr0
      FROM s WINDOW w AS (PARTITION BY chrom ORDER BY st), b AS (PARTITION BY chrom ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
qr AS (SELECT region_id, chrom, st, ed, n FROM query_regions UNION ALL SELECT 1000000000 + row_number() OVER (ORDER BY chrom), chrom, 0, chrom_len, 500 FROM chrom_sizes),
r AS (SELECT * FROM qr WHERE chrom IS NOT NULL AND st < ed),
wd AS (SELECT * FROM r WHERE n >= 1 AND ed - st > n), nr AS (SELECT * FROM r WHERE n >= 1 AND ed - st <= n),
eb AS (SELECT region_id, chrom, bin, st + (2 * (ed - st) * bin + n) // (2 * n) bin_st, st + (2 * (ed - st) * (bin + 1) + n) // (2 * n) bin_ed FROM (SELECT *, unnest(range(n)) bin FROM wd)),
sl AS (SELECT region_id, chrom, bin, st + ((ed - st) * (2 * bin + 1) - 1) // (2 * n) base FROM (SELECT *, unnest(range(n)) bin FROM nr)),
pt AS (SELECT region_id, unnest([0, 1, 2]) which, chrom, unnest([st, ed, (st + ed) // 2]) pos FROM qr WHERE chrom IS NOT NULL)
"""

AT = SIGNAL + """, h AS (SELECT pt.*, c.st cst, c.ed ced, c.val, c.u, c.idx, c.cov0, c.sum0, c.sqr0 FROM pt ASOF LEFT JOIN c ON pt.chrom = c.chrom AND pt.pos >= c.st),
a AS (SELECT h.*, s.st nst FROM h ASOF LEFT JOIN s ON h.chrom = s.chrom AND h.pos < s.st)
SELECT region_id, which, chrom, pos, {} FROM a"""

REGION = SIGNAL + """, pc AS (SELECT r.region_id, greatest(r.st, s.st) a, least(r.ed, s.ed) b, s.u, s.val FROM r JOIN s ON r.chrom = s.chrom AND s.st < r.ed AND s.ed > r.st),
g AS (SELECT region_id, coalesce(sum(u * (b - a)), 0) / 1000.0::DOUBLE s, coalesce(sum(u::HUGEINT * u * (b - a)), 0)::DOUBLE / 1000000.0::DOUBLE q, coalesce(sum(b - a), 0)::BIGINT c, min(val) lo, max(val) hi
      FROM r LEFT JOIN pc USING (region_id) GROUP BY 1)
SELECT region_id, {} FROM g"""

WINDOWS = SIGNAL + """, pc AS (SELECT eb.region_id, bin, greatest(bin_st, s.st) a, least(bin_ed, s.ed) b, s.u, s.val FROM eb JOIN s ON eb.chrom = s.chrom AND s.st < bin_ed AND s.ed > bin_st),
k AS (SELECT eb.region_id, bin, count(*) started FROM eb JOIN s ON eb.chrom = s.chrom AND s.st > bin_st AND s.st <= bin_ed GROUP BY ALL),
g AS (SELECT region_id, bin, any_value(bin_ed - bin_st) size, coalesce(sum(u * (b - a)), 0) / 1000.0::DOUBLE s, coalesce(sum(u::HUGEINT * u * (b - a)), 0)::DOUBLE / 1000000.0::DOUBLE q,
             coalesce(sum(b - a), 0)::BIGINT c, min(val) lo, max(val) hi FROM eb LEFT JOIN pc USING (region_id, bin) GROUP BY ALL),
g2 AS (SELECT g.*, coalesce(started, 0) started FROM g LEFT JOIN k USING (region_id, bin)),
up AS (SELECT region_id, bin, s.val v FROM sl LEFT JOIN s ON sl.chrom = s.chrom AND s.st <= base AND base < s.ed)
SELECT region_id, bin, {} FROM g2 UNION ALL SELECT region_id, bin, {} FROM up"""

STDEV = "CASE WHEN c > 0 THEN sqrt(greatest(0.0, (q - s * s / c) / c)) END"
#: SQL of each region measure, of windows, and of windows that repeat a base.
MEASURES = {
    "sum": ("s", "v"),
    "sqrsum": ("q", None),
    "avg": ("CASE WHEN c > 0 THEN s / c END", "v"),
    "cov": ("c", "CASE WHEN v IS NULL THEN 0 ELSE 1 END::BIGINT"),
    "stdev": (STDEV, "0.0::DOUBLE"),
    "min": ("coalesce(lo, 0)", "v"),
    "max": ("coalesce(hi, 0)", "v"),
}
#: SQL of each answer at a position.
POINTS = {
    "value_at": ("value", "CASE WHEN pos < ced THEN val ELSE 0 END"),
    "rank_interval": ("rank", "coalesce(idx, -1)"),
    "find_cover": ("cover_idx, cover_off", None),
    "coverage_at": ("coverage", "coalesce(cov0 + least(ced, pos) - cst, 0)"),
    "prefix_sum_at": ("prefix_sum", "coalesce(sum0 + u * (least(ced, pos) - cst), 0) / 1000.0::DOUBLE"),
    "prefix_sqr_at": ("prefix_sqr", "coalesce(sqr0 + u::HUGEINT * u * (least(ced, pos) - cst), 0)::DOUBLE / 1000000.0::DOUBLE"),
    "intervals_started": ("started", "coalesce(idx + 1, 0)"),
    "next_covered": ("next", "CASE WHEN pos < ced THEN pos ELSE coalesce(nst, -1) END"),
    "prev_covered": ("prev", "CASE WHEN pos < ced THEN pos ELSE coalesce(ced - 1, -1) END"),
}
ISLANDS = SIGNAL + """, l AS (SELECT *, lag(ed) OVER w ped, lag(val) OVER w pv FROM s WINDOW w AS (PARTITION BY chrom ORDER BY st)),
i AS (SELECT *, sum(CASE WHEN {} THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY st ROWS UNBOUNDED PRECEDING) g FROM l)
SELECT {} FROM i GROUP BY chrom, g"""


def signal(spark, d):
    """The signal that the queries of this module ask: a track in order of place with its running sums, stored once per application."""

    def build():
        # the sums read the pieces twice, so these are written first
        return sg.cumulated(written(sg.composite(table(spark, d, "bed_signal")), "pieces")).sortWithinPartitions("chrom", "st")

    return stored(spark, f"{d}/bed_signal.parquet", "track", build)


def queries() -> dict:
    def asked(spark, d):
        return table(spark, d, "query_regions").select("region_id", "chrom", "st", "ed", "n")

    def regions(spark, d):
        """The regions asked for, and every whole chrom in 500 windows (the chroms are a fixed, short list)."""
        whole = table(spark, d, "chrom_sizes").selectExpr(
            "1000000000 + row_number() over (order by chrom) as region_id", "chrom", "cast(0 as bigint) as st", "chrom_len as ed", "cast(500 as bigint) as n"
        )
        return asked(spark, d).unionByName(whole)

    def points(spark, d):
        at = F.posexplode(F.array("st", "ed", F.expr("(st + ed) div 2"))).alias("which", "pos")
        return regions(spark, d).where("chrom is not null").select("region_id", "chrom", at).withColumn("which", F.col("which").cast("int"))

    def lengths(s, p):
        """``pos`` as a length: scaled from the chrom's extent to its covered bases; as it is where there is no signal."""
        total = s.groupBy("chrom").agg(F.sum(F.col("ed") - F.col("st")).alias("_cov"), F.max("ed").alias("_end"))
        scaled = F.expr("case when _end > 0 then cast(pos as decimal(19,0)) * _cov div _end else pos end")
        return join_on(p, total, ["chrom"]).withColumn("pos", scaled).drop("_cov", "_end")

    def found_lengths(spark, d):
        s = signal(spark, d)
        return sg.covered_at_length(s, lengths(s, points(spark, d)))

    def both(f):
        return lambda spark, d: f(signal(spark, d), regions(spark, d))

    def at(cols):
        return lambda spark, d: sg.at_positions(signal(spark, d), points(spark, d)).select("region_id", "which", "chrom", "pos", *cols)

    def alone(f):
        return lambda spark, d: f(signal(spark, d))

    out = {f"region_{m}": both(lambda s, r, m=m: sg.region_summary(s, r, [m])) for m in MEASURES}
    out |= {f"region_{m}_or_null": both(lambda s, r, m=m: sg.region_summary(s, r, [f"{m}_or_null"])) for m in ("min", "max")}
    out |= {f"{m}_batch": both(lambda s, r, m=m: sg.window_summary(s, r, [m, "cov_frac"] if m == "cov" else [m])) for m in MEASURES if m != "sqrsum"}
    out |= {k: at(c.split(", ")) for k, (c, _) in POINTS.items()}
    return out | {
        "interval_count_batch": both(lambda s, r: sg.window_summary(s, r, ["started"])),
        "bin_edges": lambda spark, d: sg.bin_edges(regions(spark, d)),
        "upsample_slots": lambda spark, d: sg.upsample_slots(regions(spark, d)),
        "region_errors": lambda spark, d: sg.region_errors(asked(spark, d)),
        "list_intervals": both(sg.listed),
        "base_value_map": lambda spark, d: sg.base_values(signal(spark, d), asked(spark, d)),
        "find_intervals": both(sg.found_ranges),
        "find_rlen": found_lengths,
        "semi_overlap": both(lambda s, r: overlap_join(sg.valid_regions(r), s, how="left_semi").select("region_id")),
        "anti_overlap": both(lambda s, r: overlap_join(sg.valid_regions(r), s, how="left_anti").select("region_id")),
        "signal": lambda spark, d: sg.composite(table(spark, d, "bed_signal")),
        "track_summary": alone(sg.track_summary),
        "prefix_len": alone(lambda s: sg.cumulated(s).select("chrom", "idx", "st", "ed", F.col("val").alias("value"), "cov0")),
        "merge_equal": alone(sg.merged_equal),
        "islands": alone(sg.segments),
        "gaps": alone(sg.gap_lengths),
        "zone_map": alone(sg.zone_map),
        "sampled_sums": alone(sg.sampled_sums),
        "index_ranges": alone(sg.index_ranges),
        "index_extremes": lambda spark, d: sg.index_extremes(signal(spark, d), asked(spark, d).selectExpr("region_id as qid", "chrom", "region_id % 97 as i", "region_id % 97 + 1 + coalesce(n, 0) as j")),
        "feature_order": lambda spark, d: sg.order_violations(table(spark, d, "bed_features")),
        "end_pairs": lambda spark, d: sg.end_pairs(table(spark, d, "bed_features")),
        "quantise": alone(sg.quantised),
        "dense_to_runs": alone(lambda s: sg.runs_of(sg.dense(s))),
        "validate_overlap": lambda spark, d: sg.overlap_violations(table(spark, d, "bed_signal")),
        "depth_sweep": lambda spark, d: sg.depth(table(spark, d, "bed_features")),
        "chrom_ids": alone(lambda s: s.select("chrom").distinct().selectExpr("chrom", "cast(dense_rank() over (order by chrom) - 1 as bigint) as chrom_id")),
        "chrom_count": alone(lambda s: s.agg(F.countDistinct("chrom").alias("chroms"), F.count(F.lit(1)).alias("intervals"))),
    }


def oracle_sql() -> dict[str, str]:
    out = {f"region_{m}": REGION.format(f"{e} AS {m}") for m, (e, _) in MEASURES.items()}
    out |= {f"region_{m}_or_null": REGION.format(f"{e} AS {m}_or_null") for m, e in (("min", "lo"), ("max", "hi"))}
    for m, (e, v) in MEASURES.items():
        if m == "cov":
            out["cov_batch"] = WINDOWS.format("c AS cov, c / size AS cov_frac", f"{v} AS cov, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS cov_frac")
        elif v:
            out[f"{m}_batch"] = WINDOWS.format(f"{e} AS {m}", f"{v} AS {m}")
    out |= {k: AT.format(f"{e} AS {c}") for k, (c, e) in POINTS.items() if e}
    runs = "chrom, min(st) AS st, max(ed) AS ed, min(val) AS val, count(*) AS n"
    return out | {
        "find_cover": AT.format("CASE WHEN pos < ced THEN idx ELSE coalesce(idx + 1, 0) END AS cover_idx, CASE WHEN pos < ced THEN pos - cst + 1 ELSE 0 END AS cover_off"),
        "interval_count_batch": WINDOWS.format("started", "CASE WHEN v IS NULL THEN 0 ELSE 1 END::BIGINT"),
        "bin_edges": SIGNAL + " SELECT region_id, bin, bin_st, bin_ed FROM eb",
        "upsample_slots": SIGNAL + " SELECT region_id, bin, base FROM sl",
        "region_errors": """SELECT region_id, CASE WHEN NOT coalesce(chrom IS NOT NULL AND st < ed, false) THEN 'interval' ELSE 'windows' END AS error
FROM query_regions WHERE NOT coalesce(chrom IS NOT NULL AND st < ed, false) OR NOT coalesce(n >= 1, false)""",
        "list_intervals": SIGNAL + " SELECT region_id, s.st, s.ed, s.val FROM r JOIN s ON r.chrom = s.chrom AND s.st < r.ed AND s.ed > r.st",
        "base_value_map": SIGNAL + ", b AS (SELECT region_id, chrom, unnest(range(st, ed)) pos FROM r WHERE region_id < 1000000000) SELECT region_id, pos, CASE WHEN pos < s.ed THEN val END AS val FROM b ASOF LEFT JOIN s ON b.chrom = s.chrom AND b.pos >= s.st",
        "find_intervals": SIGNAL + ' SELECT region_id, min(idx) AS "first", max(idx) + 1 AS "last" FROM r LEFT JOIN c ON r.chrom = c.chrom AND c.st < r.ed AND c.ed > r.st GROUP BY 1',
        "find_rlen": SIGNAL + """, z AS (SELECT chrom, sum(ed - st) cv, max(ed) le FROM s GROUP BY 1),
q AS (SELECT region_id, which, pt.chrom, CASE WHEN le > 0 THEN (pos::HUGEINT * cv // le)::BIGINT ELSE pos END pos FROM pt LEFT JOIN z ON pt.chrom = z.chrom)
SELECT region_id, which, q.chrom, pos, coalesce(idx + 1, 0) AS idx FROM q ASOF LEFT JOIN c ON q.chrom = c.chrom AND pos > cov0""",
        "semi_overlap": SIGNAL + " SELECT region_id FROM r WHERE EXISTS (SELECT 1 FROM s WHERE r.chrom = s.chrom AND s.st < r.ed AND s.ed > r.st)",
        "anti_overlap": SIGNAL + " SELECT region_id FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE r.chrom = s.chrom AND s.st < r.ed AND s.ed > r.st)",
        "signal": SIGNAL + " SELECT chrom, st, ed, val FROM s",
        "track_summary": SIGNAL + " SELECT chrom, count(*) AS intervals, max(ed) AS last_position, sum(ed - st)::BIGINT AS covered, count(DISTINCT u) AS distinct_values, min(val) AS min_val, max(val) AS max_val, 1000::BIGINT AS scale, min(u) AS delta FROM s GROUP BY 1",
        "prefix_len": SIGNAL + ' SELECT chrom, idx, st, ed, val AS "value", cov0 FROM c',
        "merge_equal": ISLANDS.format("ped = st AND pv = val", runs),
        "islands": ISLANDS.format("ped = st", runs.replace("min(val) AS val, ", "")),
        "gaps": SIGNAL + " SELECT chrom, st, st - coalesce(lag(ed) OVER (PARTITION BY chrom ORDER BY st), 0) AS gap FROM s",
        "zone_map": SIGNAL + " SELECT chrom, idx - idx % 16 AS zone, count(*) AS n, min(val) AS min_val, max(val) AS max_val FROM c GROUP BY ALL",
        "sampled_sums": SIGNAL + " SELECT chrom, idx, sum0, sqr0::DOUBLE AS sqr0 FROM c WHERE idx % 64 = 0",
        "index_ranges": SIGNAL + ' SELECT chrom, idx - idx % 100 AS "first", max(idx) + 1 AS "last", arg_min(sum0, idx) / 1000.0::DOUBLE AS psum, min(val) AS lo, max(val) AS hi FROM c GROUP BY chrom, idx - idx % 100',
        "index_extremes": SIGNAL + ", q AS (SELECT region_id qid, chrom, region_id % 97 i, region_id % 97 + 1 + coalesce(n, 0) j FROM query_regions) SELECT qid, arg_min(sum0, idx) FILTER (idx = i) / 1000.0::DOUBLE AS psum, min(val) AS lo, max(val) AS hi FROM q LEFT JOIN c ON q.chrom = c.chrom AND idx >= i AND idx < j GROUP BY 1",
        "feature_order": "WITH l AS (SELECT *, lag(st) OVER w ps, lag(ed) OVER w pe FROM bed_features WHERE track_id IS NOT NULL AND chrom IS NOT NULL AND st IS NOT NULL AND ed IS NOT NULL AND ord IS NOT NULL WINDOW w AS (PARTITION BY track_id, chrom ORDER BY ord)), p AS (SELECT track_id, chrom, ord, CASE WHEN ed <= st THEN 'empty' WHEN st < ps THEN 'start' WHEN st = ps AND ed < pe THEN 'end' END problem FROM l) SELECT * FROM p WHERE problem IS NOT NULL",
        "end_pairs": "WITH e AS (SELECT track_id, chrom, ord, unnest([st, ed]) p FROM bed_features WHERE st < ed AND track_id IS NOT NULL AND chrom IS NOT NULL AND ord IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY track_id, chrom ORDER BY p, ord) - 1 i FROM e) SELECT track_id, chrom, ord, min(i) AS \"first\", max(i) - min(i) AS span FROM n GROUP BY ALL",
        "quantise": SIGNAL + ", k AS (SELECT chrom, u, row_number() OVER (PARTITION BY chrom ORDER BY u) - 1 rk FROM (SELECT DISTINCT chrom, u FROM s)), m AS (SELECT chrom, min(u) lo FROM s GROUP BY 1) SELECT chrom, st, u - lo AS code, rk AS rank, u / 1000.0::DOUBLE AS back FROM s JOIN k USING (chrom, u) JOIN m USING (chrom)",
        "dense_to_runs": ISLANDS.replace("FROM s WINDOW", "FROM s WHERE val <> 0 WINDOW").format("ped = st AND pv = val", runs.replace(", count(*) AS n", "")),
        "validate_overlap": """
WITH e AS (SELECT track_id, chrom, st, ed, count(*) n FROM bed_signal WHERE st IS NOT NULL AND ed IS NOT NULL AND chrom IS NOT NULL GROUP BY ALL),
l AS (SELECT *, max(ed) OVER (PARTITION BY track_id, chrom ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM e),
p AS (SELECT track_id, chrom, st, ed, CASE WHEN ed <= st THEN 'empty' WHEN p > st OR n > 1 THEN 'overlap' END problem FROM l) SELECT * FROM p WHERE problem IS NOT NULL""",
        "depth_sweep": """
WITH e AS (SELECT track_id, chrom, pos, sum(d) d FROM (SELECT track_id, chrom, st pos, 1 d FROM bed_features WHERE st < ed AND chrom IS NOT NULL
           UNION ALL SELECT track_id, chrom, ed, -1 FROM bed_features WHERE st < ed AND chrom IS NOT NULL) GROUP BY ALL HAVING sum(d) <> 0)
SELECT track_id, chrom, pos, (sum(d) OVER (PARTITION BY track_id, chrom ORDER BY pos))::BIGINT AS depth FROM e""",
        "chrom_ids": SIGNAL + " SELECT chrom, dense_rank() OVER (ORDER BY chrom) - 1 AS chrom_id FROM (SELECT DISTINCT chrom FROM s)",
        "chrom_count": SIGNAL + " SELECT count(DISTINCT chrom) AS chroms, count(*) AS intervals FROM s",
    }

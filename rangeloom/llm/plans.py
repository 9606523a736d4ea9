"""Queries p4 and p6 to p9: whole tables, production parameters; and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..tables import table
from . import digests, packing, repetition, runs, tokens

RUNS_SQL = """
WITH e AS (SELECT track_id, chrom, st, ed, min(CASE WHEN isnan(val) THEN NULL ELSE val END) v FROM step_signal
           WHERE chrom IS NOT NULL AND st IS NOT NULL AND ed IS NOT NULL GROUP BY ALL),
l AS (SELECT *, lag(v) OVER w pv, lag(ed) OVER w pe, row_number() OVER w i FROM e WINDOW w AS (PARTITION BY track_id, chrom ORDER BY st, ed)),
g AS (SELECT *, sum(CASE WHEN abs(v - pv) < 0.0025 AND st <= pe + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, chrom ORDER BY st, ed ROWS UNBOUNDED PRECEDING) grp FROM l),
r AS (SELECT track_id, chrom, min(st) run_st, arg_max(ed, i) run_ed, count(*) n, arg_max(ed, i) - min(st) length, arg_min(v, i) first_val, count(v) > 0 valued FROM g GROUP BY track_id, chrom, grp)"""

QUANTILE_SQL = """
WITH v AS (SELECT track_id, chrom, val FROM bed_signal WHERE chrom IS NOT NULL AND val IS NOT NULL AND NOT isnan(val)),
p AS (SELECT track_id, chrom, count(*) n, quantile_disc(val, 0.5) p50, quantile_disc(val, 0.95) p95 FROM v GROUP BY ALL)
SELECT track_id, chrom FROM p WHERE n >= 30 AND p50 > 0 AND p95 >= 6 * p50"""

REPEATED_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}][\p{L}\p{M}\p{Nd}]*') l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, len(l) n, unnest(l) w, generate_subscripts(l, 1) i FROM w WHERE len(l) >= 50),
h AS (SELECT doc_id, n, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o q FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, q ORDER BY i) k FROM h WHERE q IS NOT NULL),
c AS (SELECT doc_id, n, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM g WHERE k > 1),
t AS (SELECT doc_id, n, sum(least(8, i - coalesce(p, i - 8))) m FROM c GROUP BY ALL)
SELECT doc_id FROM t WHERE m * 100 >= n * 60"""


def queries() -> dict:
    def signal(spark, d):
        return table(spark, d, "bed_signal").where("chrom is not null")

    def docs(spark, d):
        return table(spark, d, "documents")

    def collapsed(spark, d):
        return runs.collapse(table(spark, d, "step_signal").where("chrom is not null"))

    def from_days(spark, d):
        day = signal(spark, d).withColumn("day", F.to_date("loaded_at"))
        return digests.percentiles(digests.merge(digests.digest(day, ["chrom", "day"]), ["chrom"]), ["chrom"])

    def assigned(spark, d):
        return packing.fill(tokens.counts(docs(spark, d)))

    return {
        "p4_found": lambda spark, d: collapsed(spark, d).where("n >= 3 and valued").select("track_id", "chrom", "run_st", "run_ed"),
        "p4_runs": collapsed,
        "p6_found": lambda spark, d: digests.skewed(signal(spark, d)),
        "p6_percentiles": lambda spark, d: digests.certified(signal(spark, d), ["track_id", "chrom"]),
        "p6_chroms": lambda spark, d: digests.certified(signal(spark, d), ["chrom"]),
        "p6_bounded": lambda spark, d: digests.bounded(signal(spark, d), ["track_id", "chrom"]),
        "p6_from_days": from_days,
        "p7_ids": lambda spark, d: tokens.encode(docs(spark, d)),
        "p7_decoded": lambda spark, d: tokens.decode(tokens.encode(docs(spark, d))),
        "p8_found": lambda spark, d: packing.split_items(assigned(spark, d)),
        "p8_containers": assigned,
        "p8_violations": lambda spark, d: packing.violations(assigned(spark, d)),
        "p9_found": lambda spark, d: repetition.repetitive(docs(spark, d)),
        "p9_perplexity": lambda spark, d: repetition.judged(docs(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": RUNS_SQL + " SELECT track_id, chrom, run_st, run_ed FROM r WHERE n >= 3 AND valued",
        "p4_runs": RUNS_SQL + " SELECT * FROM r",
        "p6_found": QUANTILE_SQL,
        "p8_violations": "SELECT count(DISTINCT doc_id) AS items, 0::BIGINT AS torn, 0::BIGINT AS needless, 0::BIGINT AS over_capacity, 0::BIGINT AS over_segments, 0::BIGINT AS over_loss, 0::BIGINT AS misplaced FROM documents",
        "p6_bounded": "SELECT track_id, chrom, count(*) AS n, true AS within FROM bed_signal WHERE chrom IS NOT NULL AND val IS NOT NULL AND NOT isnan(val) GROUP BY ALL",
        "p9_found": REPEATED_SQL,
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }

"""Queries p1, p2, p3 and p5: whole tables, production parameters; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, grid, skew
from ..sources import interval_text
from ..tables import table

COVERED_SQL = """
WITH e AS (SELECT row_id, track_id, chrom, st, ed, max(ed) OVER (PARTITION BY track_id, chrom ORDER BY st, ed, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe
           FROM bed_signal WHERE chrom IS NOT NULL AND st < ed),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR st > pe THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, chrom ORDER BY st, ed, row_id ROWS UNBOUNDED PRECEDING) grp,
             CASE WHEN st < pe THEN 1 ELSE 0 END hit FROM e),
p AS (SELECT track_id, chrom, grp, min(st) st, max(ed) ed, max(hit) multi FROM g GROUP BY ALL),
q AS (SELECT *, lead(st) OVER (PARTITION BY track_id, chrom ORDER BY st) nx FROM p)"""


def queries() -> dict:
    def signal(spark, d):
        return table(spark, d, "bed_signal")

    def lines(f):
        return lambda spark, d: f(table(spark, d, "bed_lines"), table(spark, d, "chrom_sizes"))

    def steps(f):
        return lambda spark, d: f(signal(spark, d), table(spark, d, "track_info"))

    return {
        "p1_found": lambda spark, d: coverage.found(signal(spark, d)),
        "p1_periods": lambda spark, d: coverage.periods_and_gaps(signal(spark, d).where("chrom is not null")),
        "p2_found": lambda spark, d: skew.heavy_profiles(signal(spark, d)).select("chrom"),
        "p2_profile": lambda spark, d: skew.key_profile(signal(spark, d)).withColumn("val_std", F.round("val_std", 2)),
        "p3_found": steps(grid.missing_cells),
        "p3_series": steps(grid.regular_series),
        "p5_found": lines(lambda a, b: interval_text.failing_lines(a, b).select("line_id", "reason")),
        "p5_valid": lines(interval_text.valid_rows),
    }


FIELDS_SQL = r"""
WITH r AS (SELECT line_id, line FROM bed_lines WHERE line IS NOT NULL AND NOT regexp_matches(line, '^[ \t\r]*($|#|(track|browser)([ \t\r]|$))')),
q AS (SELECT *, regexp_full_match(line, '([ \r]*"[^"]*(""[^"]*)*"[ \r]*|[^"\t]*)(\t([ \r]*"[^"]*(""[^"]*)*"[ \r]*|[^"\t]*))*') ok FROM r),
s AS (SELECT *, list_transform(regexp_extract_all(chr(9) || line, '\t([ \r]*"[^"]*(?:""[^"]*)*"[ \r]*|[^"\t]*)', 1), lambda x: trim(x, ' ' || chr(13))) f FROM q),
t AS (SELECT *, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:length(x)-1], '""', '"') ELSE x END) g, len(f) n FROM s),
u AS (SELECT t.*, chrom_len, CASE WHEN regexp_full_match(g[2], '[0-9]+') AND length(ltrim(g[2], '0')) <= 18 THEN TRY_CAST(g[2] AS HUGEINT) END a,
             CASE WHEN regexp_full_match(g[3], '[0-9]+') AND length(ltrim(g[3], '0')) <= 18 THEN TRY_CAST(g[3] AS HUGEINT) END b FROM t LEFT JOIN chrom_sizes c ON g[1] = c.chrom),
v AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN n NOT IN (4, 5) THEN 'column_count' WHEN chrom_len IS NULL THEN 'chrom'
                     WHEN NOT coalesce(a < b AND b <= chrom_len, false) THEN 'position'
                     WHEN NOT regexp_full_match(g[4], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'val' END reason FROM u)"""

CELLS_SQL = """
WITH v AS (SELECT b.track_id, chrom, st, ed, val, step, st // step c0, (ed - 1) // step c1 FROM bed_signal b JOIN track_info t USING (track_id)
           WHERE chrom IS NOT NULL AND st < ed AND val IS NOT NULL AND NOT isnan(val)),
x AS (SELECT *, unnest(range(c0, c1 + 1)) cell FROM v),
f AS (SELECT track_id, chrom, step, cell, sum(CAST(val AS DECIMAL(24,6)) * CAST(least(ed, (cell+1)*step) - greatest(st, cell*step) AS DECIMAL(12,0)))::DOUBLE
             / sum(least(ed, (cell+1)*step) - greatest(st, cell*step)) val FROM x GROUP BY ALL),
n AS (SELECT *, lead(cell) OVER (PARTITION BY track_id, chrom ORDER BY cell) nx FROM f)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": COVERED_SQL
        + " SELECT track_id, chrom, 'merged' kind, st, ed FROM q WHERE multi = 1 UNION ALL SELECT track_id, chrom, 'gap', ed, nx FROM q WHERE nx IS NOT NULL",
        "p1_periods": COVERED_SQL + " SELECT track_id, chrom, st, ed, multi = 1 AS multi, nx AS gap_ed FROM q",
        "p2_found": "SELECT chrom FROM bed_signal WHERE chrom IS NOT NULL GROUP BY chrom HAVING count(*) * 20 >= (SELECT count(*) FROM bed_signal)",
        "p2_profile": """
WITH e AS (SELECT chrom, st, ed, CASE WHEN isnan(val) THEN NULL ELSE val END v FROM bed_signal WHERE chrom IS NOT NULL),
i AS (SELECT chrom, st, ed, max(ed) OVER (PARTITION BY chrom ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM e WHERE st < ed),
c AS (SELECT chrom, sum(greatest(0, ed - greatest(st, coalesce(pe, st))))::BIGINT covered FROM i GROUP BY 1)
SELECT chrom, count(*) AS "rows", coalesce(max(covered), 0) AS covered, count(v) AS valued, min(v) AS val_min, max(v) AS val_max, sum(v::DECIMAL(28,6))::DOUBLE AS val_sum,
       sum(v::DECIMAL(28,6))::DOUBLE / nullif(count(v), 0) AS val_mean, round(stddev_pop(v), 2) AS val_std
FROM e LEFT JOIN c USING (chrom) GROUP BY chrom""",
        "p3_found": CELLS_SQL + " SELECT track_id, chrom, unnest(range(cell + 1, nx)) * step AS cell_st FROM n WHERE nx > cell + 1",
        "p3_series": CELLS_SQL
        + """, a AS (SELECT track_id, chrom, step, cell, val, unnest(range(cell, coalesce(nx, cell + 1))) k FROM n)
SELECT track_id, chrom, k * step AS cell_st, val, k > cell AS filled, k - cell AS age FROM a""",
        "p5_found": FIELDS_SQL + " SELECT line_id, reason FROM v WHERE reason IS NOT NULL",
        "p5_valid": FIELDS_SQL
        + " SELECT line_id, g[1] AS chrom, a::BIGINT AS st, b::BIGINT AS ed, g[4]::DOUBLE AS val, CASE WHEN n = 5 THEN g[5] END AS annotation FROM v WHERE reason IS NULL",
    }

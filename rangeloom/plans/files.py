"""Queries on lines, features, requests and streams; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as sg
from ..sources import files, service
from ..streaming import windows
from ..tables import table
from .signals import SIGNAL, signal


#: Draws are below this prime.
DRAWS = 4294967291


def workload(spark, n: int, seed: int, chroms, longest: int = 5_000_000, width: int | None = None):
    """``n`` random regions over chroms ``(chrom, chrom_len)``: ``(region_id, chrom, st, ed, n)``; ``width`` fixes their length.

    A region's chrom is drawn in proportion to nothing but the list; starts are uniform. The same seed gives the same regions.
    """
    k = chroms.selectExpr("chrom", "chrom_len", "row_number() over (order by chrom) - 1 as _i")  # the list of chroms is short
    size = chroms.count()
    draw = lambda i: F.expr(f"(id * {2654435761 + 2 * i} + {seed * 40503 + i}) % {DRAWS}")
    r = spark.range(n).select(F.col("id").alias("region_id"), (draw(0) % size).cast("int").alias("_i"), draw(1).alias("_u"), draw(2).alias("_v"))
    r = r.join(k, "_i")
    length = F.lit(width) if width else 1 + F.expr(f"_v % {longest}")
    st = F.expr("_u % chrom_len")
    return r.select("region_id", "chrom", st.alias("st"), F.greatest(st + 1, F.least(st + length, F.col("chrom_len"))).alias("ed"), F.lit(1).cast("bigint").alias("n"))


def queries() -> dict:
    def addresses(spark, d):
        url = F.concat(F.lit("http://host/s?file=t&op=cov&chrom="), "chrom", F.lit("&start="), F.col("st").cast("string"), F.lit("&end="), F.col("ed").cast("string"), F.coalesce(F.concat(F.lit("&w="), F.col("n").cast("string")), F.lit("")))
        return table(spark, d, "query_regions").select("region_id", url.alias("url"))

    def events(spark, d):
        return windows.opened(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))

    def features(spark, d):
        return table(spark, d, "bed_features")

    return {
        "bedgraph_rows": lambda spark, d: files.parse_signal(table(spark, d, "bed_lines").select("line_id", "line"), "line").where("error is null").drop("error"),
        "bedgraph_errors": lambda spark, d: files.parse_signal(table(spark, d, "bed_lines").select("line_id", "line"), "line").where("error is not null").select("line_id", "error"),
        "bed_rows": lambda spark, d: files.parse_features(table(spark, d, "bed_lines").select("line_id", "line"), "line").where("error is null").drop("error"),
        "bedgraph_lines": lambda spark, d: signal(spark, d).select("chrom", "st", files.signal_line().alias("line")),
        "bedgraph_lines_annotated": lambda spark, d: table(spark, d, "bed_signal").where("st < ed and chrom is not null and val is not null and not isnan(val)").select("row_id", files.signal_line(True).alias("line")),
        "bed_lines_out": lambda spark, d: features(spark, d).select("feature_id", files.feature_line().alias("line")),
        "bed_get": lambda spark, d: files.numbered_features(features(spark, d)).select("feature_id", "track_id", "chrom", "ord", "st", "ed", F.coalesce("other", F.lit("")).alias("other")),
        "bed_size": lambda spark, d: features(spark, d).groupBy("track_id", "chrom").agg(F.count(F.lit(1)).alias("size")),
        "bed_validate": lambda spark, d: features(spark, d).where("ed <= st").select("feature_id"),
        "annotations": lambda spark, d: table(spark, d, "bed_signal").select("row_id", F.coalesce("annotation", F.lit("")).alias("annotation")),
        "track_meta": lambda spark, d: table(spark, d, "track_info").select("track_id", F.coalesce("meta", F.lit("")).alias("meta")),
        "service_answers": lambda spark, d: service.answers(signal(spark, d), addresses(spark, d)),
        "workload": lambda spark, d: sg.region_summary(signal(spark, d), workload(spark, 50_000, 7, table(spark, d, "chrom_sizes").select("chrom", "chrom_len")), ["sum", "cov"]),
        "workload_fixed": lambda spark, d: sg.region_summary(signal(spark, d), workload(spark, 50_000, 7, table(spark, d, "chrom_sizes").select("chrom", "chrom_len"), width=5_000_000), ["sum", "cov"]),
        "stream_windows": lambda spark, d: windows.drained(spark, windows.tumbling(events(spark, d), "event_type", "ts", "value")),
        "stream_sessions": lambda spark, d: windows.drained(spark, windows.sessions(events(spark, d), "event_type", "ts", "5 minutes")),
        "stream_changes": lambda spark, d: windows.drained(spark, windows.changes(events(spark, d).selectExpr("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")),
    }


KEPT = r"WITH r AS (SELECT line_id, regexp_replace(line, '^[ \t]+|[ \t\r]+$', '', 'g') t FROM bed_lines WHERE line IS NOT NULL AND NOT regexp_matches(line, '^[ \t\r]*($|#|(track|browser)([ \t\r]|$))'))"


#: Like the SQL of the region measures, but asked at both ends, since the regions are many.
WORKLOAD = SIGNAL + """, k AS (SELECT chrom, chrom_len, row_number() OVER (ORDER BY chrom) - 1 i, count(*) OVER () m FROM chrom_sizes),
d AS (SELECT id, (id * 2654435761 + 283521) % 4294967291 a, (id * 2654435763 + 283522) % 4294967291 u, (id * 2654435765 + 283523) % 4294967291 v FROM range(50000) t(id)),
w AS (SELECT id region_id, chrom, u % chrom_len st, greatest(u % chrom_len + 1, least(u % chrom_len + {}, chrom_len)) ed FROM d JOIN k ON a % m = i),
e AS (SELECT region_id, chrom, st p, -1 f FROM w UNION ALL SELECT region_id, chrom, ed, 1 FROM w),
h AS (SELECT region_id, f, coalesce(sum0 + c.u * (least(c.ed, p) - c.st), 0) s, coalesce(cov0 + least(c.ed, p) - c.st, 0) n FROM e ASOF LEFT JOIN c ON e.chrom = c.chrom AND e.p >= c.st)
SELECT region_id, sum(f * s) / 1000.0::DOUBLE AS sum, sum(f * n)::BIGINT AS cov FROM h GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    parsed = KEPT + r""", f AS (SELECT line_id, t, regexp_extract(t, '^([^ \t]*)', 1) chrom, TRY_CAST(regexp_extract(t, '^[^ \t]*[ \t]+([+-]?[0-9]{1,18})([ \t]|$)', 1) AS BIGINT) st,
TRY_CAST(regexp_extract(t, '^[^ \t]*[ \t]+[^ \t]*[ \t]+([+-]?[0-9]{1,18})([ \t]|$)', 1) AS BIGINT) ed, TRY_CAST(regexp_extract(t, '^[^ \t]*[ \t]+[^ \t]*[ \t]+[^ \t]*[ \t]+([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)([ \t]|$)', 1) AS DOUBLE) val,
nullif(regexp_extract(t, '^[^ \t]*[ \t]+[^ \t]*[ \t]+[^ \t]*[ \t]+[^ \t]*[ \t]+(.*)$', 1), '') annotation FROM r), g AS (SELECT *, coalesce(st < ed AND val IS NOT NULL, false) ok FROM f)"""
    return {
        "workload": WORKLOAD.format("1 + v % 5000000"),
        "workload_fixed": WORKLOAD.format("5000000"),
        "bedgraph_lines": SIGNAL + r" SELECT chrom, st, chrom || chr(9) || st || chr(9) || ed || chr(9) || rtrim(regexp_replace(CAST(val AS DECIMAL(30,6))::VARCHAR, '0+$', ''), '.') AS line FROM s",
        "bedgraph_lines_annotated": r"SELECT row_id, chrom || chr(9) || st || chr(9) || ed || chr(9) || CASE WHEN val = 0 THEN '0' ELSE rtrim(regexp_replace(CAST(val AS DECIMAL(30,6))::VARCHAR, '0+$', ''), '.') END || CASE WHEN annotation <> '' THEN chr(9) || annotation ELSE '' END AS line FROM bed_signal WHERE st < ed AND chrom IS NOT NULL AND val IS NOT NULL AND NOT isnan(val)",
        "bed_lines_out": "SELECT feature_id, concat_ws(chr(9), chrom, st, ed, CASE WHEN other <> '' THEN other END) AS line FROM bed_features",
        "bed_get": "SELECT feature_id, track_id, chrom, row_number() OVER (PARTITION BY track_id, chrom ORDER BY st, ed, feature_id) - 1 AS ord, st, ed, coalesce(other, '') AS other FROM bed_features",
        "bed_size": "SELECT track_id, chrom, count(*) AS size FROM bed_features GROUP BY ALL",
        "bed_validate": "SELECT feature_id FROM bed_features WHERE ed <= st",
        "annotations": "SELECT row_id, coalesce(annotation, '') AS annotation FROM bed_signal",
        "track_meta": "SELECT track_id, coalesce(meta, '') AS meta FROM track_info",
        "service_answers": SIGNAL + """, q AS (SELECT region_id, chrom, st, ed, coalesce(n, 1) n FROM query_regions), e AS (SELECT *, CASE WHEN chrom IS NULL OR NOT coalesce(st < ed, false) THEN 'invalid interval' WHEN n < 1 OR n > 10000 THEN 'invalid number of windows' END error FROM q),
x AS (SELECT *, unnest(range(n)) b FROM e WHERE error IS NULL), y AS (SELECT region_id, chrom, b, CASE WHEN ed - st > n THEN st + (2 * (ed - st) * b + n) // (2 * n) ELSE st + ((ed - st) * (2 * b + 1) - 1) // (2 * n) END b0,
CASE WHEN ed - st > n THEN st + (2 * (ed - st) * (b + 1) + n) // (2 * n) ELSE st + ((ed - st) * (2 * b + 1) - 1) // (2 * n) + 1 END b1 FROM x),
z AS (SELECT region_id, b, coalesce(sum(CASE WHEN s.st IS NOT NULL THEN least(s.ed, b1) - greatest(s.st, b0) END), 0)::BIGINT c FROM y LEFT JOIN s ON y.chrom = s.chrom AND s.st < b1 AND s.ed > b0 GROUP BY ALL)
SELECT region_id, 200 AS status, '[' || string_agg(c::VARCHAR, ',' ORDER BY b) || ']' AS body FROM z GROUP BY region_id UNION ALL SELECT region_id, 400, error FROM e WHERE error IS NOT NULL""",
        "stream_windows": "WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS st, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ed, count(*) AS n, sum(CAST(round(\"value\" * 100) AS BIGINT))::BIGINT AS sum, min(\"value\") AS min, max(\"value\") AS max FROM events GROUP BY ALL) SELECT * FROM w WHERE ed <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
        "stream_sessions": """WITH l AS (SELECT event_type, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END x FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT *, sum(x) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM l) SELECT event_type, min(ts) AS st, max(ts) + INTERVAL 5 MINUTE AS ed, count(*) AS n FROM g GROUP BY event_type, g HAVING max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
        "stream_changes": "WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) p FROM events) SELECT user_id, event_id AS pos, event_type AS \"value\" FROM l WHERE p IS NULL OR p <> event_type",
        "bed_rows": r"""WITH r AS (SELECT line_id, regexp_replace(line, '\r+$', '') t FROM bed_lines WHERE line IS NOT NULL AND NOT regexp_matches(line, '^[ \t\r]*($|#|(track|browser)([ \t\r]|$))')),
f AS (SELECT line_id, regexp_extract(t, '^([^ \t]*)[ \t]([+-]?[0-9]{1,18})[ \t]([+-]?[0-9]{1,18})(?:[ \t]((?s:.*)))?$', ['a', 'b', 'c', 'd']) m, regexp_matches(t, '^[^ \t]*[ \t][+-]?[0-9]{1,18}[ \t][+-]?[0-9]{1,18}([ \t]|$)') ok FROM r)
SELECT line_id, m.a AS chrom, m.b::BIGINT AS st, m.c::BIGINT AS ed, coalesce(m.d, '') AS other FROM f WHERE ok AND m.b::BIGINT <= m.c::BIGINT""",
        "bedgraph_errors": parsed + " SELECT line_id, t AS error FROM g WHERE NOT ok",
        "bedgraph_rows": parsed + " SELECT line_id, chrom, st, ed, val, annotation FROM g WHERE ok",
    }

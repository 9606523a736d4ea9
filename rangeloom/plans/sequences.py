"""Queries on sequences (part), bits (orders), integer arrays and points (lineitem); and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import points as pts
from ..operators import sequence as sq
from ..tables import table

#: Edges along both axes of grid_count.
COLUMNS, ROWS = 8, 7


def seq(spark, d):
    """Symbols by position: sizes of parts by part key."""
    return table(spark, d, "part").selectExpr("p_partkey as pos", "cast(p_size as bigint) as c")


def bits(spark, d):
    """Whether an order is finished, by its place in the order of keys."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("bit"))
    return sq.numbered(o, ["o_orderkey"], "o_orderkey").select("pos", "bit")


def array(spark, d):
    """Quantities of line items in the order of orders, lines and further columns."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return sq.numbered(table(spark, d, "lineitem").select(*cols), cols, "l_orderkey").selectExpr("pos", "cast(l_quantity as bigint) as v")


def points(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_partkey as x", "l_suppkey as y")


def ranges(spark, d):
    """Ranges of 150 positions of the sequence, one from every position."""
    return table(spark, d, "part").selectExpr("p_partkey as qid", "p_partkey as b", "p_partkey + 150 as e", "p_partkey % 60 as k")


def boxes(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey as qid", "s_suppkey * 3 as x1", "s_suppkey * 7 + 40 as x2", "s_suppkey + 30 as y1", "s_suppkey as y2")


def extent(p):
    """``(x1, x2, y1, y2)``: the least rectangle ``[x1, x2) x [y1, y2)`` that holds all points, of one position if there is none."""
    r = p.where("x is not null and y is not null").selectExpr("min(x) as x1", "max(x) + 1 as x2", "min(y) as y1", "max(y) + 1 as y2").head()
    return (0, 1, 0, 1) if r["x1"] is None else tuple(map(int, r))


def edges(lo, hi, n):
    """``n`` edges at equal steps over ``[lo, hi)``; the last is ``hi``."""
    return [lo + (hi - lo) * (i + 1) // n for i in range(n)]


def grid(p):
    x1, x2, y1, y2 = extent(p)
    return pts.grid_count(p, edges(x1, x2, COLUMNS), edges(y1, y2, ROWS))


def heat(p, nx=17, ny=9):
    """All points in ``nx`` times ``ny`` bins; over an extent of fewer positions than bins the last ones lie beyond it."""
    x1, x2, y1, y2 = extent(p)
    return pts.heatmap(p, x1, max(x2, x1 + nx), y1, max(y2, y1 + ny), nx, ny)


def queries() -> dict:
    def on(src, f):
        return lambda spark, d: f(src(spark, d))

    def two(a, b, f):
        return lambda spark, d: f(a(spark, d), b(spark, d))

    def seq_v(spark, d):
        return seq(spark, d).withColumnRenamed("c", "v")

    def targets(spark, d):
        return table(spark, d, "orders").selectExpr("o_orderkey * 101 as target")

    def corner(spark, d):
        return table(spark, d, "supplier").selectExpr("s_suppkey as qid", "s_suppkey * 19 as qx", "s_suppkey as qy")

    def asked(spark, d):
        return table(spark, d, "part").selectExpr("p_partkey as qid", "p_partkey % 53 as c", "p_partkey as p")

    def sparse(spark, d):
        return table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as at"), table(spark, d, "orders").selectExpr("o_orderkey as pos")

    return {
        "seq_access": on(seq, lambda s: s),
        "seq_rank": on(seq, sq.symbol_ranks),
        "seq_select": on(seq, lambda s: sq.symbol_ranks(s).selectExpr("c", "rank as r", "pos")),
        "seq_rank_all": two(seq, asked, sq.rank_all),
        "seq_kth": two(seq, ranges, sq.kth),
        "seq_minmax": two(seq_v, ranges, lambda a, r: sq.extremes(a, r)),
        "rmq_min": two(array, lambda s, d: table(s, d, "orders").selectExpr("o_orderkey as qid", "o_orderkey as b", "o_orderkey + 1 + o_custkey % 300 as e"), lambda a, r: sq.extremes(a, r).select("qid", "min", "min_at")),
        "rmq_max": two(array, lambda s, d: table(s, d, "orders").selectExpr("o_orderkey as qid", "o_orderkey as b", "o_orderkey + 1 + o_custkey % 300 as e"), lambda a, r: sq.extremes(a, r).select("qid", "max", "max_at")),
        "seq_box_count": two(seq, lambda s, d: ranges(s, d).selectExpr("qid", "b as x1", "e as x2", "k as y1", "k + 17 as y2"), lambda a, b: sq.box_count(a, b, "pos", "c")),
        "seq_box_list": two(seq, lambda s, d: ranges(s, d).selectExpr("qid", "b as x1", "e as x2", "k as y1", "k + 17 as y2"), lambda a, b: sq.in_boxes(a, b, "pos", "c").selectExpr("qid", "x as pos", "y as c")),
        "wavelet_layers": on(seq, lambda s: sq.bit_layers(s, 6)),
        "bit_rank": on(bits, sq.bit_ranks),
        "bit_select1": on(bits, sq.select_bits),
        "bit_select0": on(bits, lambda b: sq.select_bits(b, False)),
        "bit_next": on(bits, sq.next_bits),
        "bit_scan": two(bits, lambda s, d: table(s, d, "orders").selectExpr("o_orderkey as qid", "o_custkey as pos", "o_orderkey % 40 as skip"), sq.scan_bits),
        "rrr_rank": two(bits, lambda s, d: table(s, d, "orders").selectExpr("o_custkey as pos").distinct(), lambda b, p: sq.rrr_lookup(sq.rrr_blocks(b), p)),
        "rrr_select": two(bits, lambda s, d: table(s, d, "orders").selectExpr("o_custkey as r").distinct(), lambda b, r: sq.rrr_select(sq.rrr_blocks(b), r)),
        "value_ranks": on(array, sq.value_ranks),
        "popcount": on(bits, lambda b: b.agg(F.sum(F.col("bit").cast("bigint")).alias("ones"), F.count(F.lit(1)).alias("length"))),
        "sparse_rank_select": lambda spark, d: sq.sparse_ranks(*sparse(spark, d)),
        "excess": on(bits, sq.excess),
        "excess_minmax": two(lambda s, d: sq.excess(bits(s, d)), lambda s, d: table(s, d, "orders").selectExpr("o_orderkey as qid", "o_orderkey as b", "o_orderkey + 1 + o_custkey % 500 as e"), lambda a, r: sq.extremes(a, r, "excess")),
        "psum": on(array, sq.prefix_sums),
        "psum_rank": two(array, targets, sq.prefix_sum_rank),
        "run_length": on(array, sq.run_lengths),
        "run_lookup": lambda spark, d: sq.run_lookup(sq.run_lengths(array(spark, d)), table(spark, d, "orders").selectExpr("o_orderkey as pos")),
        "dominance_count": two(points, corner, lambda p, q: sq.dominance(p, q, "x", "y")),
        "rect_count": two(points, boxes, lambda p, b: sq.box_count(p, b, "x", "y")),
        "rect_list": two(points, boxes, lambda p, b: sq.in_boxes(p, b, "x", "y")),
        "grid_count": on(points, grid),
        "heatmap": on(points, heat),
        "point_count": on(points, lambda p: p.agg(F.count(F.lit(1)).alias("n"))),
    }


SEQ = "WITH q AS (SELECT p_partkey pos, p_size::BIGINT c FROM part), g AS (SELECT p_partkey qid, p_partkey b, p_partkey + 150 e, p_partkey % 60 k FROM part)"
BITS = "WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 pos, o_orderstatus = 'F' bit FROM orders)"
EXTENT = "WITH p AS (SELECT l_partkey x, l_suppkey y FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL), z AS (SELECT min(x) x1, max(x) + 1 x2, min(y) y1, max(y) + 1 y2 FROM p)"
ARRAY = """WITH a AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 pos, l_quantity::BIGINT v FROM lineitem)"""


def oracle_sql() -> dict[str, str]:
    rmq = ARRAY + ", r AS (SELECT o_orderkey qid, o_orderkey b, o_orderkey + 1 + o_custkey % 300 e FROM orders) SELECT qid, {0}(v) AS {0}, {1} AS {0}_at FROM r LEFT JOIN a ON pos >= b AND pos < e GROUP BY qid"
    return {
        "seq_access": SEQ + " SELECT pos, c FROM q",
        "seq_rank": SEQ + " SELECT pos, c, row_number() OVER (PARTITION BY c ORDER BY pos) - 1 AS rank FROM q",
        "seq_select": SEQ + " SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) - 1 AS r, pos FROM q",
        "seq_rank_all": SEQ + ', t AS (SELECT p_partkey qid, p_partkey % 53 c, p_partkey p FROM part) SELECT qid, count(*) FILTER (q.c < t.c) AS less, count(*) FILTER (q.c = t.c) AS equal, count(*) FILTER (q.c > t.c) AS "more" FROM t LEFT JOIN q ON pos < p GROUP BY qid',
        "seq_kth": SEQ + ", o AS (SELECT qid, k, c, pos, row_number() OVER (PARTITION BY qid ORDER BY c, pos) - 1 i FROM g JOIN q ON pos >= b AND pos < e), v AS (SELECT qid, c FROM o WHERE i = k) SELECT g.qid, v.c AS \"value\", min(o.pos) AS at FROM g LEFT JOIN v ON g.qid = v.qid LEFT JOIN o ON o.qid = v.qid AND o.c = v.c GROUP BY ALL",
        "seq_minmax": SEQ + " SELECT qid, min(c) AS min, (arg_min(struct_pack(p := pos), struct_pack(a := c, b := pos))).p AS min_at, max(c) AS max, (arg_min(struct_pack(p := pos), struct_pack(a := -c, b := pos))).p AS max_at FROM g LEFT JOIN q ON pos >= b AND pos < e GROUP BY qid",
        "rmq_min": rmq.format("min", "arg_min(pos, v * 1000000000 + pos)"),
        "rmq_max": rmq.format("max", "arg_min(pos, -v * 1000000000 + pos)"),
        "seq_box_count": SEQ + " SELECT qid, count(pos) AS n FROM g LEFT JOIN q ON pos >= b AND pos < e AND c >= k AND c < k + 17 GROUP BY qid",
        "seq_box_list": SEQ + " SELECT qid, pos, c FROM g JOIN q ON pos >= b AND pos < e AND c >= k AND c < k + 17",
        "wavelet_layers": SEQ + ", l AS (SELECT pos, c, unnest(range(6)) layer FROM q) SELECT layer::INTEGER AS layer, c >> (6 - layer)::INTEGER AS node, row_number() OVER (PARTITION BY layer, c >> (6 - layer)::INTEGER ORDER BY pos) - 1 AS idx, ((c >> (5 - layer)::INTEGER) % 2)::INTEGER AS bit FROM l",
        "bit_rank": BITS + ", s AS (SELECT pos, bit, coalesce(sum(bit::INTEGER) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT r FROM b) SELECT pos, bit, r AS rank1, pos - r AS rank0 FROM s",
        "bit_select1": BITS + " SELECT row_number() OVER (ORDER BY pos) - 1 AS r, pos FROM b WHERE bit",
        "bit_select0": BITS + " SELECT row_number() OVER (ORDER BY pos) - 1 AS r, pos FROM b WHERE NOT bit",
        "bit_next": BITS + " SELECT pos, coalesce(min(CASE WHEN bit THEN pos END) OVER w, -1) AS next1, coalesce(min(CASE WHEN NOT bit THEN pos END) OVER w, -1) AS next0 FROM b WINDOW w AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
        "bit_scan": BITS + ", k AS (SELECT pos, bit, row_number() OVER (PARTITION BY bit ORDER BY pos) - 1 r FROM b), m AS (SELECT pos, count(*) FILTER (bit) OVER w r1, count(*) FILTER (NOT bit) OVER w r0 FROM b WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT o_orderkey AS qid, coalesce(x.pos, -1) AS one, coalesce(y.pos, -1) AS zero FROM orders LEFT JOIN m ON m.pos = o_custkey LEFT JOIN k x ON x.bit AND x.r = r1 + o_orderkey % 40 LEFT JOIN k y ON NOT y.bit AND y.r = r0 + o_orderkey % 40",
        "rrr_rank": BITS + ", s AS (SELECT pos, bit, count(*) FILTER (bit) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) rank1 FROM b) SELECT pos, bit, rank1 FROM s WHERE pos IN (SELECT o_custkey FROM orders)",
        "rrr_select": BITS + ", k AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 r FROM b WHERE bit) SELECT r, pos FROM (SELECT DISTINCT o_custkey r FROM orders) LEFT JOIN k USING (r)",
        "value_ranks": ARRAY + " SELECT pos, v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM a",
        "popcount": BITS + " SELECT sum(bit::INTEGER)::BIGINT AS ones, count(*) AS length FROM b",
        "sparse_rank_select": "SELECT o_orderkey AS pos, coalesce(sum((o_orderstatus = 'F')::INTEGER) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank, o_orderstatus = 'F' AS is_set FROM orders",
        "excess": BITS + " SELECT pos, bit, sum(CASE WHEN bit THEN 1 ELSE -1 END) OVER (ORDER BY pos)::BIGINT AS excess FROM b",
        "excess_minmax": BITS + """, x AS (SELECT pos, (sum(CASE WHEN bit THEN 1 ELSE -1 END) OVER (ORDER BY pos))::BIGINT v FROM b), r AS (SELECT o_orderkey qid, o_orderkey b, o_orderkey + 1 + o_custkey % 500 e FROM orders)
SELECT qid, min(v) AS min, arg_min(pos, v * 1000000000 + pos) AS min_at, max(v) AS max, arg_min(pos, -v * 1000000000 + pos) AS max_at FROM r LEFT JOIN x ON pos >= r.b AND pos < e GROUP BY qid""",
        "psum": ARRAY + " SELECT pos, v, coalesce(sum(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS psum FROM a",
        "psum_rank": ARRAY + """, p AS (SELECT pos, coalesce(sum(v) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s FROM a UNION ALL SELECT max(pos) + 1, sum(v)::BIGINT FROM a),
m AS (SELECT s, min(pos) pos FROM p GROUP BY 1), t AS (SELECT o_orderkey * 101 target FROM orders)
SELECT target, coalesce(pos, (SELECT count(*) FROM a)) AS rank FROM t ASOF LEFT JOIN m ON target <= s""",
        "run_length": ARRAY + ", l AS (SELECT *, CASE WHEN v = lag(v) OVER (ORDER BY pos) THEN 0 ELSE 1 END n FROM a), g AS (SELECT *, sum(n) OVER (ORDER BY pos) g FROM l) SELECT min(pos) AS pos, v, count(*) AS n FROM g GROUP BY g, v",
        "run_lookup": ARRAY + " SELECT pos, v FROM a JOIN orders ON pos = o_orderkey",
        "dominance_count": "SELECT s_suppkey AS qid, count(l_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_partkey < s_suppkey * 19 AND l_suppkey < s_suppkey GROUP BY 1",
        "rect_count": "SELECT s_suppkey AS qid, count(l_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_partkey >= s_suppkey * 3 AND l_partkey < s_suppkey * 7 + 40 AND l_suppkey >= s_suppkey AND l_suppkey < s_suppkey + 30 GROUP BY 1",
        "rect_list": "SELECT s_suppkey AS qid, l_partkey AS x, l_suppkey AS y FROM supplier JOIN lineitem ON l_partkey >= s_suppkey * 3 AND l_partkey < s_suppkey * 7 + 40 AND l_suppkey >= s_suppkey AND l_suppkey < s_suppkey + 30",
        "grid_count": EXTENT + f""", e AS (SELECT i, j, x1 + (x2 - x1) * (i + 1) // {COLUMNS} ex, y1 + (y2 - y1) * (j + 1) // {ROWS} ey FROM z, (SELECT unnest(range({COLUMNS})) i), (SELECT unnest(range({ROWS})) j))
SELECT i::INTEGER AS i, j::INTEGER AS j, count(x) AS n FROM e LEFT JOIN p ON x < ex AND y < ey GROUP BY ALL""",
        "heatmap": EXTENT + """, h AS (SELECT x1, y1, greatest(x2 - x1, 17) // 17 dx, greatest(x2 - x1, 17) % 17 rx, greatest(y2 - y1, 9) // 9 dy, greatest(y2 - y1, 9) % 9 ry FROM z),
c AS (SELECT CASE WHEN x - x1 < rx * (dx + 1) THEN (x - x1) // (dx + 1) ELSE rx + (x - x1 - rx * (dx + 1)) // dx END bx,
             CASE WHEN y - y1 < ry * (dy + 1) THEN (y - y1) // (dy + 1) ELSE ry + (y - y1 - ry * (dy + 1)) // dy END by_, count(*) n FROM p, h GROUP BY ALL)
SELECT bx::INTEGER AS bx, by_::INTEGER AS by, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest(range(17)) bx), (SELECT unnest(range(9)) by_)) LEFT JOIN c USING (bx, by_)""",
        "point_count": "SELECT count(*) AS n FROM lineitem",
    }

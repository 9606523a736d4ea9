"""Queries on trees: the heap of part keys, and region, nation, supplier; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as tr
from ..operators.sequence import numbered
from ..operators.sharding import join_on
from ..sources import newick
from ..tables import table
from .sequences import ARRAY, array


def heap(spark, d):
    """Part keys from 1 as a binary heap: the parent of k is k div 2."""
    return table(spark, d, "part").where("p_partkey >= 1").selectExpr("p_partkey as id", "case when p_partkey > 1 then p_partkey div 2 end as parent")


def hierarchy(spark, d):
    """Regions over nations over suppliers, with ids that don't meet."""
    r = table(spark, d, "region").selectExpr("cast(r_regionkey as bigint) as id", "cast(null as bigint) as parent")
    n = table(spark, d, "nation").selectExpr("cast(n_nationkey + 1000 as bigint) as id", "cast(n_regionkey as bigint) as parent")
    s = table(spark, d, "supplier").selectExpr("cast(s_suppkey + 1000000 as bigint) as id", "cast(s_nationkey + 1000 as bigint) as parent")
    return r.unionByName(n).unionByName(s)


def texts(spark, d):
    """One bracket text per region: its nations with their keys as lengths."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    t = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = F.array_join(F.transform("l", lambda x: F.concat(x.n_name, F.lit(":"), x.n_nationkey.cast("string"))), ",")
    return t.select(F.col("r_regionkey").cast("bigint").alias("tree_id"), F.concat(F.lit("("), inner, F.lit(")"), "r_name", F.lit(";")).alias("text"))


def queries() -> dict:
    def on(src, f):
        return lambda spark, d: f(src(spark, d))

    def bp(spark, d):
        return tr.parentheses(tr.dfs(hierarchy(spark, d))).select("pos", "bit")

    def sizes(spark, d):
        return table(spark, d, "part").selectExpr("p_partkey as pos", "cast(p_size as bigint) as v")

    def pairs(spark, d):
        return table(spark, d, "part").where("p_partkey >= 1").selectExpr("p_partkey as qid", "p_partkey as a", "1 + (p_partkey * 7919) % p_partkey as b")

    def suppliers(spark, d):
        """Each supplier's node with one drawn from all suppliers by its place among their keys."""
        s = numbered(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], "s_suppkey", "i")
        n = s.count()
        one = s.selectExpr("s_suppkey as qid", "s_suppkey + 1000000 as a", f"(i * 31 + 7) % {max(n, 1)} as i")
        return join_on(one, s.selectExpr("i", "s_suppkey + 1000000 as b"), ["i"]).select("qid", "a", "b")

    def node_pairs(spark, d):
        """The brackets of each supplier and of the one drawn with it, the earlier first."""
        n = tr.dfs(hierarchy(spark, d))
        at = tr.parentheses(n).where("bit").select("id", "pos")
        p = suppliers(spark, d).select("qid", F.explode(F.array("a", "b")).alias("id"))
        return tr.parentheses(n).select("pos", "bit"), join_on(p, at, ["id"], "inner").groupBy("qid").agg(F.min("pos").alias("i"), F.max("pos").alias("j"))

    def quantities(spark, d):
        return array(spark, d)

    return {
        "tree_children": on(heap, tr.children),
        "tree_child_at": on(hierarchy, tr.child_at),
        "tree_depth": on(heap, tr.depths),
        "dfs_interval": on(hierarchy, tr.dfs),
        "lca": lambda spark, d: tr.lca(heap(spark, d), pairs(spark, d)),
        "lca_hierarchy": lambda spark, d: tr.lca(hierarchy(spark, d), suppliers(spark, d)),
        "bp_sequence": on(bp, lambda b: b),
        "bp_match": on(bp, tr.matches),
        "bp_enclose": on(bp, tr.enclosing),
        "bp_range_enclose": lambda spark, d: tr.range_enclosing(*node_pairs(spark, d)),
        "cartesian_parent": on(sizes, tr.cartesian_parents),
        "cartesian_parent_long": on(quantities, tr.cartesian_parents),
        "newick_nodes": on(texts, lambda t: newick.read(t).select("tree_id", "id", "parent", "child", "name", "length")),
        "newick_texts": on(texts, lambda t: newick.write(newick.read(t))),
    }


HIER = """WITH RECURSIVE t AS (SELECT r_regionkey::BIGINT id, NULL::BIGINT parent FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey FROM nation UNION ALL SELECT s_suppkey + 1000000, s_nationkey + 1000 FROM supplier),
cl AS (SELECT id, id anc, 0 dist FROM t UNION ALL SELECT cl.id, t.parent, dist + 1 FROM cl JOIN t ON cl.anc = t.id WHERE t.parent IS NOT NULL),
sz AS (SELECT anc id, count(*) size FROM cl GROUP BY 1),
sb AS (SELECT t.id, parent, size, coalesce(sum(size) OVER (PARTITION BY parent ORDER BY t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT bf FROM t JOIN sz USING (id)),
up AS (SELECT cl.id, max(dist)::BIGINT depth, (sum(bf) + max(dist))::BIGINT pre FROM cl JOIN sb ON cl.anc = sb.id GROUP BY 1),
f AS (SELECT sb.id, parent, depth, size, pre, pre + size - 1 - depth post FROM sb JOIN up USING (id)),
p AS (SELECT id, 2 * pre - depth pos, true bit FROM f UNION ALL SELECT id, 2 * pre - depth + 2 * size - 1, false FROM f)"""
HEAP = """WITH RECURSIVE t AS (SELECT p_partkey id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END parent FROM part WHERE p_partkey >= 1),
cl AS (SELECT id, id anc, 0::BIGINT dist FROM t UNION ALL SELECT cl.id, t.parent, dist + 1 FROM cl JOIN t ON cl.anc = t.id WHERE t.parent IS NOT NULL)"""
TEXTS = "WITH x AS (SELECT r_regionkey::BIGINT tree_id, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) i FROM region JOIN nation ON n_regionkey = r_regionkey)"
CARTESIAN = """, n AS (SELECT x.pos, x.v, (SELECT max(y.pos) FROM q y WHERE y.pos < x.pos AND y.v <= x.v) a, (SELECT min(y.pos) FROM q y WHERE y.pos > x.pos AND y.v < x.v) b FROM q x)
SELECT n.pos, n.v, CASE WHEN b IS NULL OR (a IS NOT NULL AND l.v > r.v) THEN a ELSE b END AS parent FROM n LEFT JOIN q l ON l.pos = a LEFT JOIN q r ON r.pos = b"""


def oracle_sql() -> dict[str, str]:
    return {
        "tree_children": HEAP + " SELECT t.id, count(k.id) AS children, count(k.id) = 0 AS is_leaf FROM t LEFT JOIN t k ON k.parent = t.id GROUP BY 1",
        "tree_child_at": HIER + " SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS i, id FROM t WHERE parent IS NOT NULL",
        "tree_depth": HEAP + " SELECT id, max(dist) AS depth FROM cl GROUP BY 1",
        "dfs_interval": HIER + " SELECT id, parent, depth, size, pre, post FROM f",
        "lca": HEAP + ", p AS (SELECT p_partkey qid, p_partkey a, 1 + (p_partkey * 7919) % p_partkey b FROM part WHERE p_partkey >= 1) SELECT qid, arg_min(x.anc, x.dist) AS lca FROM p JOIN cl x ON x.id = a JOIN cl y ON y.id = b AND x.anc = y.anc GROUP BY qid",
        "lca_hierarchy": HIER + ", o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 i, count(*) OVER () n FROM supplier), k AS (SELECT x.s_suppkey qid, x.s_suppkey + 1000000 a, y.s_suppkey + 1000000 b FROM o x JOIN o y ON y.i = (x.i * 31 + 7) % x.n), m AS (SELECT qid, arg_min(x.anc, x.dist) lca FROM k JOIN cl x ON x.id = a JOIN cl y ON y.id = b AND x.anc = y.anc GROUP BY qid) SELECT qid, lca FROM k LEFT JOIN m USING (qid)",
        "bp_sequence": HIER + " SELECT pos, bit FROM p",
        "bp_match": HIER + " SELECT x.pos, x.bit, y.pos AS match FROM p x JOIN p y ON x.id = y.id AND x.bit <> y.bit",
        "bp_enclose": HIER + " SELECT x.pos, y.pos AS enclose FROM p x JOIN t USING (id) LEFT JOIN p y ON y.id = t.parent AND y.bit WHERE x.bit",
        "bp_range_enclose": HIER + """, o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 i, count(*) OVER () n FROM supplier),
k AS (SELECT x.s_suppkey qid, x.s_suppkey + 1000000 a, y.s_suppkey + 1000000 b FROM o x JOIN o y ON y.i = (x.i * 31 + 7) % x.n),
m AS (SELECT x.id, x.pos, y.pos cl FROM p x JOIN p y ON x.id = y.id AND x.bit AND NOT y.bit), ij AS (SELECT qid, least(x.pos, y.pos) i, greatest(x.pos, y.pos) j FROM k JOIN m x ON x.id = a JOIN m y ON y.id = b)
SELECT ij.qid, min(e.pos) AS pos FROM ij JOIN m c ON c.pos = i LEFT JOIN m e ON e.pos > c.cl AND e.pos < j AND e.cl > j GROUP BY 1""",
        "cartesian_parent_long": ARRAY + """, q AS (SELECT pos, v FROM a), u AS (SELECT DISTINCT v FROM q),
n AS (SELECT q.pos, q.v, max(y.pos) a FROM q JOIN u ON u.v <= q.v ASOF LEFT JOIN q y ON y.v = u.v AND q.pos > y.pos GROUP BY ALL),
m AS (SELECT q.pos, min(y.pos) b FROM q JOIN u ON u.v < q.v ASOF LEFT JOIN q y ON y.v = u.v AND q.pos < y.pos GROUP BY ALL)
SELECT n.pos, n.v, CASE WHEN b IS NULL OR (a IS NOT NULL AND l.v > r.v) THEN a ELSE b END AS parent FROM n LEFT JOIN m USING (pos) LEFT JOIN q l ON l.pos = a LEFT JOIN q r ON r.pos = b""",
        "cartesian_parent": "WITH q AS (SELECT p_partkey pos, p_size::BIGINT v FROM part)" + CARTESIAN,
        "newick_nodes": TEXTS + " SELECT tree_id, 0::BIGINT AS id, NULL::BIGINT AS parent, 0::BIGINT AS child, any_value(r_name) AS name, NULL::DOUBLE AS length FROM x GROUP BY 1 UNION ALL SELECT tree_id, i, 0, i - 1, n_name, n_nationkey::DOUBLE FROM x",
        "newick_texts": TEXTS + " SELECT tree_id, '(' || string_agg(n_name || ':' || n_nationkey, ',' ORDER BY i) || ')' || any_value(r_name) || ';' AS text FROM x GROUP BY 1",
    }

import random

import pytest

from rangeloom.operators import trees as tr
from rangeloom.sources import newick


def random_tree(n, seed):
    rng = random.Random(seed)
    return [(0, None)] + [(i, rng.randrange(max(0, i - 5), i)) for i in range(1, n)]


def walk(tree):
    kids = {}
    for i, p in sorted(tree):
        kids.setdefault(p, []).append(i)
    out, bp, stack = {}, [], [(r, 0, False) for r in reversed(kids[None])]
    pre = post = 0
    while stack:
        i, d, done = stack.pop()
        bp.append(not done)
        if done:
            out[i] = (*out[i], post)
            post += 1
            continue
        out[i] = (d, pre)
        pre += 1
        stack.append((i, d, True))
        stack += [(k, d + 1, False) for k in reversed(kids.get(i, []))]
    return out, bp


def test_numbering_and_parentheses(spark, monkeypatch):
    monkeypatch.setattr(tr, "SHARD", 8)
    tree = random_tree(120, 1) + [(500, None), (501, 500)]
    df = spark.createDataFrame(tree, "id bigint, parent bigint")
    want, bp = walk(tree)
    n = tr.dfs(df)
    assert {r["id"]: (r["depth"], r["pre"], r["post"]) for r in n.collect()} == want
    bits = tr.parentheses(n).select("pos", "bit")
    assert [r["bit"] for r in bits.orderBy("pos").collect()] == bp
    stack, match, around = [], {}, {}
    for i, b in enumerate(bp):
        if b:
            around[i] = stack[-1] if stack else None
            stack.append(i)
        else:
            j = stack.pop()
            match[i], match[j] = j, i
    assert {r["pos"]: r["match"] for r in tr.matches(bits).collect()} == match
    assert {r["pos"]: r["enclose"] for r in tr.enclosing(bits).collect()} == around


def test_lca(spark):
    tree = random_tree(80, 2) + [(900, None)]
    parent = dict(tree)

    def up(i):
        out = [i]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    rng = random.Random(3)
    pairs = [(q, rng.randrange(80), rng.randrange(80)) for q in range(60)] + [(100, 900, 3), (101, 5, 5), (102, 0, 79), (103, 12345, 1)]
    got = {r["qid"]: r["lca"] for r in tr.lca(spark.createDataFrame(tree, "id bigint, parent bigint"), spark.createDataFrame(pairs, "qid bigint, a bigint, b bigint")).collect()}
    for q, a, b in pairs:
        assert got[q] == (next((x for x in up(a) if x in up(b)), None) if a in parent else None)


def test_chain_and_cycle(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "id bigint, parent bigint")
    assert {r["id"]: r["depth"] for r in tr.depths(chain).collect()} == {i: i for i in range(100)}
    for width in (1 << 16, 1):
        with pytest.raises(Exception, match="cycle"):
            tr.tour(spark.createDataFrame([(1, 2), (2, 1), (5, None)], "id bigint, parent bigint"), width).collect()
    assert tr.tour(chain.limit(0)).collect() == [] and tr.dfs(chain.limit(0)).collect() == []


def test_long_path(spark):
    # deeper than any table of ancestors could be, the ids in no order
    n = 100_000
    path = spark.range(n).selectExpr("(id * 7919) % 100003 as id", "if(id = 0, null, ((id - 1) * 7919) % 100003) as parent", "id as d")
    got = tr.depths(path)
    assert got.count() == n and got.join(path, "id").where("depth <> d").isEmpty()


@pytest.mark.parametrize("width", [1, 4, 1 << 16])
def test_tour_by_groups(spark, width):
    tree = random_tree(60, 4) + [(70, None), (71, 12345), (72, 72), (-5, 3)]
    t = tr.tour(spark.createDataFrame(tree, "id bigint, parent bigint"), width).orderBy("pos").collect()
    _, bp = walk([(i, None if p in (12345, i) else p) for i, p in tree])
    assert [r["pos"] for r in t] == list(range(2 * len(tree))) and [r["enters"] for r in t] == bp
    assert t[-1]["depth"] == 0 and t[-1]["node"] is None


def parents(v):
    out = {}
    for i, x in enumerate(v):
        a = next((j for j in range(i - 1, -1, -1) if v[j] <= x), None)
        b = next((j for j in range(i + 1, len(v)) if v[j] < x), None)
        out[i] = a if b is None or (a is not None and v[a] > v[b]) else b
    return out


@pytest.mark.parametrize("v", [[2, 4, 7, 8, 1, 6, 3, 9, 5], [3] * 40, list(range(50)), list(range(50, 0, -1)), [random.Random(7).randrange(20) for _ in range(300)], [5], [100 - 10 * (i // 8) + i % 8 for i in range(90)], [10 * (i // 8) - i % 8 for i in range(90)]])
def test_cartesian(spark, v, monkeypatch):
    monkeypatch.setattr(tr, "SHARD", 8)
    smaller = tr.smaller
    monkeypatch.setattr(tr, "smaller", lambda s: smaller(s, 8))
    df = spark.createDataFrame(list(enumerate(v)), "pos bigint, v bigint")
    assert {r["pos"]: r["parent"] for r in tr.cartesian_parents(df).collect()} == parents(v)


TEXTS = ["(a:1,b)c;", "((x,y:2.5)z:0.125,(,q))r;", ";", "lone;", "(((deep)))d:3;"]


def test_newick(spark):
    assert newick.parse("(a:1,b)c;") == [(0, None, 0, "c", None), (1, 0, 0, "a", 1.0), (2, 0, 1, "b", None)]
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(7, None)], "tree_id bigint, text string")
    assert {r["tree_id"]: r["text"] for r in newick.write(newick.read(df)).collect()} == dict(enumerate(TEXTS))
    for bad in ("(a,b", "(a,b;", "a,b);", "(a,b)c", "(a:x);", "a(b);", "(a);b"):
        with pytest.raises(ValueError):
            newick.parse(bad)
    rows = newick.read(spark.createDataFrame([(1, "(a"), (2, "(a);")], "tree_id bigint, text string")).collect()
    assert [r["error"] is None for r in sorted(rows, key=lambda r: r["tree_id"])] == [False, True, True]

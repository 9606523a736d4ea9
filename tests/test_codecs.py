import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import bits as b
from rangeloom.functions import codes as c
from rangeloom.functions import text as t
from rangeloom.operators import codecs as cd

ARRAYS = [[0] * 130, [1] * 130, [0, 1] * 65, list(range(130)), [random.Random(1).randrange(1000) for _ in range(300)], [7], [random.Random(2).choice([5, 5, 5, 90, 2, 3]) for _ in range(200)]]


def array(spark, v):
    return spark.createDataFrame(list(enumerate(v)), "pos bigint, v bigint")


@pytest.mark.parametrize("v", ARRAYS)
def test_round_trips(spark, v):
    a, want = array(spark, v), dict(enumerate(v))
    get = lambda df: {r["pos"]: r["v"] for r in df.collect()}
    assert get(cd.diff_decode(cd.diff_encode(a))) == want
    assert get(cd.front_to_values(cd.move_to_front(a, 64), 64)) == want
    assert get(cd.unmap(cd.remap(a, 3), a, 3)) == want
    table = {r["v"]: r["code"] for r in cd.huffman_table(a).collect()}
    text = "".join(r["code"] for r in cd.huffman_encode(a, cd.huffman_table(a)).orderBy("pos").collect())
    back, at, decode = [], "", {x: k for k, x in table.items()}
    for ch in text:
        at += ch
        if at in decode:
            back.append(decode[at])
            at = ""
    assert back == v and at == ""


def test_sizes(spark):
    v = [0] * 8 + [1] * 4 + [2] * 2 + [3] * 2
    r = cd.sizes(array(spark, v)).head()
    assert (r["length"], r["distinct"], r["huffman_bits"]) == (16, 4, 28) and abs(r["entropy_bits"] - 28) < 1e-9
    assert cd.huffman_lengths({1: 5}) == {1: 1} and cd.canonical({5: 1, 2: 2, 9: 2}) == {5: "0", 2: "10", 9: "11"}


def test_huffman_groups():
    rng = random.Random(4)
    for _ in range(200):
        counts = {i: rng.choice([1, 1, 1, 2, 3, 5, 8, 13, 100, rng.randint(1, 1000)]) for i in range(rng.randint(1, 60))}
        times = {}
        for c in counts.values():
            times[c] = times.get(c, 0) + 1
        groups, plain = cd.huffman_groups(times), cd.huffman_lengths(counts)
        assert {c: sum(x.values()) for c, x in groups.items()} == times
        assert sum(c * d * k for c, x in groups.items() for d, k in x.items()) == sum(counts[s] * n for s, n in plain.items())
        assert len(counts) == 1 or sum(k / 2**d for x in groups.values() for d, k in x.items()) == 1


def test_huffman_of_many_values(spark):
    a = spark.range(200_000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, F.lit(-7)).otherwise(F.col("id") * 7).cast("bigint").alias("v"))
    t = cd.huffman_table(a).cache()
    assert t.count() == 133_334 and t.where("bits <> length(code)").isEmpty() and t.select("code").distinct().count() == 133_334
    assert abs(t.selectExpr("sum(pow(2.0, -bits))").head()[0] - 1) < 1e-9
    e = cd.huffman_encode(a, t)
    assert e.count() == 200_000 and e.agg(F.sum(F.length("code"))).head()[0] == t.agg(F.sum(F.col("n") * F.col("bits"))).head()[0]
    t.unpersist()


def test_top_symbols(spark):
    v = [1] * 5 + [2] * 5 + [3] * 2 + list(range(10, 30))
    got = [tuple(r) for r in cd.top_symbols(array(spark, v)).orderBy(F.col("n").desc(), F.col("v").desc()).collect()]
    assert got[:3] == [(2, 5), (1, 5), (3, 2)] and len(got) == 8
    remap = {r["v"]: r["code"] for r in cd.remap(array(spark, v), 2).collect()}
    assert sorted(remap.values()) == sorted(set(remap.values())) and {remap[2], remap[1]} == {0, 1}


def test_codes(spark):
    n = [1, 2, 3, 4, 5, 8, 9, 127, 128, 16384, 10**12]
    rows = spark.createDataFrame([(x,) for x in n], "n bigint").select(
        "n", c.gamma_bits(F.col("n")).alias("g"), c.gamma_code(F.col("n")).alias("gc"), c.delta_bits(F.col("n")).alias("d"), c.delta_code(F.col("n")).alias("dc"), c.vbyte_len(F.col("n")).alias("v"),
        c.vbyte_code(F.col("n")).alias("vc"), c.fibonacci_bits(F.col("n")).alias("f"), c.rice_bits(F.col("n"), 3).alias("r"), c.golomb_bits(F.col("n"), 5).alias("go"),
    )
    for r in rows.collect():
        x, k = r["n"], r["n"].bit_length() - 1
        assert r["g"] == 2 * k + 1 == len(r["gc"]) and int(r["gc"], 2) == x
        m = (k + 1).bit_length() - 1
        assert r["d"] == 2 * m + 1 + k == len(r["dc"])
        raw = bytes.fromhex(r["vc"])
        assert len(raw) == r["v"] and sum((y & 127) << (7 * i) for i, y in enumerate(raw)) == x and all(y > 127 for y in raw[:-1]) and raw[-1] < 128
        fib, count, rest = [1, 2], 0, x
        while fib[-1] <= x:
            fib.append(fib[-1] + fib[-2])
        top = max(i for i, y in enumerate(fib) if y <= x)
        assert r["f"] == top + 2 and r["r"] == x // 8 + 4 and r["go"] == x // 5 + 1 + (2 if x % 5 < 3 else 3)
    u = spark.createDataFrame([(x,) for x in range(-20, 21)], "v bigint").select("v", c.to_unsigned(F.col("v")).alias("u"), c.to_signed(c.to_unsigned(F.col("v"))).alias("s")).collect()
    assert sorted(r["u"] for r in u) == list(range(41)) and all(r["s"] == r["v"] for r in u)


def test_bits(spark):
    words = [1, 2, 3, 5, 64, 255, 2**40 + 2**3, 2**62, -1, -(2**63)]
    x = F.col("x")
    rows = spark.createDataFrame([(w,) for w in words], "x bigint").select(
        "x", b.popcount(x).alias("ones"), b.msb(x).alias("msb"), b.lsb(x).alias("lsb"), b.ceil_log2(x).alias("up"), b.floor_log2(x).alias("down"), b.select_in_word(x, 1).alias("second"),
        b.binary_text(x, 8).alias("text"), b.reversed_bits(x, 8).alias("rev"), b.field(x, 2, 4).alias("field"), b.with_field(x, 2, 4, F.lit(9)).alias("set"), b.bit_length(x).alias("len"),
    )
    for r in rows.collect():
        w = r["x"] % 2**64
        on = [i for i in range(64) if w >> i & 1]
        assert (r["ones"], r["msb"], r["lsb"], r["len"]) == (len(on), on[-1], on[0], w.bit_length())
        assert r["second"] == (on[1] if len(on) > 1 else None) and r["field"] == w >> 2 & 15 and r["set"] % 2**64 == w & ~60 | 36
        assert r["text"] == f"{w & 255:08b}"[::-1] and r["rev"] == int(r["text"], 2)
        if r["x"] > 0:
            assert r["down"] == w.bit_length() - 1 and r["up"] == (w - 1).bit_length()
    zero = spark.createDataFrame([(0,)], "x bigint").select(b.msb(x), b.lsb(x), b.floor_log2(x), b.bit_length(x), b.popcount(x)).head()
    assert tuple(zero) == (None, None, None, 0, 0)


def test_text(spark):
    v = [0.0, -0.0, 1.5, -2.25, 0.000001, 1e-9, 123456.789, float("nan"), None, 100.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(t.number_text(F.col("v"))).collect()]
    assert got == ["0", "0", "1.5", "-2.25", "0.000001", "0", "123456.789", "nan", None, "100"]

    def fnv(x):
        h = 2166136261
        for y in x.encode():
            h = (h * 16777619) % 2**32 ^ y
        return h

    s = ["", "a", "foobar", "é\n", " a  b\t"]
    rows = spark.createDataFrame([(x,) for x in s], "s string").select("s", t.fnv1_32(F.col("s")).alias("h"), t.tokens(F.col("s")).alias("t"), t.trimmed(F.col("s")).alias("m")).collect()
    assert [r["h"] for r in rows] == [fnv(x) for x in s] and rows[4]["t"] == ["a", "b"] and rows[3]["m"] == "é"
    p = spark.createDataFrame([("a/b/c.txt",), ("c",), ("x/.hid",)], "p string").select(t.directory(F.col("p")), t.base_name(F.col("p")), t.extension(F.col("p"))).collect()
    assert [tuple(r) for r in p] == [("a/b", "c.txt", ".txt"), ("", "c", ""), ("x", ".hid", "")]


@pytest.mark.parametrize("method", ["gamma", "delta", "fibonacci", "rice:0", "rice:4", "golomb:1", "golomb:5", "golomb:8", "vbyte", "huffman", "arithmetic", "adaptive", "adaptive_huffman", "rans"])
def test_bitstreams(spark, method):
    from rangeloom.operators import bitstreams as bs

    for v in ARRAYS[:5] + [[2**40, 0, 1, 127, 128, 129] if method not in ("rice:0", "rice:4") and "golomb" not in method else [9, 0, 300]]:
        blocks = bs.encode(array(spark, v), method, 64)
        assert {r["pos"]: r["v"] for r in bs.decode(blocks, method).collect()} == dict(enumerate(v)), v[:5]
    with pytest.raises(Exception, match="0 or more"):
        bs.encode(array(spark, [-1]), method).collect()


def test_bitstream_sizes(spark):
    from rangeloom.operators import bitstreams as bs

    v = [random.Random(5).choice([0] * 12 + [1] * 3 + [2]) for _ in range(512)]
    size = {m: bs.encode(array(spark, v), m).select(F.length("payload")).head()[0] for m in ("gamma", "huffman", "arithmetic", "adaptive", "rans")}
    bits = cd.sizes(array(spark, v)).head()
    assert size["huffman"] == -(-bits["huffman_bits"] // 8) and abs(size["arithmetic"] - bits["entropy_bits"] / 8) < 3 and abs(size["rans"] - bits["entropy_bits"] / 8) < 10 and size["adaptive"] < size["huffman"] + 4

"""Queries on integer codes, words, texts and aggregates; and their SQL."""

from __future__ import annotations

from math import comb

from pyspark.sql import functions as F

from ..functions import bits as b
from ..functions import codes as c
from ..functions import text as t
from ..operators import bitstreams as bs
from ..operators import codecs as cd
from ..tables import table
from .sequences import ARRAY, array


#: Codes whose packed blocks are decoded again by a query of their own.
PACKED = ("gamma", "delta", "fibonacci", "rice:4", "golomb:11", "vbyte", "huffman", "arithmetic", "adaptive", "adaptive_huffman", "rans")


#: The code of value v in SQL, for the codes that SQL can write.
PAYLOADS = {
    "gamma": "repeat('0', length(ltrim(bin(v + 1), '0')) - 1) || ltrim(bin(v + 1), '0')",
    "delta": "repeat('0', length(ltrim(bin(length(ltrim(bin(v + 1), '0'))), '0')) - 1) || ltrim(bin(length(ltrim(bin(v + 1), '0'))), '0') || (ltrim(bin(v + 1), '0'))[2:]",
    "rice:4": "repeat('0', (v >> 4)::INTEGER) || '1' || right(lpad(bin(v & 15), 8, '0'), 4)",
    "golomb:11": "repeat('0', (v // 11)::INTEGER) || '1' || CASE WHEN v % 11 < 5 THEN right(lpad(bin(v % 11), 8, '0'), 3) ELSE right(lpad(bin(v % 11 + 5), 8, '0'), 4) END",
    "vbyte": "right(lpad(bin(v), 64, '0'), 8)",
}


def words(spark, d):
    """64-bit words from order keys and prices."""
    return table(spark, d, "orders").selectExpr("o_orderkey as id", "o_orderkey * 2654435761 + cast(round(o_totalprice * 100) as bigint) as x")


def numbers(spark, d):
    """Numbers from 1 on, of very different size."""
    return table(spark, d, "orders").selectExpr("o_orderkey as id", "1 + shiftright(o_orderkey * 2654435761, cast(o_orderkey % 40 as int)) as n")


def queries() -> dict:
    def on(src, f):
        return lambda spark, d: f(src(spark, d))

    def number(**cols):
        return on(numbers, lambda x: x.select("id", "n", *[f(F.col("n")).alias(k) for k, f in cols.items()]))

    def docs(f):
        return lambda spark, d: f(table(spark, d, "documents"))

    packed = {f"packed_{m.replace(':', '_')}": on(array, lambda a, m=m: bs.decode(bs.encode(a, m), m)) for m in PACKED}
    packed |= {f"payload_{m.replace(':', '_')}": on(array, lambda a, m=m: bs.encode(a, m).select("block", "start", "n", F.hex("payload").alias("payload"))) for m in PAYLOADS}
    return packed | {
        "gamma_bits": number(bits=c.gamma_bits, code=c.gamma_code),
        "delta_bits": number(bits=c.delta_bits, code=c.delta_code),
        "rice_bits": number(bits=lambda n: c.rice_bits(n, 5)),
        "golomb_bits": number(bits=lambda n: c.golomb_bits(n, 11)),
        "vbyte_len": number(bytes=c.vbyte_len, code=c.vbyte_code),
        "fibonacci_bits": number(bits=c.fibonacci_bits),
        "zigzag": on(array, lambda a: a.select("pos", c.to_unsigned(F.col("v") - 25).alias("u"), c.to_signed(c.to_unsigned(F.col("v") - 25)).alias("back"))),
        "diff64_encode": on(array, cd.diff_encode),
        "diff64_decode": on(array, lambda a: cd.diff_decode(cd.diff_encode(a))),
        "differences": on(array, cd.differences),
        "histogram": on(array, cd.histogram),
        "topk_symbols": on(array, lambda a: cd.top_symbols(a, 20)),
        "remap": on(array, lambda a: cd.remap(a, 20)),
        "remap_back": on(array, lambda a: cd.unmap(cd.remap(a, 20), a, 20)),
        "huffman_table": on(array, lambda a: cd.huffman_table(a).select("v", "n", "bits", "code")),
        "huffman_encode": on(array, lambda a: cd.huffman_encode(a, cd.huffman_table(a))),
        "code_sizes": on(array, lambda a: cd.sizes(a).withColumn("entropy_bits", F.round("entropy_bits", 1))),
        "move_to_front": on(array, cd.move_to_front),
        "front_to_values": on(array, lambda a: cd.front_to_values(cd.move_to_front(a))),
        "adaptive_golomb_bits": on(array, cd.adaptive_golomb_bits),
        "adaptive_bits": on(array, cd.adaptive_bits),
        "rrr_bits": on(words, lambda w: w.select("id", c.rrr_bits(F.expr("x & 9223372036854775807")).alias("bits"))),
        "compressed_sizes": docs(lambda x: cd.compressed_sizes(x.select("doc_id", "text")).drop("text")),
        "bit_functions": on(words, lambda w: w.select("id", b.popcount(F.col("x")).alias("ones"), b.bit_length(F.col("x")).alias("length"), b.msb(F.col("x")).alias("msb"), b.lsb(F.col("x")).alias("lsb"), b.ceil_log2(F.col("x")).alias("ceil_log2"), b.floor_log2(F.col("x")).alias("floor_log2"))),
        "bit_fields": on(words, lambda w: w.select("id", b.field(F.col("x"), 7, 13).alias("field"), b.with_field(F.col("x"), 3, 8, F.col("id")).alias("changed"), b.select_in_word(F.col("x"), 3).alias("fourth"), b.binary_text(F.col("x"), 24).alias("text"), b.reversed_bits(F.col("x"), 32).alias("reversed"), b.ceil_div(F.col("x"), 97).alias("parts"))),
        "md5_hex": docs(lambda x: x.select("doc_id", F.md5("text").alias("md5"))),
        "fnv_hash": lambda spark, d: table(spark, d, "part").select("p_partkey", t.fnv1_32(F.col("p_name")).alias("fnv")),
        "short_hashes": lambda spark, d: table(spark, d, "part").select("p_partkey", t.fnv1a_32(F.col("p_name")).alias("fnv1a"), t.fnv1a_24(F.col("p_name")).alias("fnv24"), t.pearson(F.col("p_name")).alias("pearson")),
        "rrr_words": on(words, lambda w: w.select("id", F.expr("x & 9223372036854775807").alias("x")).select("id", F.bit_count("x").cast("int").alias("ones"), c.rrr_offset(F.col("x")).alias("offset"), c.rrr_word(F.bit_count("x"), c.rrr_offset(F.col("x"))).alias("back"))),
        "string_funcs": docs(lambda x: x.select("doc_id", t.trimmed(F.col("subject")).alias("trimmed"), F.size(t.tokens(F.col("subject"))).alias("tokens"), F.col("sender").endswith(".org").alias("org"), F.concat_ws("/", "source", "lang").alias("path"))),
        "path_funcs": docs(lambda x: x.select("doc_id", t.directory(F.col("source")).alias("dir"), t.base_name(F.col("source")).alias("base"), t.extension(F.col("message_id")).alias("ext"))),
        "number_texts": lambda spark, d: table(spark, d, "bed_signal").select("row_id", t.number_text(F.col("val")).alias("text"), t.decimals(F.when(~F.isnan("val"), F.col("val"))).alias("decimals")),
        "strict_parse": lambda spark, d: table(spark, d, "bed_lines").select("line_id", F.split("line", "\t").alias("f")).select("line_id", t.strict_long(F.get("f", F.lit(1))).alias("st"), t.strict_double(F.get("f", F.lit(3))).alias("val")),
        "text_dump": on(array, lambda a: a.groupBy(F.expr("pos div 512").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("l")).select("block", F.concat(F.lit("{"), F.array_join(F.transform("l", lambda x: x.v.cast("string")), ","), F.lit("}")).alias("text"))),
        "array_stats": on(array, lambda a: a.agg(F.sum("v").alias("total"), F.count("v").alias("length"), F.countDistinct("v").alias("distinct"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.var_pop("v"), 6).alias("var"))),
        "exact_sums": lambda spark, d: table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("total"), F.max(t.decimals(F.col("l_extendedprice"))).alias("decimals")),
        "value_codes": lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 100).cast("bigint").alias("code")).distinct(),
    }


N = "WITH x AS (SELECT o_orderkey id, 1 + ((o_orderkey * 2654435761) >> (o_orderkey % 40)) n FROM orders), y AS (SELECT id, n, length(ltrim(bin(n), '0')) - 1 k, ltrim(bin(n), '0') t FROM x)"
W = "WITH w AS (SELECT o_orderkey id, o_orderkey * 2654435761 + CAST(round(o_totalprice * 100) AS BIGINT) x FROM orders), y AS (SELECT id, x, ltrim(bin(x), '0') t FROM w)"


def oracle_sql() -> dict[str, str]:
    fib = [1, 2]
    while len(fib) < 80:
        fib.append(fib[-1] + fib[-2])
    u = "CASE WHEN {0} > 0 THEN 2 * ({0}) - 1 ELSE -2 * ({0}) END"
    top = ARRAY + ", h AS (SELECT v, count(*) n FROM a GROUP BY 1), p AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v DESC) i FROM h), t AS (SELECT * FROM p WHERE i <= 20 AND (n > 1 OR i <= 8))"
    nibbles = [f"{i:04b}" for i in range(16)]
    payload = ARRAY + f""", t AS (SELECT pos >> 9 AS block, min(pos) AS start, count(*) AS n, string_agg({{}}, '' ORDER BY pos) b FROM a GROUP BY 1), p AS (SELECT block, start, n, b || repeat('0', (-length(b) % 8 + 8) % 8) b FROM t)
SELECT block, start, n, array_to_string(list_transform(range(length(b) // 4), lambda i: ('0123456789ABCDEF')[list_position({nibbles}, b[4 * i + 1 : 4 * i + 4])]), '') AS payload FROM p"""
    return {f"payload_{m.replace(':', '_')}": payload.format(e) for m, e in PAYLOADS.items()} | {f"packed_{m.replace(':', '_')}": ARRAY + " SELECT pos, v FROM a" for m in PACKED} | {
        "gamma_bits": N + " SELECT id, n, (2 * k + 1)::INTEGER AS bits, repeat('0', k) || t AS code FROM y",
        "delta_bits": N + ", z AS (SELECT *, length(ltrim(bin(k + 1), '0')) - 1 m FROM y) SELECT id, n, (2 * m + 1 + k)::INTEGER AS bits, repeat('0', m) || ltrim(bin(k + 1), '0') || t[2:] AS code FROM z",
        "rice_bits": N + " SELECT id, n, (n >> 5) + 6 AS bits FROM y",
        "golomb_bits": N + " SELECT id, n, n // 11 + 1 + CASE WHEN n % 11 < 5 THEN 3 ELSE 4 END AS bits FROM y",
        "vbyte_len": N + ", z AS (SELECT id, n, k // 7 l FROM y) SELECT id, n, (l + 1)::INTEGER AS bytes, array_to_string(list_transform(range(l + 1), lambda i: lpad(to_hex(((n >> (7 * i)) & 127) + CASE WHEN i < l THEN 128 ELSE 0 END), 2, '0')), '') AS code FROM z",
        "fibonacci_bits": N + f" SELECT id, n, (len(list_filter({fib}::BIGINT[], lambda f: f <= n)) + 1)::INTEGER AS bits FROM y",
        "zigzag": ARRAY + f" SELECT pos, {u.format('v - 25')} AS u, v - 25 AS back FROM a",
        "diff64_encode": ARRAY + f", l AS (SELECT pos, v, v - lag(v) OVER (ORDER BY pos) d FROM a) SELECT pos, CASE WHEN pos % 64 = 0 THEN v ELSE {u.format('d')} END AS code FROM l",
        "diff64_decode": ARRAY + " SELECT pos, v FROM a",
        "differences": ARRAY + " SELECT pos, v - coalesce(lag(v) OVER (ORDER BY pos), 0) AS diff, -v AS neg FROM a",
        "histogram": ARRAY + " SELECT v, count(*) AS n FROM a GROUP BY 1",
        "topk_symbols": top + " SELECT v, n FROM t",
        "remap": top + """, s AS (SELECT v, i - 1 code FROM t), f AS (SELECT v x, row_number() OVER (ORDER BY v) i FROM s WHERE v NOT IN (SELECT code FROM s)), l AS (SELECT code x, row_number() OVER (ORDER BY code) i FROM s WHERE code NOT IN (SELECT v FROM s)),
m AS (SELECT v, code FROM s UNION ALL SELECT l.x, f.x FROM l JOIN f USING (i)) SELECT pos, a.v, coalesce(code, a.v) AS code FROM a LEFT JOIN m ON a.v = m.v""",
        "remap_back": ARRAY + " SELECT pos, v FROM a",
        "front_to_values": ARRAY + " SELECT pos, v FROM a",
        "rrr_bits": W + f" SELECT id, ({[(comb(63, k) - 1).bit_length() for k in range(64)]}[bit_count(x) + 1] + 6)::INTEGER AS bits FROM w",
        "rrr_words": W + f", o AS (SELECT id, x, list_filter(range(63), lambda i: (x >> i::INTEGER) & 1 = 1) o FROM w) SELECT id, bit_count(x)::INTEGER AS ones, list_sum(list_transform(range(len(o)), lambda i: ({[comb(n, k) for n in range(63) for k in range(64)]})[(62 - o[i + 1]) * 64 + len(o) - i + 1]))::BIGINT AS \"offset\", x AS back FROM o",
        "short_hashes": """WITH b AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT) b FROM part),
h AS (SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, b), lambda h, x: (xor(h, x) * 16777619) & 4294967295) f, list_reduce(list_prepend(0::BIGINT, b), lambda h, x: (167 * xor(h, x) + 13) % 256) p FROM b)
SELECT p_partkey, f AS fnv1a, xor(f >> 24, f & 16777215) AS fnv24, p AS pearson FROM h""",
        "bit_functions": W + " SELECT id, bit_count(x)::INTEGER AS ones, length(t)::INTEGER AS length, (length(t) - 1)::INTEGER AS msb, (length(t) - length(rtrim(t, '0')))::INTEGER AS lsb, CASE WHEN x = 1 THEN 0 ELSE length(ltrim(bin(x - 1), '0')) END::INTEGER AS ceil_log2, (length(t) - 1)::INTEGER AS floor_log2 FROM y",
        "bit_fields": W + """, z AS (SELECT *, reverse(right(lpad(t, 64, '0'), 24)) t24, reverse(right(lpad(t, 64, '0'), 32)) t32, list_filter(range(63), lambda i: (x >> i::INTEGER) & 1 = 1) o FROM y)
SELECT id, (x >> 7) & 8191 AS field, (x & ~2040::BIGINT) | ((id & 255) << 3) AS changed, o[4]::INTEGER AS fourth, t24 AS text, list_reduce(list_transform(range(32), lambda i: ((t32[(i + 1)::INTEGER])::BIGINT) << (31 - i)::INTEGER), lambda p, q: p + q) AS reversed, (x + 96) // 97 AS parts FROM z""",
        "md5_hex": "SELECT doc_id, md5(text) AS md5 FROM documents",
        "fnv_hash": "SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, b: xor((h * 16777619) & 4294967295, b)) AS fnv FROM part",
        "string_funcs": r"SELECT doc_id, regexp_replace(subject, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS trimmed, len(list_filter(regexp_split_to_array(subject, '[ \t]'), lambda x: x <> ''))::INTEGER AS tokens, ends_with(sender, '.org') AS org, concat_ws('/', source, lang) AS path FROM documents",
        "path_funcs": "SELECT doc_id, regexp_extract(source, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(source, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(message_id, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1) AS ext FROM documents",
        "number_texts": r"WITH x AS (SELECT row_id, val, regexp_replace(CAST(round(CASE WHEN isnan(val) THEN NULL ELSE val END, 6) AS DECIMAL(30,6))::VARCHAR, '0+$', '') t FROM bed_signal) SELECT row_id, CASE WHEN isnan(val) THEN 'nan' ELSE CASE WHEN rtrim(t, '.') = '-0' THEN '0' ELSE rtrim(t, '.') END END AS text, length(regexp_extract(t, '\.(\d*)$', 1))::INTEGER AS decimals FROM x",
        "strict_parse": r"WITH x AS (SELECT line_id, string_split(line, chr(9)) f FROM bed_lines) SELECT line_id, CASE WHEN regexp_full_match(f[2], '[+-]?[0-9]{1,18}') THEN f[2]::BIGINT END AS st, CASE WHEN regexp_full_match(f[4], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN f[4]::DOUBLE END AS val FROM x",
        "text_dump": ARRAY + " SELECT pos // 512 AS block, '{' || string_agg(v::VARCHAR, ',' ORDER BY pos) || '}' AS text FROM a GROUP BY 1",
        "array_stats": ARRAY + " SELECT sum(v)::BIGINT AS total, count(v) AS length, count(DISTINCT v) AS \"distinct\", min(v) AS least, max(v) AS most, round(var_pop(v), 6) AS var FROM a",
        "exact_sums": r"SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(20,2)))::DOUBLE AS total, max(length(regexp_extract(regexp_replace(CAST(round(l_extendedprice, 6) AS DECIMAL(30,6))::VARCHAR, '0+$', ''), '\.(\d*)$', 1)))::INTEGER AS decimals FROM lineitem GROUP BY 1",
        "value_codes": "SELECT DISTINCT l_orderkey, CAST(round(l_discount * 100) AS BIGINT) AS code FROM lineitem",
    }

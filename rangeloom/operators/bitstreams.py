"""Integer arrays as packed bits, block by block, and back: ``(pos, v)`` to ``(block, start, n, symbols, counts, payload)``.

Codes are sequential within a block, so blocks of fixed size are coded in Arrow batches, each by itself. Values are 0 or
more. ``method`` is ``gamma``, ``delta``, ``fibonacci``, ``rice:k``, ``golomb:m`` or ``vbyte`` (codes of single values), ``huffman``, ``arithmetic``
or ``rans`` (by the block's counts, which are stored with it), ``adaptive`` (arithmetic by the counts so far) or ``adaptive_huffman`` (Huffman by
the counts so far, renewed every 16 values); the adaptive ones store the block's alphabet.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import _blocks, canonical, huffman_lengths
from .sharding import shard_of

BLOCK = 512
SCHEMA = "block bigint, start bigint, n bigint, symbols array<bigint>, counts array<bigint>, payload binary"


class Bits:
    """Reads a text of bits from the left."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, n: int) -> str:
        self.at += n
        return self.text[self.at - n : self.at]

    def until_one(self) -> int:
        """Zeros before the next one, which is taken too."""
        end = self.text.index("1", self.at)
        n, self.at = end - self.at, end + 1
        return n


def _fibonacci(top: int) -> list[int]:
    f = [1, 2]
    while f[-1] <= top:
        f.append(f[-1] + f[-2])
    return f


def _truncated(x: int, m: int) -> str:
    b = (m - 1).bit_length()
    short = (1 << b) - m
    if x < short:
        return format(x, f"0{b - 1}b") if b > 1 else ""
    return format(x + short, f"0{b}b") if b else ""


def single(method: str) -> tuple[Callable[[int], str], Callable[[Bits], int]]:
    """Coder and decoder of one value."""
    name, _, p = method.partition(":")
    if name == "gamma":
        return lambda v: "0" * ((v + 1).bit_length() - 1) + format(v + 1, "b"), lambda r: (lambda k: int("1" + r.take(k), 2) - 1)(r.until_one())
    if name == "delta":

        def code(v: int) -> str:
            n = (v + 1).bit_length()
            return "0" * (n.bit_length() - 1) + format(n, "b") + format(v + 1, "b")[1:]

        return code, lambda r: (lambda k: int("1" + r.take(int("1" + r.take(k), 2) - 1), 2) - 1)(r.until_one())
    if name == "fibonacci":

        def code(v: int) -> str:
            rest, out = v + 1, []
            for f in reversed([f for f in _fibonacci(v + 1) if f <= v + 1]):
                out.append("1" if f <= rest else "0")
                rest -= f if f <= rest else 0
            return "".join(reversed(out)) + "1"

        def read(r: Bits) -> int:
            end = r.text.index("11", r.at)
            bits = r.take(end + 2 - r.at)[:-1]
            f = [1, 2]
            while len(f) < len(bits):
                f.append(f[-1] + f[-2])
            return sum(x for x, b in zip(f, bits) if b == "1") - 1

        return code, read
    if name == "rice":
        k = int(p)
        return lambda v: "0" * (v >> k) + "1" + (format(v & ((1 << k) - 1), f"0{k}b") if k else ""), lambda r: (r.until_one() << k) + (int(r.take(k), 2) if k else 0)
    if name == "golomb":
        m = int(p)
        b = (m - 1).bit_length()
        short = (1 << b) - m

        def read(r: Bits) -> int:
            q = r.until_one()
            if not b:
                return q
            x = int(r.take(b - 1) or "0", 2)
            if x >= short:
                x = (x << 1) + int(r.take(1)) - short
            return q * m + x

        return lambda v: "0" * (v // m) + "1" + _truncated(v % m, m), read
    if name == "vbyte":

        def code(v: int) -> str:
            parts = [v >> s & 127 for s in range(0, max(v.bit_length(), 1), 7)]
            return "".join(format(x + 128 * (i < len(parts) - 1), "08b") for i, x in enumerate(parts))

        def read(r: Bits) -> int:
            v = shift = 0
            while True:
                x = int(r.take(8), 2)
                v |= (x & 127) << shift
                shift += 7
                if x < 128:
                    return v

        return code, read
    raise ValueError(f"no such code: {method}")


def _packed(bits: str) -> bytes:
    return int("1" + bits + "0" * (-len(bits) % 8), 2).to_bytes(len(bits) // 8 + 2 - (len(bits) % 8 == 0), "big")[1:]


def _bits(payload: bytes) -> str:
    return format(int.from_bytes(b"\x01" + payload, "big"), "b")[1:]


RENEW = 16


def _growing_codes(k: int) -> Iterator[tuple[dict[int, str], Callable[[int], None]]]:
    """For each value in turn the code of the symbols 0..k-1 by their counts so far, and a function that counts the value."""
    counts, n = dict.fromkeys(range(k), 1), 0

    def seen(s: int) -> None:
        counts[s] += 1

    while True:
        if n % RENEW == 0:
            code = canonical(huffman_lengths(counts))
        n += 1
        yield code, seen


def growing_encode(symbols: list[int], k: int) -> bytes:
    out = []
    for s, (code, seen) in zip(symbols, _growing_codes(k)):
        out.append(code[s])
        seen(s)
    return _packed("".join(out))


def growing_decode(payload: bytes, n: int, k: int) -> list[int]:
    text, at, out = _bits(payload), 0, []
    for _, (code, seen) in zip(range(n), _growing_codes(k)):
        back, end = {c: s for s, c in code.items()}, at + 1
        while text[at:end] not in back:
            end += 1
        out.append(back[text[at:end]])
        seen(out[-1])
        at = end
    return out


TOP, HALF, QUARTER = 1 << 32, 1 << 31, 1 << 30


class _Model:
    """Cumulative counts of the symbols 0..k-1; with ``grow`` all start at 1 and each coded symbol adds one."""

    def __init__(self, counts: list[int], grow: bool):
        self.counts, self.grow = [1] * len(counts) if grow else list(counts), grow
        self._sum()

    def _sum(self) -> None:
        self.upto = [0, *accumulate(self.counts)]

    def seen(self, s: int) -> None:
        if self.grow:
            self.counts[s] += 1
            self._sum()


def arithmetic_encode(symbols: list[int], counts: list[int], grow: bool) -> bytes:
    model, low, high, wait, out = _Model(counts, grow), 0, TOP - 1, 0, []

    def put(bit: str) -> None:
        nonlocal wait
        out.append(bit + ("1" if bit == "0" else "0") * wait)
        wait = 0

    for s in symbols:
        total, size = model.upto[-1], high - low + 1
        low, high = low + size * model.upto[s] // total, low + size * model.upto[s + 1] // total - 1
        while True:
            if high < HALF:
                put("0")
            elif low >= HALF:
                put("1")
                low, high = low - HALF, high - HALF
            elif low >= QUARTER and high < 3 * QUARTER:
                wait += 1
                low, high = low - QUARTER, high - QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
        model.seen(s)
    wait += 1
    put("0" if low < QUARTER else "1")
    return _packed("".join(out))


def arithmetic_decode(payload: bytes, n: int, counts: list[int], grow: bool) -> list[int]:
    model, low, high, out = _Model(counts, grow), 0, TOP - 1, []
    bits = _bits(payload) + "0" * 64
    value, at = int(bits[:32], 2), 32
    for _ in range(n):
        total, size = model.upto[-1], high - low + 1
        s = bisect_right(model.upto, ((value - low + 1) * total - 1) // size) - 1
        low, high = low + size * model.upto[s] // total, low + size * model.upto[s + 1] // total - 1
        while True:
            if low >= HALF:
                low, high, value = low - HALF, high - HALF, value - HALF
            elif high >= HALF:
                if low >= QUARTER and high < 3 * QUARTER:
                    low, high, value = low - QUARTER, high - QUARTER, value - QUARTER
                else:
                    break
            low, high, value = 2 * low, 2 * high + 1, 2 * value + int(bits[at]) if at < len(bits) else 2 * value
            at += 1
        model.seen(s)
        out.append(s)
    return out


def rans_encode(symbols: list[int], counts: list[int]) -> bytes:
    """Asymmetric numeral system with bytes as digits; the block's length is its total."""
    upto = [0, *accumulate(counts)]
    total, low = upto[-1], 1 << 23
    x, out = low, bytearray()
    for s in reversed(symbols):
        while x >= ((low // total) << 8) * counts[s]:
            out.append(x & 255)
            x >>= 8
        x = x // counts[s] * total + x % counts[s] + upto[s]
    return x.to_bytes(8, "big") + bytes(reversed(out))


def rans_decode(payload: bytes, n: int, counts: list[int]) -> list[int]:
    upto = [0, *accumulate(counts)]
    total, low = upto[-1], 1 << 23
    x, at, out = int.from_bytes(payload[:8], "big"), 8, []
    for _ in range(n):
        slot = x % total
        s = bisect_right(upto, slot) - 1
        out.append(s)
        x = x // total * counts[s] + slot - upto[s]
        while x < low // total * total and at < len(payload):
            x = x << 8 | payload[at]
            at += 1
    return out


def encode(array: DataFrame, method: str, size: int = BLOCK) -> DataFrame:
    """Packs each block of ``size`` (a power of two) positions; a negative value raises. Null values and positions are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for number, pos, v in _blocks(batches):
            values = v.tolist()
            if min(values) < 0:
                raise ValueError("values must be 0 or more")
            symbols, counts = [], []
            if method in ("huffman", "arithmetic", "rans", "adaptive", "adaptive_huffman"):
                have = Counter(values)
                symbols = sorted(have)
                counts = [have[s] for s in symbols]
                number_of = {s: i for i, s in enumerate(symbols)}
                coded = [number_of[x] for x in values]
                if method == "huffman":
                    code = canonical(huffman_lengths(dict(enumerate(counts))))
                    payload = _packed("".join(code[s] for s in coded))
                elif method == "adaptive_huffman":
                    payload = growing_encode(coded, len(symbols))
                else:
                    payload = rans_encode(coded, counts) if method == "rans" else arithmetic_encode(coded, counts, method == "adaptive")
            else:
                put, _ = single(method)
                payload = _packed("".join(map(put, values)))
            rows.append((number, int(pos[0]), len(values), symbols, counts, payload))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "start", "n", "symbols", "counts", "payload"])

    s = array.select("pos", F.col("v").cast("bigint").alias("v")).where("pos is not null and v is not null").withColumn("_b", shard_of(F.col("pos"), size))
    return s.repartition("_b").sortWithinPartitions("_b", "pos").mapInArrow(run, SCHEMA)


def decode(blocks: DataFrame, method: str) -> DataFrame:
    """The inverse of :func:`encode`, for arrays without missing positions: ``(pos, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, counts, symbols = r["n"], r["counts"], r["symbols"]
                if method == "huffman":
                    back = {c: s for s, c in canonical(huffman_lengths(dict(enumerate(counts)))).items()}
                    text, at, out = _bits(r["payload"]), "", []
                    for bit in text:
                        at += bit
                        if at in back and len(out) < n:
                            out.append(back[at])
                            at = ""
                elif method in ("arithmetic", "adaptive"):
                    out = arithmetic_decode(r["payload"], n, counts, method == "adaptive")
                elif method == "adaptive_huffman":
                    out = growing_decode(r["payload"], n, len(symbols))
                elif method == "rans":
                    out = rans_decode(r["payload"], n, counts)
                else:
                    _, take = single(method)
                    bits = Bits(_bits(r["payload"]))
                    out = [take(bits) for _ in range(n)]
                v = [symbols[s] for s in out] if symbols else out
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(r["start"], r["start"] + n)), pa.array(v, pa.int64())], ["pos", "v"])

    return blocks.mapInArrow(run, "pos bigint, v bigint")

"""Repetition inside a document, judged by an n-gram language model of the corpus.

Method: Spark counts the n-grams (word pairs, ``order`` 2, by default) of the whole corpus; a modified Kneser-Ney model is
made of the counts and stored in arrays sorted by hash within buckets; each document gets its perplexity under the model, and
lower and upper bands per language, from all documents' perplexities, reject documents (:func:`judged`). Buckets are of
n-gram hashes, so a frequent word loads no bucket more than others, and their number follows the bytes of text; sums by
context and by suffix are asked of other buckets and answered in the order asked. A block of documents asks for each of
its n-grams once. All of this travels as packed arrays, a row per block and bucket.

Which documents can be repetitive is decided by perplexity too (:func:`repetitive`), with a band that loses none: a reader
who knows the text so far is surprised only by n-grams that are new in it. Of a stretch of repeated words, put together from
sequences of 8, at most one n-gram in 8 (``order`` 2) is new, so in a text with a given share of repeated words only ``k``
n-grams are new, and their surprise is at most that of the text's ``k`` most surprising ones. A document whose perplexity of
new n-grams is above that band is rejected; the sequences of the others are counted exactly.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import pretokens

#: Words of a sequence that counts as repeated.
WORDS = 8
#: Bytes of text per bucket of the model.
BUCKET_BYTES = 8 << 20
#: Bytes of text per block of documents: its n-grams are asked for once.
BLOCK_BYTES = 4 << 20
#: Shares of a language's documents below the lower and above the upper band.
BANDS = (0.02, 0.98)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NAMES = ["tag", "bucket", "block", "doc", "lang", "n", "rep", "a", "b", "c", "d"]
_SCHEMA = "tag int, bucket bigint, block bigint, doc bigint, lang string, n bigint, rep bigint, a binary, b binary, c binary, d binary"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4]


def _rows(size: int, **cols) -> pa.RecordBatch:
    out = []
    for name, kind in zip(_NAMES, _KINDS):
        v = cols.get(name)
        if v is None:
            out.append(pa.nulls(size, kind))
        elif isinstance(v, pa.Array):
            out.append(v.cast(kind))
        elif isinstance(v, (list, np.ndarray)):
            out.append(pa.array(v, kind))
        else:
            out.append(pa.array([v] * size, kind))
    return pa.RecordBatch.from_arrays(out, _NAMES)


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit hash of 64-bit numbers."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def word_tables() -> bytes:
    """For each code point its lower-case code point, 0 if it is no letter, digit or mark; marks have bit 31 set; compressed."""
    out = np.zeros(pretokens.TOP, np.uint32)
    for c in range(pretokens.TOP):
        x = chr(c)
        kind = unicodedata.category(x)
        if kind in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"):
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif kind[0] == "M":
            out[c] = c | MARK
    return zlib.compress(out.tobytes(), 6)


MARK = 1 << 31


def words(block: pretokens.Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block's texts, and each text's first word.

    A word is a maximal run of letters and digits in lower case; the combining marks after a letter or digit belong to it
    (in many scripts vowels are such marks), marks elsewhere don't.
    """
    n = len(block.cp)
    if not n:
        return np.zeros(0, _U), np.zeros(len(block.doc_cp), np.int64)
    low = table[block.cp]
    first = np.zeros(n + 1, bool)
    first[block.doc_cp] = True
    mark = low >= MARK
    part = (low > 0) & ~mark
    if mark.any():  # a run of marks belongs to what is before it in the text
        bearer = np.maximum.accumulate(np.where(mark & ~first[:n], 0, np.arange(n)))
        part = part[bearer]
    begin = np.flatnonzero(part & (np.append(True, ~part[:-1]) | first[:n]))
    end = np.flatnonzero(part & (np.append(~part[1:], True) | first[1:])) + 1
    power = np.cumprod(np.append(_U(1), np.full(n - 1, _U(_BASE))))
    back = np.cumprod(np.append(_U(1), np.full(n - 1, _U(_INVERSE))))
    total = np.append(_U(0), np.cumsum(low.astype(_U) * power))
    h = mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(_U))
    return np.maximum(h, _U(1)), np.searchsorted(begin, block.doc_cp)


def hashed(w: np.ndarray) -> np.ndarray:
    """The hash of each column of words (one row per place)."""
    h = w[0]
    for x in w[1:]:
        h = mixed(h * _U(_BASE) + x)
    return h


def grams(word: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each word, as columns; 0 stands for what is before a text's start."""
    at = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    out = np.zeros((order, len(word)), _U)
    for back in range(order):
        out[order - 1 - back, back:] = word[: len(word) - back]
        out[order - 1 - back, at < back] = 0
    return out


def repeated(number: np.ndarray, first: np.ndarray, order: int = 2, length: int = WORDS) -> np.ndarray:
    """Per text the number of words in a sequence of ``length`` words that also begins at an earlier word of the text.

    ``number`` identifies the n-gram that ends at each word, ``first`` is each text's first word and the end. Two sequences
    are equal if the n-grams that lie in them are.
    """
    n, wide = len(number), length - order + 1
    marks = np.zeros(n + 1, np.int64)
    code, span = number.astype(np.int64), 1
    while span < wide and len(code):
        step = min(span, wide - span)
        a, b = code[:-step], code[step:]
        code = np.unique(a * (int(code.max()) + 1) + b, return_inverse=True)[1]
        span += step
    # a sequence that begins at word j is told by the n-grams from j + order - 1 on
    begin = np.arange(max(n - length + 1, 0))
    doc = np.searchsorted(first, begin, "right") - 1
    at = begin[begin + length <= first[doc + 1]]
    if len(at):
        code = code[at + order - 1] * np.int64(len(first)) + doc[at]
        by = np.argsort(code, kind="stable")
        again = at[by[1:][code[by[1:]] == code[by[:-1]]]]
        np.add.at(marks, again, 1)
        np.add.at(marks, again + length, -1)
    covered = np.append(0, np.cumsum(np.cumsum(marks[:n]) > 0))
    return covered[first[1:]] - covered[first[:-1]]


def fewest_old(words_: np.ndarray, share: int, order: int = 2, length: int = WORDS) -> np.ndarray:
    """The least number of n-grams that aren't new in a text of which ``share`` % of the words are repeated."""
    return -(-(-(-words_ * share // 100)) * (length - order + 1) // length)


def _compact(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams (columns of words) with counts: sorted distinct hashes, the n-grams, their summed counts."""
    w, c = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts])
    g, at, inverse = np.unique(hashed(w), return_index=True, return_inverse=True)
    return g, w[:, at], np.bincount(inverse, c, len(g)).astype(np.int64)


def _by_bucket(g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (stable), the buckets that occur, and where each begins."""
    of = ((g >> _U(32)) % _U(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    used, first = np.unique(of[order], return_index=True)
    return order, used, first


def _cut(x: np.ndarray, order: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The parts of ``x`` (along its last axis), put into ``order``, that begin at ``first``."""
    return [p.tobytes() for p in np.split(x[..., order], first[1:], axis=-1)]


def _thin(x: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit."""
    return x.astype(np.int32) if not x.size or int(x.max()) < 1 << 31 else x.astype(np.int64)


def _thick(x: bytes, n: int) -> np.ndarray:
    """The inverse of the bytes of :func:`_thin`, for ``n`` numbers."""
    return np.frombuffer(x, np.int32 if len(x) == 4 * n else np.int64).astype(np.int64)


def _matrix(x: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(x, _U).reshape(rows, -1)


def _count(table: bytes, buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.frombuffer(zlib.decompress(table), np.uint32)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            g, w, c = _compact(held)
            by, used, first = _by_bucket(g, buckets)
            yield _rows(len(used), tag=0, bucket=used, a=_cut(w, by, first), b=_cut(c.astype(np.uint32), by, first))
            held.clear()

        for batch in pretokens.blocks(batches, "text", BLOCK_BYTES):
            word, first = words(pretokens.Block(batch.column("text")), low)
            if len(word):
                w = grams(word, first, order)
                held.append(_compact([(w, np.ones(w.shape[1], np.int64))])[1:])
            if sum(len(x[1]) for x in held) > 1_000_000:
                held[:] = [_compact(held)[1:]]
                if len(held[0][1]) > 500_000:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _ask(table: bytes, buckets: int, order: int, docs: bool):
    """Per block: its n-grams by bucket (tag 2), or its texts as numbers of these n-grams (tag 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.frombuffer(zlib.decompress(table), np.uint32)
        for batch in pretokens.blocks(batches, "text", BLOCK_BYTES):
            block = pretokens.Block(batch.column("text"))
            number = _name(block, batch.column("doc"))
            word, first = words(block, low)
            g, numbers = np.unique(hashed(grams(word, first, order)), return_inverse=True)
            by, used, begin = _by_bucket(g, buckets)
            if not docs:
                if len(used):
                    yield _rows(len(used), tag=2, bucket=used, block=number, a=_cut(g, by, begin))
                continue
            local = np.empty(len(g), np.uint32)
            local[by] = np.arange(len(g))
            numbers = local[numbers]
            yield _rows(
                batch.num_rows, tag=4, block=number, doc=batch.column("doc"), lang=batch.column("lang"), n=first[1:] - first[:-1],
                a=[_three(numbers[a:b]) for a, b in zip(first[:-1], first[1:])],
            )

    return run


def _name(block: pretokens.Block, doc: pa.Array) -> int:
    """A number for the block that follows from what is in it, so that both readings of the table give it the same."""
    h = hashlib.blake2b(digest_size=8)
    for x in (doc.fill_null(0).to_numpy(zero_copy_only=False), block.doc_at, block.data):
        h.update(np.ascontiguousarray(x))
    return int.from_bytes(h.digest(), "little", signed=True)


def _three(x: np.ndarray) -> bytes:
    """Numbers in three bytes each, by planes (a block has less than 2^24 n-grams, or else four)."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return planes[: 3 if not planes[3].any() else 4].tobytes()


def _number(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((4, n), np.uint8)
    planes = np.frombuffer(x, np.uint8).reshape(-1, n) if n else out[:0]
    out[: len(planes)] = planes
    return np.ascontiguousarray(out.T).view("<u4").ravel().astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[list[dict]]:
    """Rows, as dicts, in groups of equal ``by``; the input is sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _array(x: bytes, kind=_U) -> np.ndarray:
    return np.frombuffer(x, kind)


def _merge(order: int):
    """Per bucket its part of the model (tag 0), sorted by hash: n-grams (a) and counts (d)."""

    def shut(bucket, parts):
        _, w, c = _compact(parts)
        return _rows(1, tag=0, bucket=[bucket], n=[len(c)], a=[w.tobytes()], d=[_thin(c).tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, size = None, [], 0
        for batch in batches:
            for row in batch.select(["bucket", "a", "b"]).to_pylist():
                if row["bucket"] != bucket:
                    if parts:
                        yield shut(bucket, parts)
                    bucket, parts, size = row["bucket"], [], 0
                parts.append((_matrix(row["a"], order), _array(row["b"], np.uint32).astype(np.int64)))
                size += len(parts[-1][1])
                if size > 2_000_000:
                    parts = [_compact(parts)[1:]]
                    size = len(parts[0][1]) // 2
        if parts:
            yield shut(bucket, parts)

    return run


def _sides(row: dict, order: int):
    """Of a part of the model: of its contexts (all words but the last) the distinct hashes, their sums, and each n-gram's
    context number; of its suffixes (all words but the first) the distinct ones, their hashes, sums, and each n-gram's suffix number.

    Sums of a context: count, n-grams seen once, twice, more often; of a suffix: n-grams.
    """
    w = _matrix(row["a"], order)
    c = _thick(row["d"], row["n"])
    ctx, of = np.unique(hashed(w[:-1]), return_inverse=True)
    sums = np.stack([np.bincount(of, x, len(ctx)).astype(np.int64) for x in (c, c == 1, c == 2, c >= 3)])
    suf, at, to = np.unique(hashed(w[1:]), return_index=True, return_inverse=True)
    return (ctx, sums, of), (w[1:, at], suf, np.bincount(to, minlength=len(suf))[None, :], to), c


def _ask_up(order: int, buckets: int):
    """Asks other buckets (``block`` holds theirs, ``n`` the side) for the sums over all parts of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ctx, sums, _), (w, suf, n, _), _ = _sides(row, order)
                for side, keys, g, s in ((0, ctx[None, :], ctx, sums), (1, w, suf, n)):
                    by, used, first = _by_bucket(g, buckets)
                    s = [_thin(p).tobytes() for p in np.split(s[:, by], first[1:], axis=1)]
                    yield _rows(len(used), tag=1, bucket=row["bucket"], block=used, n=side, a=_cut(keys, by, first), b=s)

    return run


def _settle(order: int):
    """Of each bucket of contexts the sums in the order asked (tag 1, side 0). Of suffixes of one word likewise (side 1), and
    counts of counts (tag 9); of longer ones the next lower part of the model (tag 0) and the places asked for (tag 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "block", "n"):
            side, here = rows[0]["n"], rows[0]["block"]
            width, tall = (1, order - 1) if side else (4, 1)
            keys = [_matrix(r["a"], tall) for r in rows]
            sums = np.concatenate([_thick(r["b"], width * k.shape[1]).reshape(width, -1) for r, k in zip(rows, keys)], 1)
            w = np.concatenate(keys, 1)
            _, at, inverse = np.unique(hashed(w), return_index=True, return_inverse=True)
            total = np.stack([np.bincount(inverse, x, len(at)).astype(np.int64) for x in sums])
            ends = np.cumsum([k.shape[1] for k in keys])[:-1]
            back = dict(bucket=[r["bucket"] for r in rows], block=[r["block"] for r in rows], n=side)
            if side and order > 2:
                yield _rows(1, tag=0, bucket=[here], n=[len(at)], a=[w[:, at].tobytes()], d=[_thin(total[0]).tobytes()])
                yield _rows(len(rows), tag=2, bucket=here, block=back["bucket"], a=[p.astype(np.uint32).tobytes() for p in np.split(inverse, ends)])
                continue
            yield _rows(len(rows), tag=1, **back, a=[_thin(p).tobytes() for p in np.split(total[:, inverse], ends, axis=1)], c=[np.int64(p.size).tobytes() for p in np.split(inverse, ends)])
            if side:
                t = total[0]
                yield _rows(1, tag=9, n=1, a=[np.array([*[(t == k).sum() for k in (1, 2, 3, 4)], len(t), t.sum(), (t >= 3).sum()], np.int64).tobytes()])

    return run


def _count_counts(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(4, np.int64)
            for row in batch.select(["n", "d"]).to_pylist():
                total += np.bincount(np.minimum(_thick(row["d"], row["n"]), 5), minlength=6)[1:5]
            yield _rows(1, tag=9, n=level, a=[total.tobytes()])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array([_array(x, np.int64).tolist() for x in batch.column("a").to_pylist()], pa.list_(pa.int64()))], ["level", "v"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from the numbers of counts 1 to 4; plain values where those don't allow it."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return count - np.choose(np.clip(count, 1, 3) - 1, d)


def _probabilities(model: dict, answers: list[dict], buckets: int, order: int, stats: dict) -> np.ndarray:
    """The probability of the last word after the others, of each n-gram of a part of the model."""
    (ctx, _, of), (_, suf, _, to), c = _sides(model, order)
    got = []
    for side, g in ((0, ctx), (1, suf)):
        by, _, _ = _by_bucket(g, buckets)
        parts = sorted((r for r in answers if r["n"] == side), key=lambda r: r["block"])
        if side and order > 2:
            told = np.concatenate([_array(r["a"], np.float64) for r in parts])[None, :]
        else:
            wide = 1 if side else 4
            told = np.concatenate([_thick(r["a"], wide * int(_array(r["c"], np.int64)[0])).reshape(wide, -1) for r in parts], 1)
        back = np.empty_like(told)
        back[:, by] = told
        got.append(back)
    total, once, twice, more = got[0][:, of]
    lower = got[1][0]
    if order == 2:
        m, d = stats[1], discounts(*stats[1][:4])
        vocabulary, pairs = m[4], m[5]
        lower = _discounted(lower, d) / pairs + (d[0] * m[0] + d[1] * m[1] + d[2] * m[6]) / pairs / (vocabulary + 1)
    d = discounts(*stats[order][:4])
    return _discounted(c, d) / total + (d[0] * once + d[1] * twice + d[2] * more) / total * lower[to]


def _look_up(buckets: int, order: int, stats: dict, texts: bool):
    """Per bucket, sorted by tag: its part of the model (0), answers (1), then what is asked (2): hashes of a block's n-grams
    (``texts``), answered by tag 3, or places in the part by a bucket of the next higher model, answered by tag 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, answers, ready = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["tag"] == 0:
                    model, answers, ready = row, [], None
                elif row["tag"] == 1:
                    answers.append(row)
                else:
                    if ready is None:
                        p = _probabilities(model, answers, buckets, order, stats)
                        ready = hashed(_matrix(model["a"], order)), p, np.log(p).astype(np.float32), _thick(model["d"], model["n"]) >= 2
                    g, p, log, twice = ready
                    if texts:
                        at = np.searchsorted(g, _array(row["a"]))
                        yield _rows(1, tag=3, bucket=row["bucket"], block=row["block"], n=len(at), a=[log[at].tobytes()], b=[np.packbits(twice[at]).tobytes()])
                    else:
                        yield _rows(1, tag=1, bucket=row["block"], block=row["bucket"], n=1, a=[p[_array(row["a"], np.uint32)].tobytes()])

    return run


_SCORE = "doc_id bigint, lang string, n_words bigint, perplexity double, known bigint, new_perplexity double, limit double, chosen boolean, repeated bigint"


def _score(order: int, least: int, share: int, all_: bool):
    """Per block, sorted by tag and bucket: the n-grams' answers (3), then the texts (4)."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
    names = [c.split()[0] for c in _SCORE.split(", ")]

    def judge(rows: list[dict], log: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        n = np.array([r["n"] for r in rows], np.int64)
        first = np.append(0, np.cumsum(n))
        at = np.concatenate([_number(r["a"], r["n"]) for r in rows])
        doc = np.repeat(np.arange(len(rows)), n)
        surprise = np.maximum(-log[at], 0.0)
        sums = lambda x: np.append(0.0, np.cumsum(x))[first[1:]] - np.append(0.0, np.cumsum(x))[first[:-1]]
        # an n-gram that is known makes all its words known
        known = np.zeros(len(at) + 1, bool)
        hit = np.flatnonzero(twice[at])
        for back in range(order):
            known[np.maximum(hit - back, first[doc[hit]])] = True
        new = np.zeros(len(at), bool)
        new[np.unique(doc * np.int64(len(log) + 1) + at, return_index=True)[1]] = True
        most = n - fewest_old(n, share, order)
        falling = np.append(0.0, np.cumsum(surprise[np.lexsort((-surprise, doc))]))
        all_new, limit, size = sums(np.where(new, surprise, 0.0)), falling[first[:-1] + most] - falling[first[:-1]], np.maximum(n, 1)
        chosen = (n >= least) & (all_new <= limit + 1e-6 * (1 + falling[-1]))
        rep = np.zeros(len(rows), np.int64)
        use = np.flatnonzero(chosen | all_)
        if len(use):
            some = np.isin(doc, use)
            rep[use] = repeated(at[some], np.append(0, np.cumsum(n[use])), order)
        none = n == 0
        exp = lambda x: pa.array(np.exp(x / size), mask=none)
        cols = [[r["doc"] for r in rows], [r["lang"] for r in rows], n, exp(sums(-log[at])), sums(known[:-1]).astype(np.int64), exp(all_new), exp(limit), chosen, pa.array(rep, mask=~(chosen | all_))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bucket, logs, twices, ready, texts = None, None, [], [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if texts:
                        yield judge(texts, *ready)
                    block, bucket, logs, twices, ready, texts = row["block"], None, [], [], None, []
                if row["tag"] == 3:
                    if row["bucket"] == bucket:  # blocks with the same contents ask and are told the same
                        continue
                    bucket = row["bucket"]
                    logs.append(_array(row["a"], np.float32))
                    twices.append(np.unpackbits(_array(row["b"], np.uint8), count=row["n"]))
                    continue
                if ready is None:
                    ready = (np.concatenate(logs).astype(np.float64), np.concatenate(twices).astype(bool)) if logs else (np.zeros(0), np.zeros(0, bool))
                texts.append(row)
                if len(texts) >= pretokens.BLOCK_ROWS:
                    yield judge(texts, *ready)
                    texts = []
        if texts:
            yield judge(texts, *ready)

    return run


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 2, least: int = 50, share: int = 60, count_all: bool = True) -> DataFrame:
    """Every document under the model of all of them: ``(doc_id, lang, n_words, perplexity, known, new_perplexity, limit, chosen, repeated)``.

    ``known`` counts the words in an n-gram that the corpus has twice or more. ``new_perplexity`` is the perplexity if n-grams
    that the text has had before surprise no more; a text of which ``share`` % of the words are repeated isn't above
    ``limit``. ``chosen`` are the texts of ``least`` words or more that aren't. ``repeated`` counts the words in a sequence of
    8 that also begins earlier in the text, exactly; without ``count_all`` of the chosen ones only (null for the others).
    Null and empty texts, and texts without letters and digits, have no words and null perplexity. Words compare without
    case. ``order`` (2 to 8) is the model's. ``docs`` should be a stored table: it is read four times (its bytes of text, the
    n-grams, the questions, the texts), and its rows must come in the same order each time.
    """
    if not 2 <= order <= WORDS:
        raise ValueError("order must be 2 to 8")
    table = word_tables()
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def by(df: DataFrame, column: str, *rest: str) -> DataFrame:
        return df.repartitionById(buckets, F.pmod(F.col(column), F.lit(buckets)).cast("int")).sortWithinPartitions(column, *rest)

    model = {order: written(by(rows.mapInArrow(_count(table, buckets, order), _SCHEMA), "bucket").mapInArrow(_merge(order), _SCHEMA), "model")}
    sums: dict[int, DataFrame] = {}
    for m in range(order, 1, -1):
        sums[m] = written(by(model[m].mapInArrow(_ask_up(m, buckets), _SCHEMA), "block", "n").mapInArrow(_settle(m), _SCHEMA), "sums")
        if m > 2:
            model[m - 1] = sums[m].where("tag = 0")
    # counts of counts: seven numbers a level on the driver
    parts = sums[2].where("tag = 9")
    for m in model:
        parts = parts.unionByName(model[m].mapInArrow(_count_counts(m), _SCHEMA))
    total = parts.mapInArrow(_listed, "level bigint, v array<bigint>").select("level", F.posexplode("v").alias("i", "v")).groupBy("level", "i").agg(F.sum("v").alias("v")).collect()
    stats = {m: [0] * 7 for m in range(1, order + 1)}
    for r in total:
        stats[r["level"]][r["i"]] = r["v"]

    asked = rows.mapInArrow(_ask(table, buckets, order, False), _SCHEMA)
    lower = None
    for m in range(2, order + 1):
        meet = model[m].unionByName(sums[m].where("tag = 1"))
        if lower is not None:
            meet = meet.unionByName(lower)
        meet = meet.unionByName(asked if m == order else sums[m + 1].where("tag = 2"))
        lower = by(meet, "bucket", "tag", "block").mapInArrow(_look_up(buckets, m, stats, m == order), _SCHEMA)
    texts = rows.mapInArrow(_ask(table, buckets, order, True), _SCHEMA)
    home = by(lower.unionByName(texts), "block", "tag", "bucket")
    return home.mapInArrow(_score(order, least, share, count_all), _SCORE)


def language(lang) -> object:
    """A language label without case and region; ``und`` where there is none."""
    short = F.regexp_extract(F.lower(F.trim(lang)), "^[a-z]+", 0)
    return F.when(F.coalesce(short, F.lit("")) == "", "und").otherwise(short)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bands: tuple[float, float] = BANDS, order: int = 2) -> DataFrame:
    """Scores with the bands of the document's language: ``(doc_id, lang, n_words, perplexity, low, high, verdict, known_share, repeated_share)``.

    ``verdict`` is ``low`` (under the lower band: more predictable than its language, as repetition is), ``high`` (over
    the upper one: as broken text is), ``ok``, or ``empty`` for a document without words. Bands are percentiles over all
    documents of the language.
    """
    s = written(scores(docs, key, text, lang, order).withColumn("lang", language(F.col("lang"))), "scores")
    edges = s.where("n_words > 0").groupBy(F.col("lang").alias("_l")).agg(F.percentile_approx("perplexity", list(bands), 10_000).alias("_b"))
    both = s.join(edges, F.col("lang") == F.col("_l"), "left")
    low, high = F.get("_b", F.lit(0)), F.get("_b", F.lit(1))
    verdict = F.when(F.col("n_words") == 0, "empty").when(F.col("perplexity") < low, "low").when(F.col("perplexity") > high, "high").otherwise("ok")
    share = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    return both.select("doc_id", "lang", "n_words", "perplexity", low.alias("low"), high.alias("high"), verdict.alias("verdict"), share("known").alias("known_share"), share("repeated").alias("repeated_share"))


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 50, share: int = 60, order: int = 2) -> DataFrame:
    """``(doc_id)`` of the texts with ``least`` words or more of which at least ``share`` % are repeated.

    The model chooses: a document whose perplexity of new n-grams is above its band can't be one and is rejected. An exact
    count of repeated words follows, of the chosen documents only.
    """
    s = scores(docs, key, text, lang, order, least, share, count_all=False)
    return s.where("chosen").where(F.col("repeated") * 100 >= F.col("n_words") * share).select("doc_id")

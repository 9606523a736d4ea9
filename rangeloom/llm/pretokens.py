"""Splitting texts into the pre-tokens of a byte-level BPE tokenizer, a block of texts at a time, without a loop over them.

The split pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+`` needs only the classes of neighbouring
characters, so the starts of all pre-tokens of a block follow from a few array operations. The class of each character
is asked of the tokenizer itself: libraries differ in the Unicode version they know.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = range(4)
TOP = 0x110000

#: Bytes of text in a block, at least; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 20_000


@functools.cache
def char_classes(tokenizer_json: str) -> bytes:
    """The class of each code point as ``tokenizer_json``'s pre-tokenizer sees it, compressed (a few KB)."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(tokenizer_json).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(TOP) if not 0xD800 <= c <= 0xDFFF]
    maybe = np.array([c for c in points if unicodedata.category(chr(c))[0] in "LN" or c < 0x250], np.int64)
    try:
        import regex

        more = np.array([ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", "".join(map(chr, points)))], np.int64)
        maybe = np.union1d(maybe, more)
    except ImportError:
        maybe = np.array(points, np.int64)
    classes = np.zeros(TOP, np.uint8)
    for lo in range(0, len(maybe), 50_000):
        part = maybe[lo : lo + 50_000]
        # a letter joins the "a" before it, a digit the "1"; of blanks, one before two line ends is the start of one run
        text = "".join(f"!a{c}!1{c}!.{c}\n\n." for c in map(chr, part.tolist()))
        starts = np.zeros(len(text) + 1, bool)
        starts[[at for _, (at, _) in split(text)]] = True
        at = starts[:-1].reshape(len(part), 12)
        classes[part[~at[:, 2]]] = LETTER
        classes[part[~at[:, 5]]] = NUMBER
        classes[part[~at[:, 9] & at[:, 8]]] = SPACE
    return zlib.compress(classes.tobytes(), 9)


def class_table(compressed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(compressed), np.uint8)


class Block:
    """A block of texts: ``data`` (UTF-8), ``doc_at`` (each text's first byte, and the end), ``cp``, ``cp_at`` (each character's first byte)."""

    def __init__(self, text: pa.Array):
        text = pc.fill_null(text.cast(pa.large_binary()), b"")
        try:
            self._load(text)
        except UnicodeDecodeError:  # bytes that aren't UTF-8 become U+FFFD, text by text
            fixed = [x.decode("utf-8", "replace").encode() for x in text.to_pylist()]
            self._load(pa.array(fixed, pa.large_binary()))

    def _load(self, text: pa.Array) -> None:
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.doc_at = offsets - offsets[0]
        self.cp = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.cp_at = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.doc_cp = np.searchsorted(self.cp_at, self.doc_at)  # each text's first character, and the end


def starts(block: Block, classes: np.ndarray) -> np.ndarray:
    """The first characters of the pre-tokens of all texts of the block, ascending."""
    cp, n = block.cp, len(block.cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[cp]
    first = np.zeros(n + 1, bool)  # of a text; the end too
    first[block.doc_cp] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    blank = kind == SPACE
    # a blank before a run of another kind: the last of its run, which is a pre-token's start
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:n])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False  # joined to the run after it
    quote = np.flatnonzero((cp == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    a = cp[quote + 1]
    short = quote[np.isin(a, [ord(x) for x in "sdmt"])]
    start[short + 1] = False
    start[short + 2] = True
    quote = quote[quote + 2 < n]
    quote = quote[~first[quote + 2] & ~first[quote + 1]]
    a, b = cp[quote + 1], cp[quote + 2]
    long = quote[((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))]
    start[long + 1] = False
    start[long + 3] = True
    return np.flatnonzero(start[:n])


def as_binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The pieces of ``data`` between the offsets ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def blocks(batches: Iterator[pa.RecordBatch], text: str, least: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in blocks of about ``least`` bytes of ``text``, in order."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begun = 0
        for at in range(batch.num_rows):
            size += int(sizes[at])
            rows += 1
            if size >= least or rows >= BLOCK_ROWS:
                held.append(batch.slice(begun, at + 1 - begun))
                begun = at + 1
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, rows = [], 0, 0
        if begun < batch.num_rows:
            held.append(batch.slice(begun))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

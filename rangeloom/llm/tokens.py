"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Method: texts are cut into pre-tokens with their positions; the distinct pre-tokens ("words") of all texts meet in a
shuffle by word, are encoded once there, and their ids are joined back to the positions. So that not every occurrence
has to travel, a block of texts lists each of its words once, and its texts hold positions as numbers of that list:
what is shuffled by word is the blocks' word lists, in which a frequent word is one entry a block, so no word is hot.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
_ROW = "tag int, block bigint, bucket int, doc bigint, head int, a binary, b binary"
_NAMES = ["tag", "block", "bucket", "doc", "head", "a", "b"]


@functools.cache
def encoder(ranks_file: str):
    """A function from a word's bytes to its ids."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    piece = tiktoken.Encoding("own", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda word: [ranks[word]] if word in ranks else piece(word)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each if they fit, with the width in front."""
    small = not len(x) or int(x.max()) < 1 << 16
    return (b"2" if small else b"4") + x.astype(np.uint16 if small else np.uint32).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint16 if x[:1] == b"2" else np.uint32, offset=1).astype(np.int64)


def _rows(tag, block, bucket, doc, head, a, b) -> pa.RecordBatch:
    n = len(a)
    fill = lambda v, t: v if isinstance(v, (list, pa.Array, np.ndarray)) else pa.array([v] * n, t)
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    cols = [pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip((fill(v, t) for v, t in zip((tag, block, bucket, doc, head, a, b), kinds)), kinds)]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _split(classes: bytes, buckets: int, with_head: bool):
    """Of each block: its word list by bucket (tag 0), and of each text the numbers of its words (tag 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from pyspark import TaskContext

        table = pretokens.class_table(classes)
        head_end = re.compile(rb"\r?\n\r?\n")
        number = TaskContext.get().partitionId() << 32
        for batch in pretokens.blocks(batches, "text"):
            number += 1
            block = pretokens.Block(batch.column("text"))
            at = np.append(block.cp_at[pretokens.starts(block, table)], len(block.data))
            words = pretokens.as_binary(block.data, at).dictionary_encode()
            lists = words.dictionary.to_pylist()
            of = np.array([zlib.crc32(w) % buckets for w in lists], np.int64)
            order = np.argsort(of, kind="stable")
            local = np.empty(len(order), np.int64)
            local[order] = np.arange(len(order))
            used, first = np.unique(of[order], return_index=True)
            if len(used):
                parts = [[lists[i] for i in p] for p in np.split(order, first[1:])]
                yield _rows(0, number, used, None, None, [_narrow(np.array([len(w) for w in p], np.int64)) for p in parts], [b"".join(p) for p in parts])
            numbers = local[words.indices.to_numpy()] if len(lists) else np.zeros(0, np.int64)
            cut = np.searchsorted(at[:-1], block.doc_at)
            heads = None
            if with_head:
                ends = [block.doc_at[i] + (m.end() if (m := head_end.search(block.data[block.doc_at[i] : block.doc_at[i + 1]])) else 0) for i in range(batch.num_rows)]
                heads = np.searchsorted(at[:-1], np.array(ends, np.int64)) - cut[:-1]
            docs = [_narrow(numbers[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield _rows(1, number, None, batch.column("doc"), heads, docs, None)

    return run


def _encode(ranks_file: str):
    """Each bucket's word lists to lists of ids, each distinct word once; texts (tag 1) pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            lengths = [_wide(a) for _, a, _ in parts]
            at = np.append(0, np.cumsum(np.concatenate(lengths)))
            words = pretokens.as_binary(np.frombuffer(b"".join(b for _, _, b in parts), np.uint8), at).dictionary_encode()
            word_ids = encoder(ranks_file)
            ids = [word_ids(w) for w in words.dictionary.to_pylist()]
            lists = pa.array(ids, pa.list_(pa.int32())).take(words.indices)
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy()
            ends = np.append(0, np.cumsum(count))
            lo = np.append(0, np.cumsum([len(x) for x in lengths]))
            a = [_narrow(count[x:y]) for x, y in zip(lo[:-1], lo[1:])]
            b = [_narrow(flat[ends[x] : ends[y]]) for x, y in zip(lo[:-1], lo[1:])]
            yield _rows(0, [p[0] for p in parts], bucket, None, None, a, b)
            parts.clear()

        for batch in batches:
            tags = batch.column("tag").to_numpy()
            n = int((tags == 0).sum())  # word lists come first
            cols = [batch.column(c).slice(0, n) for c in ("bucket", "block", "a", "b")]
            for k, number, a, b in zip(*(c.to_pylist() for c in cols)):
                if k != bucket:
                    yield from flush()
                    bucket = k
                parts.append((number, a, b))
            if n < batch.num_rows:
                yield from flush()
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(n) for c in _NAMES], _NAMES)
        yield from flush()

    return run


def _join(counts_only: bool):
    """Per block: the ids of its words in the order of their numbers, then each text's ids (or their number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, ready = None, [], None
        for batch in batches:
            tags, numbers = batch.column("tag").to_numpy(), batch.column("block").to_numpy()
            a, b = batch.column("a"), batch.column("b")
            edges = np.flatnonzero(np.append(True, (tags[1:] != tags[:-1]) | (numbers[1:] != numbers[:-1])))
            for x, y in zip(edges, np.append(edges[1:], len(tags))):
                if numbers[x] != block:
                    block, lists, ready = numbers[x], [], None
                if tags[x] == 0:
                    lists += [(_wide(p), None if counts_only else _wide(q)) for p, q in zip(a.slice(x, y - x).to_pylist(), b.slice(x, y - x).to_pylist())]
                    continue
                if ready is None:
                    count = np.concatenate([p for p, _ in lists]) if lists else np.zeros(0, np.int64)
                    flat = np.concatenate([q for _, q in lists]) if lists and not counts_only else np.zeros(0, np.int64)
                    ready = (count, np.append(0, np.cumsum(count)), flat)
                count, at, flat = ready
                docs = [_wide(p) for p in a.slice(x, y - x).to_pylist()]
                words = np.concatenate(docs)
                cut = np.append(0, np.cumsum([len(d) for d in docs]))
                each = np.append(0, np.cumsum(count[words]))
                doc = batch.column("doc").slice(x, y - x)
                if counts_only:
                    head = batch.column("head").slice(x, y - x).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array(each[cut[1:]] - each[cut[:-1]], pa.int64()), pa.array(each[cut[1:]] - each[cut[:-1] + head], pa.int64())], ["doc_id", "n_tokens", "loss_tokens"]
                    )
                    continue
                place = np.arange(each[-1]) - np.repeat(each[:-1] - at[:-1][words], count[words])
                ids = pa.ListArray.from_arrays(pa.array(each[cut], pa.int32()), pa.array(flat[place], pa.int32()))
                yield pa.RecordBatch.from_arrays([doc, ids], ["doc_id", "ids"])

    return run


def _through_words(docs: DataFrame, key: str, text: str, folder: str, vocabulary: str, counts_only: bool) -> DataFrame:
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = pretokens.char_classes(f"{folder}/{vocabulary}.json")
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(_split(classes, buckets, counts_only), _ROW)
    by_word = rows.repartition(F.when(F.col("tag") == 0, F.col("bucket")).otherwise(F.col("block"))).sortWithinPartitions("tag", "bucket", "block")
    coded = by_word.mapInArrow(_encode(f"{folder}/{vocabulary}.tiktoken"), _ROW)
    by_block = coded.repartition("block").sortWithinPartitions("block", "tag", "bucket", "doc")
    return by_block.mapInArrow(_join(counts_only), "doc_id bigint, n_tokens bigint, loss_tokens bigint" if counts_only else "doc_id bigint, ids array<int>")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)`` of every row: the ids of its whole text, without special tokens.

    Null and empty texts get an empty list; rows with equal or null keys each come out. Strings of special tokens are
    ordinary text; bytes that aren't UTF-8 count as U+FFFD. ``folder`` holds ``vocabulary``.json and .tiktoken. ``docs``
    should be a stored table: a task that runs again must see the same rows in the same order.
    """
    return _through_words(docs, key, text, folder, vocabulary, False)


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, loss_tokens)`` of every row; null and empty texts have none.

    ``loss_tokens`` are the tokens of the body, that is after the first blank line; all tokens where there is none.
    """
    return _through_words(docs, key, text, folder, vocabulary, True)


@functools.cache
def token_bytes(ranks_file: str) -> pa.Array:
    """The token-byte table: the bytes of each id; an id that the file doesn't have (a special token) has none."""
    with open(ranks_file, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in (x.split() for x in f if x.strip())}
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)``: the texts of lists of ids, by a join of each id with the token-byte table.

    The table has one row per token of the vocabulary (about 50,000, a proven bound), so every worker holds it and joins
    whole batches by position, without a shuffle. A text is null if its bytes aren't UTF-8, and empty for an empty or null
    list. An id outside the table raises.
    """
    ranks = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column(1)
                bytes_ = table.take(lists.flatten().cast(pa.int64()))
                count = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)))
                # the taken bytes lie one behind the other, so a text is a slice of them
                if len(bytes_):
                    ends = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset : bytes_.offset + len(bytes_) + 1].astype(np.int64)
                    data = np.frombuffer(bytes_.buffers()[2] or b"", np.uint8)
                else:
                    ends, data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
                whole = pretokens.as_binary(data, ends[count])
                try:
                    text = whole.cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([_valid(x) for x in whole.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), text], [key, "text"])

    rows = encoded.select(key, F.col(ids).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("text", T.StringType())]))


def _valid(x: bytes) -> str | None:
    try:
        return x.decode()
    except UnicodeDecodeError:
        return None

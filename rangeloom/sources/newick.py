"""Trees in bracket notation ``(a:1,b)c;``: texts to node tables and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "tree_id bigint, id bigint, parent bigint, child bigint, name string, length double, error string"


def parse(text: str) -> list[tuple[int, int | None, int, str, float | None]]:
    """Nodes ``(id, parent, number among siblings, name, length)`` in order of opening, the root first. Raises ``ValueError``."""
    nodes: list[list] = []
    stack: list[int] = []

    def node() -> int:
        up = stack[-1] if stack else None
        nodes.append([len(nodes), up, counts.get(up, 0), "", None])
        if up is not None:
            counts[up] = counts.get(up, 0) + 1
        return len(nodes) - 1

    counts: dict[int, int] = {}
    at, n = 0, len(text)
    here: int | None = None
    closed = False
    while at < n:
        c = text[at]
        if c.isspace():
            at += 1
        elif c == ";":
            if stack:
                raise ValueError("unbalanced brackets")
            if text[at + 1 :].strip():
                raise ValueError("text after the end")
            closed = True
            break
        elif c == "(":
            if here is not None:
                raise ValueError("bracket after a name")
            stack.append(node())
            at += 1
        elif c in ",)":
            if not stack:
                raise ValueError("unbalanced brackets")
            if here is None:
                node()
            here = None
            if c == ")":
                here = stack.pop()
            at += 1
        else:
            end = at
            while end < n and text[end] not in "(),;":
                end += 1
            name, _, length = text[at:end].partition(":")
            if here is None:
                here = node()
            nodes[here][3] = name.strip()
            if length.strip():
                nodes[here][4] = float(length)
            at = end
    if not closed:
        raise ValueError("no ; at the end")
    if not nodes:
        node()
    return [tuple(x) for x in nodes]


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
    for batch in batches:
        out: list[tuple] = []
        for tree, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            try:
                out += [(tree, *x, None) for x in parse(text)]
            except ValueError as e:
                out.append((tree, None, None, None, None, None, str(e)))
        cols = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def read(trees: DataFrame, key: str = "tree_id", text: str = "text") -> DataFrame:
    """Nodes of each text: ``(tree_id, id, parent, child, name, length, error)``; a text that fails is one row with its error, null gives none."""
    return trees.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(_parse_all, SCHEMA)


def _print_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            below: dict = {}
            for r in sorted(rows, key=lambda r: (r["child"] is None, r["child"], r["id"])):
                below.setdefault(r["parent"], []).append(r)

            def label(r: dict) -> str:
                x = r["length"]
                return (r["name"] or "") + ("" if x is None else f":{x:.6f}".rstrip("0").rstrip("."))

            parts: list[str] = []
            todo: list = [(r, 0) for r in reversed(below.get(None, []))]
            while todo:  # no recursion: trees may be deep
                r, state = todo.pop()
                kids = below.get(r["id"], []) if state < 2 else []
                if state == 0 and kids:
                    parts.append("(")
                    todo.append((r, 1))
                    for i, k in enumerate(reversed(kids)):
                        todo.append((k, 0))
                        if i < len(kids) - 1:
                            todo.append(({"id": None, "name": ",", "length": None}, 2))
                elif state == 1:
                    parts.append(")" + label(r))
                else:
                    parts.append(label(r))
            out.append((tree, "".join(parts) + ";"))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["tree_id", "text"])


def write(nodes: DataFrame) -> DataFrame:
    """``(tree_id, text)``: the text of each tree from its nodes; a tree is one text, so it fits a row."""
    rows = nodes.where("error is null").groupBy("tree_id").agg(F.collect_list(F.struct("id", "parent", "child", "name", "length")).alias("rows"))
    return rows.mapInArrow(_print_all, "tree_id bigint, text string")

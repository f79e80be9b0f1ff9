"""Deeply nested records as flat tables with parent links (Dewey labelling).

Every node of a JSON document gets the path of its ordinals and keys as label.
``/`` separates the steps; a step is a position in a list (from 0) or a key of an
object. A node's parent is its label without the last step, so parent links cost
no join, and nodes of one *schema path* (the label with positions replaced by
``*``) form one table.

Parsing and labelling are one narrow pass (Arrow batches, no shuffle). Subtrees
that cannot hold a wanted schema path are not entered.

Defined cases: null, blank or incomplete JSON yields no node; text that is itself
JSON for an object or a list counts as what it says, at any depth; a null element
keeps its position and yields no node; where ``lists`` says a list belongs, an
object stands at position 0; other scalars yield no element there. Of a repeated key the last value counts. Repeated records yield repeated
nodes unless the caller removes them; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "record_id string, label string, schema_path string, kind string, value string"


def _open(value):
    """Unwraps JSON text that stands for an object or a list."""
    while isinstance(value, str):
        text = value.lstrip(" \t\r\n")
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = json.loads(text)
        except (ValueError, RecursionError):
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def read_json(text: str | None):
    """The object or list that ``text`` holds, or None."""
    if text is None:
        return None
    try:
        value = _open(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, (dict, list)) else None


class _Wanted:
    """A trie of schema paths, so that subtrees without wanted nodes are skipped."""

    def __init__(self, paths: Iterable[str], lists: Iterable[str]):
        self.root: dict = {}
        for kind, many in (("want", paths), ("list", lists)):
            for path in many:
                at = self.root
                for step in path.split("/"):
                    at = at.setdefault("steps", {}).setdefault(step, {})
                at[kind] = True


def label_nodes(value, wanted: _Wanted | None) -> Iterator[tuple[str, str, str, str | None]]:
    """(label, schema path, kind, scalar as text) of each node, depth first, without recursion."""
    stack = [(value, "", "", wanted.root if wanted else None)]
    while stack:
        node, label, schema, trie = stack.pop()
        node = _open(node)
        if trie and trie.get("list") and isinstance(node, dict):
            node = [node]
        if label and (trie is None or trie.get("want")):
            kind = "object" if isinstance(node, dict) else "array" if isinstance(node, list) else "scalar"
            text = None if kind != "scalar" else node if isinstance(node, str) else json.dumps(node)
            yield label, schema, kind, text
        if isinstance(node, dict):
            steps = [(str(k).replace("~", "~0").replace("/", "~1"), None, v) for k, v in node.items()]
        elif isinstance(node, list):
            steps = [(str(i), "*", v) for i, v in enumerate(node)]
        else:
            continue
        below = None if trie is None else trie.get("steps", {})
        for step, general, child in reversed(steps):
            if child is None:
                continue
            if below is None:
                go = None
            else:
                go = below.get(general or step) or below.get("*")
                if go is None:
                    continue
            stack.append((child, f"{label}/{step}" if label else step, f"{schema}/{general or step}" if schema else general or step, go))


def shred(df: DataFrame, record_id: Column, body: Column, paths: Iterable[str] | None = None, lists: Iterable[str] = ()) -> DataFrame:
    """Nodes of every record: ``record_id, label, schema_path, kind, value``.

    ``paths``: schema paths to emit (``*`` matches any position or key), all if
    None. ``lists``: schema paths where a list belongs.
    """
    paths, lists = None if paths is None else sorted(paths), sorted(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if paths is None else _Wanted(paths, lists)
        names = [x.split()[0] for x in NODE.split(", ")]
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = read_json(text)
                if value is None or key is None:
                    continue
                for node in label_nodes(value, wanted):
                    cols[0].append(key)
                    for col, x in zip(cols[1:], node):
                        col.append(x)
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names)
                    cols = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names)

    return df.select(record_id.cast("string").alias("record_id"), body.cast("string").alias("body")).mapInArrow(run, NODE)


def parent_label(label: Column) -> Column:
    """The parent's label by truncation; null for a top node."""
    return F.when(F.instr(label, "/") > 0, F.regexp_replace(label, "/[^/]*$", ""))


def node_tables(nodes: DataFrame, schema_paths: dict[str, str]) -> dict[str, DataFrame]:
    """One flat table per name: the nodes of one schema path with their parent link."""
    return {
        name: nodes.where(F.col("schema_path").rlike("^" + path.replace("*", "[^/]+") + "$")).select(
            "record_id", "label", parent_label(F.col("label")).alias("parent_label"), "kind", "value"
        )
        for name, path in schema_paths.items()
    }

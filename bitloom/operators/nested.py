"""Deeply nested records as flat tables that keep parent-child links, by Dewey labels.

One pass over each body numbers the objects under repeating names: an object's label is that of the nearest enclosing
labelled object, a dot and its own ordinal there. A parent is therefore found by cutting the label's last part, and rows
of one schema path (the path without indexes) form one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names whose values repeat.
REPEATING = (
    "Segment", "Info", "Tracks", "TrackEntry", "ContentEncoding", "Tags", "Tag", "SimpleTag", "Cluster", "BlockGroup",
    "page", "chunk", "metadata", "atom", "descr",
)

NODE_SCHEMA = "record_id long, label string, steps array<string>, body string"


def _decoded(value):
    """``value``, or what it encodes if it is JSON text of an object or a list (repeatedly so)."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            break
    return value


def walk(body: str | None, repeating: frozenset[str]) -> Iterator[tuple[str, list[str], dict]]:
    """(label, steps, object) for each object under a repeating name, parents before their children; nothing for unreadable text.

    ``steps`` has one entry per part of the label: the path from the labelled parent. Without recursion, so that depth
    is bounded only by what the JSON reader accepts.
    """
    try:
        root = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return
    children: dict[str, int] = {}
    # a frame: value, label of the nearest row, its steps, path since that row
    stack = [(_decoded(root), "", [], [])]
    while stack:
        value, label, steps, since = stack.pop()
        if isinstance(value, list):  # of a name that doesn't repeat: its objects share the name's path
            stack.extend((_decoded(x), label, steps, since) for x in reversed(value))
            continue
        if not isinstance(value, dict):
            continue
        found = []
        for name, raw in value.items():
            inner = _decoded(raw)
            if name not in repeating:
                found.append((inner, label, steps, [*since, name]))
                continue
            for i, x in enumerate(inner if isinstance(inner, list) else [inner]):
                x = _decoded(x)
                if not isinstance(x, dict):
                    continue
                ordinal = children[label] = children.get(label, 0) + 1
                own, way = f"{label}.{ordinal}" if label else str(ordinal), [*steps, "/".join([*since, f"{name}[{i}]"])]
                yield own, way, x
                found.append((x, own, way, []))
        stack.extend(reversed(found))


def members(node: dict, repeating: frozenset[str]) -> dict[str, str | None]:
    """The object's own values as text by their path within it; what lies in objects that have rows of their own is left to those.

    Lists without objects and empty objects stay JSON text, objects in lists of a name that doesn't repeat are told apart
    by ``[i]``, and so are values under a repeating name that are no objects. Without recursion, as :func:`walk`.
    """
    out: dict[str, str | None] = {}
    stack = [("", node)]
    while stack:
        path, value = stack.pop()
        value = _decoded(value)
        if isinstance(value, dict) and (value or not path):
            for name, x in reversed(value.items()):
                own = f"{path}/{name}" if path else name
                if name not in repeating:
                    stack.append((own, x))
                    continue
                x = _decoded(x)
                plain = [(f"{own}[{i}]", y) for i, y in enumerate(map(_decoded, x if isinstance(x, list) else [x])) if y is not None and not isinstance(y, dict)]
                stack.extend(reversed(plain))
        elif isinstance(value, list) and any(isinstance(_decoded(x), (dict, list)) for x in value):
            stack.extend((f"{path}[{i}]", x) for i, x in reversed(list(enumerate(value))))
        else:
            out[path] = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return out


def label_nodes(records: DataFrame, body: str = "body", repeating: tuple[str, ...] = REPEATING, keep_body: bool = True, keep_members: bool = False) -> DataFrame:
    """One row (record_id, label, steps, body, with ``keep_members`` also members) per object under a repeating name.

    Null, empty and unreadable bodies give no row, nulls in lists are counted and give none, a lone object counts as a
    list of one, and JSON text inside the tree is opened. Repeated deliveries of a record fold to one first.
    """
    names = frozenset(repeating)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(rid, label, steps, json.dumps(x, ensure_ascii=False) if keep_body else None, *([members(x, names)] if keep_members else [])) for rid, text in zip(batch["record_id"], batch["body"]) for label, steps, x in walk(text, names)]
            yield pd.DataFrame(out, columns=["record_id", "label", "steps", "body", *(["members"] if keep_members else [])])

    once = records.select("record_id", F.col(body).alias("body")).where("body is not null and record_id is not null").dropDuplicates(["record_id"])
    return once.mapInPandas(run, NODE_SCHEMA + (", members map<string, string>" if keep_members else ""))


def node_path(steps: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def flatten(nodes: DataFrame) -> DataFrame:
    """``nodes`` with path, parent_path and parent_label by truncation, schema_path (the table it belongs to) and ordinal."""
    steps = F.col("steps")
    above = F.slice(steps, F.lit(1), F.size(steps) - 1)
    return nodes.select(
        "record_id",
        "label",
        F.regexp_replace("label", r"\.?\d+$", "").alias("parent_label"),
        F.substring_index("label", ".", -1).cast("int").alias("ordinal"),
        node_path(steps).alias("path"),
        node_path(above).alias("parent_path"),
        F.regexp_replace(node_path(steps), r"\[\d+\]", "").alias("schema_path"),
        "body",
        *(["members"] if "members" in nodes.columns else []),
    )


def table_of(flat: DataFrame, name: str, members: dict[str, str]) -> DataFrame:
    """The rows whose schema path ends in ``name``, with the columns ``members`` (column: JSON path within the object)."""
    rows = flat.where(F.element_at(F.split("schema_path", "/"), -1) == name)
    return rows.select("record_id", "path", "parent_path", *[F.get_json_object("body", p).alias(c) for c, p in members.items()])

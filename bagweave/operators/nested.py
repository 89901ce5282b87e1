"""Deeply nested JSON records as related flat tables, with Merkle identities for every object.

Each JSON object is canonicalised and hashed bottom-up, its nested objects standing in it as references to their own
hashes. Equal objects thus get equal identities and are stored once; bridge rows (parent, field, ordinal, child) and
root rows (record, identity) keep every occurrence, so that each record can be rebuilt exactly.

Results for special input: a NULL, empty, broken or incomplete payload yields no rows; a payload that is a JSON string
holds the document inside it; records without an id keep a NULL id; repeated rows count once; nesting of any depth is
read, the traversals use explicit stacks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagweave.session import materialize

GRAPH_CLASS = "Graph"
KINDS = ("root", "node", "edge", "graph", "list")
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def parse_deep(text: str):
    """Parses JSON with an explicit stack, for documents nested deeper than the interpreter's own parser allows."""
    pos, stack, keys, done = _SPACE.match(text, 0).end(), [], [], object()
    value = done
    while True:
        c = text[pos : pos + 1]
        if value is done:
            if c == "{" or c == "[":
                box = {} if c == "{" else []
                pos = _SPACE.match(text, pos + 1).end()
                if text[pos : pos + 1] == ("}" if c == "{" else "]"):
                    pos, value = pos + 1, box
                else:
                    stack.append(box)
                    if c == "{":
                        pos = _key(text, pos, keys)
                    continue
            elif c == '"':
                value, pos = scanstring(text, pos + 1, True)
            elif m := _NUMBER.match(text, pos):
                value, pos = (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, pos)), None)
                if word is None:
                    raise ValueError(f"no value at {pos}")
                value, pos = _WORDS[word], pos + len(word)
        pos = _SPACE.match(text, pos).end()
        if not stack:
            if pos != len(text):
                raise ValueError(f"more text at {pos}")
            return value
        box, c = stack[-1], text[pos : pos + 1]
        if isinstance(box, dict):
            box[keys.pop()] = value
        else:
            box.append(value)
        if c == ",":
            pos, value = _SPACE.match(text, pos + 1).end(), done
            if isinstance(box, dict):
                pos = _key(text, pos, keys)
        elif c == ("}" if isinstance(box, dict) else "]"):
            pos, value = pos + 1, stack.pop()
        else:
            raise ValueError(f"no delimiter at {pos}")


def _key(text: str, pos: int, keys: list[str]) -> int:
    if text[pos : pos + 1] != '"':
        raise ValueError(f"no key at {pos}")
    key, pos = scanstring(text, pos + 1, True)
    keys.append(key)
    pos = _SPACE.match(text, pos).end()
    if text[pos : pos + 1] != ":":
        raise ValueError(f"no colon at {pos}")
    return _SPACE.match(text, pos + 1).end()


def parse(payload: str | None):
    """(True, value) of a payload, or (False, None) when it isn't complete JSON."""
    while isinstance(payload, str):
        text = payload.lstrip("﻿")
        try:
            payload = json.loads(text)
        except RecursionError:
            try:
                payload = parse_deep(text)
            except ValueError:
                return False, None
        except ValueError:
            return False, None
    return payload is not None, payload


def _encoder():
    """Canonical JSON text of one value: sorted keys, no spaces; 1 and 1.0 stay different."""
    escape = json.encoder.encode_basestring_ascii
    if json.encoder.c_make_encoder is None:
        return json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode
    make = json.encoder.c_make_encoder(None, None, escape, None, ":", ",", True, False, True)
    return lambda x: "".join(make(x, 0))


def merkle(value) -> tuple[dict[int, str], dict[str, str], list[tuple[str, str, str, str]]]:
    """Identities of all objects in a value: by id(), their canonical bodies by identity, and the bridge rows.

    Bottom-up: an object is written with references in place of the objects below it, and hashed.
    """
    of: dict[int, str] = {}
    bodies: dict[str, str] = {}
    edges: list[tuple[str, str, str, str]] = []
    if not isinstance(value, (dict, list)):
        return of, bodies, edges
    order, stack = [], [value]
    while stack:
        x = stack.pop()
        order.append(x)
        for y in x.values() if type(x) is dict else x:
            if type(y) is dict or type(y) is list:
                stack.append(y)
    encode = _encoder()
    # what stands for a box in the one around it, and the objects that it brings, by their places in it
    stands: dict[int, dict | list] = {}
    below: dict[int, list[tuple[str, str]]] = {}
    for x in reversed(order):
        if type(x) is list:
            inner = [(str(i), y) for i, y in enumerate(x) if type(y) is dict or type(y) is list]
            stands[id(x)] = [stands[id(y)] if type(y) is dict or type(y) is list else y for y in x] if inner else x
            below[id(x)] = [(f"{i}.{p}" if p else i, h) for i, y in inner for p, h in below[id(y)]]
            continue
        inner = [(k, v) for k, v in x.items() if type(v) is dict or type(v) is list]
        body = encode(x | {k: stands[id(v)] for k, v in inner} if inner else x)
        own = blake2b(body.encode(), digest_size=16).hexdigest()
        of[id(x)], stands[id(x)], below[id(x)] = own, {"$ref": own}, [("", own)]
        if own not in bodies:
            bodies[own] = body
            edges.extend((own, k, p, h) for k, v in inner for p, h in below[id(v)])
    return of, bodies, edges


def graphs_of(value) -> list[dict]:
    """The objects of class Graph, in the order of the document."""
    found, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if x.get("__json_class__") == GRAPH_CLASS:
                found.append(x)
            stack.extend(y for y in reversed(x.values()) if isinstance(y, (dict, list)))
        elif isinstance(x, list):
            stack.extend(y for y in reversed(x) if isinstance(y, (dict, list)))
    return found


def items_below(node: str, held: dict[str, list[tuple[int, str]]]) -> Iterator[tuple[str, str | None, int, str]]:
    """(path, parent's path, place, item's identity) of each item below a graph, by the bridge rows of field `items`.

    held: the items in an object's own `items`, as (place, identity).
    """
    stack = [(None, node)]
    while stack:
        path, holder = stack.pop()
        for place, item in held.get(holder, ()):
            own = str(place) if path is None else f"{path}.{place}"
            yield own, path, place, item
            stack.append((own, item))


def held_items(edges: list[tuple[str, str, str, str]]) -> dict[str, list[tuple[int, str]]]:
    """From bridge rows, the items of each object: those right in its `items`; one object stands for a list of one."""
    held: dict[str, list[tuple[int, str]]] = {}
    for parent, field, ordinal, child in edges:
        if field == "items" and "." not in ordinal:
            held.setdefault(parent, []).append((int(ordinal or 0), child))
    return held


def rebuild(root: str, bodies: dict[str, str]):
    """A record's value from its root identity and the node table (for checks; recursion follows the nesting)."""

    def open_refs(x):
        if isinstance(x, dict):
            return open_refs(json.loads(bodies[x["$ref"]])) if set(x) == {"$ref"} and x["$ref"] in bodies else {k: open_refs(v) for k, v in x.items()}
        return [open_refs(y) for y in x] if isinstance(x, list) else x

    return open_refs(json.loads(bodies[root]))["$"]


_COLUMNS = {"record_id": None, "record": pa.string(), "kind": pa.string(), "graph_no": pa.int64(), "field": pa.string(), "ordinal": pa.string(), "node": pa.string(), "child": pa.string(), "body": pa.string()}
_ITEM = {"item_path": pa.string(), "parent_path": pa.string(), "ordinal": pa.int64(), "node": pa.string(), "type": pa.string()}


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def shred(df: DataFrame, id_col: str, payload_col: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All rows of the flat tables, tagged by `kind`; only the wanted kinds are made.

    root: record_id, node. node: node, body. edge: node (parent), field, ordinal (place in the field's arrays), child.
    graph: record_id, record (identity of the whole payload), graph_no, node, body. list: node (a graph), items (the
    items below it, from its bridge rows; once for each identity, however many records hold it).
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"record_id {id_type}, record string, kind string, graph_no bigint, field string, ordinal string, node string, child string, body string, items array<struct<item_path:string,parent_path:string,ordinal:bigint,node:string,type:string>>"
    wanted = frozenset(kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _COLUMNS]
            items: list[list] = [[] for _ in _ITEM]
            ends, listed = [0], set()

            def put(*row, out=out, ends=ends, items=items) -> None:
                for column, x in zip(out, row, strict=True):
                    column.append(x)
                ends.append(len(items[0]))

            for record, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                good, value = parse(payload)
                if not good:
                    continue
                of, bodies, edges = merkle({"$": value})
                root = next(reversed(of.values()))
                if "root" in wanted:
                    put(record, root, "root", None, None, None, root, None, None)
                if "node" in wanted:
                    for node, body in bodies.items():
                        put(None, None, "node", None, None, None, node, None, body)
                if "edge" in wanted:
                    for node, field, ordinal, child in edges:
                        put(None, None, "edge", None, field, ordinal, node, child, None)
                if not wanted & {"graph", "list"}:
                    continue
                held = None
                for n, graph in enumerate(graphs_of(value)):
                    node = of[id(graph)]
                    if "graph" in wanted:
                        put(record, root, "graph", n, None, None, node, None, bodies[node])
                    if "list" in wanted and node not in listed:
                        listed.add(node)
                        if held is None:
                            held, types = held_items(edges), {}
                        for path, parent, place, item in items_below(node, held):
                            if item not in types:
                                types[item] = _text(json.loads(bodies[item]).get("type"))
                            for column, x in zip(items, (path, parent, place, item, types[item]), strict=True):
                                column.append(x)
                        put(None, None, "list", None, None, None, node, None, None)
            kinds_of = [kind or batch.schema.field(0).type for kind in _COLUMNS.values()]
            below = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(items, _ITEM.values(), strict=True)], list(_ITEM))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, kinds_of, strict=True)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), below)], [*_COLUMNS, "items"])

    return df.select(F.col(id_col).alias("record_id"), F.col(payload_col).alias("payload")).where("payload is not null").mapInArrow(rows, schema)


def _graphs(rows: DataFrame) -> DataFrame:
    """The graphs of `shred`'s rows; records that occur again whole count once."""
    return rows.where("kind = 'graph'").select("record_id", "record", "graph_no", "node", "body").dropDuplicates(["record_id", "record", "graph_no"])


def _items(rows: DataFrame) -> DataFrame:
    """Each graph gets the items of its identity, which are stored once."""
    lists = rows.where("kind = 'list'").select("node", "items").groupBy("node").agg(F.first("items").alias("items"))
    return _graphs(rows).drop("body").join(lists, "node").select("record_id", "graph_no", F.inline("items"))


def nested_items(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(record_id, graph_no, item_path, parent_path, ordinal, node, type): one row per occurrence of an item, with its
    graph, its parent item, and its identity. The payloads are read and hashed once."""
    return _items(materialize(shred(df, id_col, payload_col, ("graph", "list"))))


def _label(body: str) -> dict:
    text = F.lower(F.get_json_object(body, "$.label"))
    return {"label": F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False), "label_no": F.get_json_object(body, "$.__label__").try_cast("bigint")}


def nested_tables(df: DataFrame, id_col: str, payload_col: str) -> dict[str, DataFrame]:
    """The flat tables roots, nodes, edges, graphs and items. The payloads are read and hashed once.

    `label` is true or false however it was written (true, "true", 1); `label_no` is `__label__` as a number.
    """
    rows = materialize(shred(df, id_col, payload_col))
    of = lambda kind: rows.where(F.col("kind") == kind)
    return {
        "roots": of("root").select("record_id", "node").distinct(),
        "nodes": of("node").select("node", "body").dropDuplicates(["node"]),
        "edges": of("edge").select(F.col("node").alias("parent"), "field", "ordinal", "child").distinct(),
        "graphs": _graphs(rows).select("record_id", "graph_no", "node", *(c.alias(k) for k, c in _label("body").items())),
        "items": _items(rows),
    }

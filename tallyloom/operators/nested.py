"""Flattening of deeply nested JSON records into related flat tables.

Two steps. The JVM brings the varying shapes of a payload (wrappers, JSON kept as text, keyed
objects in place of lists, lone objects in place of lists) into one canonical nested column with
``from_json`` and higher-order functions. The Arrow buffers of that column are then flattened
level by level: ``list_parent_indices`` gives for each child the row of its parent, ``take``
propagates the keys through it, and offsets give the position within the parent. No Python code
runs per row, but for records whose containers lie below more than ``WRAPPERS`` levels: what the
JVM has not opened then is brought into the same canonical lists by :func:`opened` and takes the
same Arrow path, so any number of wrappers is opened (the JSON reader itself refuses texts nested
more than 1,000 deep, which are unreadable).

Every node has an id made of its input row and its positions on the way down, and the id of its
parent. So two entries of one name, and a record that was sent twice, keep their own children.
Ids hold within one computed node table; :func:`flat_tables` computes it once for all tables.

Results for unusual input: a null, empty or unreadable payload has no nodes; so has an empty or
null list. An entry without a name (a list element with no ``name``, ``stage`` or ``variable``)
is no node. A null record id keeps its nodes with a null key. Repeated records give nodes each
under its own ids, :func:`found_nodes` makes paths distinct. Other columns of the input are
ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.durable import durable

MAP, LIST = "map<string,string>", "array<string>"
#: Spark accepts single quotes unless told otherwise; JSON does not.
STRICT = {"allowSingleQuotes": "false"}
ENTRY = "array<struct<name:string,body:string>>"


@dataclass(frozen=True)
class Branch:
    """A kind of nested list: the keys that hold it, and per level (child key, name field)."""

    label: str
    containers: tuple[str, ...]
    root_name: str
    levels: tuple[tuple[str, str], ...]


#: The containers of the two record kinds.
BRANCHES = (
    Branch("construct", ("hbm5_proxies", "constructs"), "name", (("components", "name"), ("items", "variable"))),
    Branch("step", ("corrected_reasoning_path",), "stage", (("evidence", "variable"),)),
)
CONTAINERS = tuple(k for b in BRANCHES for k in b.containers)
#: Levels of wrappers that the JVM opens; deeper ones are opened in the Arrow step.
WRAPPERS = 4
NODE_SCHEMA = (
    "record_id long, source_row_index long, branch string, depth int, node_id string, parent_id string,"
    " node_path string, parent_path string, name string, body string, ordinal int"
)


def _is(x: Column, mark: str) -> Column:
    return F.ltrim(x).startswith(mark)


def _let(value: Column, use) -> Column:
    """Bind a value once inside a lambda (lambdas take no part in common-subexpression removal)."""
    return F.transform(F.array(value), use)[0]


def entries(text: Column, name_field: str) -> Column:
    """The named entries of a list, a keyed object or a lone object, as (name, body text)."""
    none = F.array().cast(ENTRY)
    pair = lambda n, b: F.struct(n.cast("string").alias("name"), b.cast("string").alias("body"))
    of_list = F.filter(
        F.transform(F.from_json(text, LIST, STRICT), lambda x: pair(F.from_json(x, MAP, STRICT)[name_field], x)),
        lambda e: e["name"].isNotNull(),
    )
    of_object = _let(
        F.from_json(text, MAP, STRICT),
        lambda m: F.when(m[name_field].isNotNull(), F.array(pair(m[name_field], text))).otherwise(
            F.transform(F.map_entries(m), lambda e: pair(e["key"], e["value"]))
        ),
    )
    return F.coalesce(F.when(_is(text, "["), of_list).when(_is(text, "{"), of_object), none)


def _tree(text: Column, name_field: str, levels: tuple[tuple[str, str], ...]) -> Column:
    """Nested canonical lists, from the container's text down to the last level."""
    if not levels:
        return entries(text, name_field)
    child, child_name = levels[0]
    return F.transform(
        entries(text, name_field),
        lambda e: F.struct(
            e["name"].alias("name"),
            e["body"].alias("body"),
            _tree(
                F.when(_is(e["body"], "{"), F.from_json(e["body"], MAP, STRICT)[child]), child_name, levels[1:]
            ).alias("kids"),
        ),
    )


def _held(maps: Column, keys: tuple[str, ...]) -> Column:
    """The non-null values under any of the keys, over a list of maps."""
    found = F.flatten(F.transform(maps, lambda m: F.array(*[m[k] for k in keys])))
    return F.filter(found, lambda x: x.isNotNull())


def _trees(texts: Column, b: Branch) -> Column:
    return F.flatten(F.transform(texts, lambda t: _tree(t, b.root_name, b.levels)))


def canonical(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add one canonical nested column per branch, and ``unopened``: texts below ``WRAPPERS`` levels.

    The payload is first read as the only element of a JSON list, which refuses cut texts and
    trailing text, and turns a payload that is itself a JSON string into its content.
    """
    whole = F.from_json(F.concat(F.lit("["), F.col(payload), F.lit("]")), LIST, STRICT)
    out = df.withColumn("__level", F.when(F.size(whole) == 1, whole))
    hits: list[list[Column]] = [[] for _ in BRANCHES]
    for i in range(WRAPPERS + 1):
        maps = F.transform(
            F.filter("__level", lambda x: _is(x, "{")), lambda x: F.from_json(x, MAP, STRICT)
        )
        lists = F.flatten(F.transform(F.filter("__level", lambda x: _is(x, "[")), lambda x: F.from_json(x, LIST, STRICT)))
        out = out.withColumns({"__maps": maps, "__lists": lists})
        for j, b in enumerate(BRANCHES):
            name = f"__hit_{i}_{j}"
            out = out.withColumn(name, _held(F.col("__maps"), b.containers))
            hits[j].append(F.coalesce(F.col(name), F.array().cast(LIST)))
        inner = F.flatten(
            F.transform("__maps", lambda m: F.map_values(F.map_filter(m, lambda k, v: ~k.isin(*CONTAINERS))))
        )
        nested = lambda x: _is(x, "{") | _is(x, "[")
        out = out.withColumn(
            "__level",
            F.filter(
                F.concat(F.coalesce(inner, F.array().cast(LIST)), F.coalesce("__lists", F.array().cast(LIST))), nested
            ),
        )
    for j, b in enumerate(BRANCHES):
        out = out.withColumn(
            b.label,
            _trees(F.concat(*hits[j]), b),
        )
    return out.withColumn("unopened", F.col("__level"))


def _read(text):
    """The JSON value of a text; None where it is no list or object in strict JSON."""
    if not isinstance(text, str) or text.lstrip()[:1] not in ("{", "["):
        return text if isinstance(text, (dict, list)) else None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _listed(value, name_field: str, levels) -> list[dict]:
    """Canonical entries of one list, keyed object or lone object, down to the last level."""
    value = _read(value)
    if isinstance(value, list):
        pairs = [(d[name_field], x) for x in value if isinstance(d := _read(x), dict) and d.get(name_field) is not None]
    elif isinstance(value, dict):
        pairs = [(value[name_field], value)] if value.get(name_field) is not None else list(value.items())
    else:
        pairs = []
    out = []
    for name, body in pairs:
        entry = {"name": _text(name), "body": _text(body)}
        if levels:
            inner = _read(body)
            entry["kids"] = _listed(inner.get(levels[0][0]) if isinstance(inner, dict) else None, levels[0][1], levels[1:])
        out.append(entry)
    return out


def opened(text: str) -> list[list[dict]]:
    """Per branch the canonical entries of a JSON text with containers at any depth."""
    out: list[list[dict]] = [[] for _ in BRANCHES]
    queue = [text]
    while queue:
        value = _read(queue.pop(0))
        if isinstance(value, list):
            queue.extend(value)
        elif isinstance(value, dict):
            for j, b in enumerate(BRANCHES):
                for k in b.containers:
                    out[j].extend(_listed(value.get(k), b.root_name, b.levels))
            queue.extend(v for k, v in value.items() if k not in CONTAINERS)
    return out


def _same(n: int, value) -> pa.Array:
    return pa.repeat(value, n)


def _counted(ids: pa.Array, ordinal: pa.Array, mark: str) -> pa.Array:
    return pc.binary_join_element_wise(ids, ordinal.cast(pa.string()), mark)


def _children(lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of a list array: parent index of each child, the flat children, their position in the parent."""
    parent = pc.list_parent_indices(lists).cast(pa.int64())
    first = lists.offsets.slice(0, len(lists)).cast(pa.int64())
    start = pc.subtract(first, lists.offsets[0].as_py()) if len(lists) else first
    ordinal = pc.subtract(pa.array(np.arange(len(parent))), start.take(parent)).cast(pa.int32())
    return parent, lists.flatten(), ordinal


def _levels(b: Branch, lists: pa.Array, keys: dict[str, pa.Array], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """The nodes of one branch, level by level; ``ids``: what the ids of the first level begin with."""
    path, mark = None, b.label[0]
    for depth in range(len(b.levels) + 1):
        at, flat, ordinal = _children(lists)
        n = len(at)
        if not n:
            return
        keys = {k: v.take(at) for k, v in keys.items()}
        above = ids.take(at)
        ids = _counted(above, ordinal, mark)
        parent = path.take(at) if path is not None else _same(n, b.containers[-1])
        named = flat.field("name")
        path = named if b.label == "construct" and depth == 0 else pc.binary_join_element_wise(parent, named, "/")
        cols = {
            **keys, "branch": _same(n, b.label), "depth": _same(n, pa.scalar(depth, pa.int32())), "node_id": ids,
            "parent_id": above if depth else pa.nulls(n, pa.string()), "node_path": path, "parent_path": parent, "name": named,
            "body": flat.field("body"), "ordinal": ordinal,
        }
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        mark = "."
        if depth < len(b.levels):
            lists = flat.field("kids")


def flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel: canonical nested columns in, node rows out, level by level."""
    for batch in batches:
        keys = {k: batch.column(k) for k in ("record_id", "source_row_index")}
        ids = batch.column("row").cast(pa.string())
        for b in BRANCHES:
            yield from _levels(b, batch.column(b.label), keys, ids)
        at, texts, ordinal = _children(batch.column("unopened"))
        if len(at):
            trees = [opened(t) for t in texts.to_pylist()]
            deep, deep_ids = {k: v.take(at) for k, v in keys.items()}, _counted(ids.take(at), ordinal, "w")
            for j, b in enumerate(BRANCHES):
                yield from _levels(b, pa.array([t[j] for t in trees], batch.schema.field(b.label).type), deep, deep_ids)


def node_table(df: DataFrame) -> DataFrame:
    """All nodes of all records; ``parent_id`` is null for the first level."""
    slim = df.select("record_id", "source_row_index", "payload").withColumn("row", F.monotonically_increasing_id())
    nested = canonical(slim).select("row", "record_id", "source_row_index", "unopened", *[b.label for b in BRANCHES])
    return nested.mapInArrow(flatten_batches, NODE_SCHEMA)


def flat_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables: constructs, components, items, steps, evidence.

    The node table is computed once and kept, so payloads are parsed once for all five and the
    ids of one table are those of the others.
    """
    nodes = durable(node_table(df))
    field = lambda k: F.get_json_object("body", f"$.{k}")
    pick = lambda branch, depth: nodes.filter((F.col("branch") == branch) & (F.col("depth") == depth))
    link = ["record_id", "source_row_index", "node_id", "parent_id", "node_path", "parent_path", "ordinal", "name"]
    value = F.when(_is(F.col("body"), "{"), field("value")).otherwise(F.col("body"))
    coded = [field("code").try_cast("int").alias("code"), field("weight").try_cast("double").alias("weight")]
    return {
        "constructs": pick("construct", 0).select(*link, field("score").try_cast("double").alias("score")),
        "components": pick("construct", 1).select(*link, value.try_cast("double").alias("value")),
        "items": pick("construct", 2).select(*link, *coded),
        "steps": pick("step", 0).select(
            *link, F.when(_is(F.col("body"), "{"), field("text")).otherwise(F.col("body")).alias("text")
        ),
        "evidence": pick("step", 1).select(*link, *coded),
    }


def found_nodes(df: DataFrame) -> DataFrame:
    """Distinct (record_id, node_path) of all nodes below a construct or reasoning path."""
    below = (F.col("branch") == "step") | (F.col("depth") > 0)
    return node_table(df).filter(below).select("record_id", "node_path").distinct()

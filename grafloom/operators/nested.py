"""Deeply nested records as flat node tables with interval labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of an object that only wraps a list.
LIST_WRAPPERS = ("items", "list", "values", "elements", "data", "records")
# Keys of an object that only wraps a record.
RECORD_WRAPPERS = ("record", "data", "payload", "result", "item", "body", "content", "message")

_DECODER = json.JSONDecoder()
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^0-9A-Za-z]+")
_START = re.compile(r"[{\[]")


def snake(key: str) -> str:
    """One spelling of a key: observedParameters, observed-parameters and
    Observed_Parameters are observed_parameters."""
    return "_".join(p for p in _HUMP.split(key) if p).lower()


def _decoded(text: str):
    """The first complete JSON object, list or string in text; ValueError if
    there is none. What stands before and after it is surrounding matter."""
    text = text.strip("﻿ \t\r\n")
    try:
        return json.loads(text)
    except ValueError:
        pass
    start = _START.search(text)
    if not start:
        raise ValueError("no object")
    at = start.start()
    if at and text[at - 1] == '"' and text[at + 1 :].lstrip()[:1] == "\\":  # a quoted text within other text
        return _DECODER.raw_decode(text, at - 1)[0]
    try:
        return _DECODER.raw_decode(text, at)[0]
    except ValueError:
        if text[at] == "[" and text[at + 1 :].lstrip()[:1] not in '{["':  # a bracketed remark before the object
            return _DECODER.raw_decode(text, text.index("{", at))[0]
        raise


def read_record(text: str | None) -> dict | None:
    """The record in a payload, freed of code fences, remarks, quoting and
    wrappers; None if it is missing, damaged or no object."""
    if text is None:
        return None
    value: object = text
    try:
        while isinstance(value, str):  # each round takes a quoting off, so the text gets shorter
            value = _decoded(value)
    except (ValueError, RecursionError):
        return None
    while True:
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        elif isinstance(value, dict) and len(value) == 1 and isinstance(inner := next(iter(value.values())), dict) and snake(next(iter(value))) in RECORD_WRAPPERS:
            value = inner
        else:
            return value if isinstance(value, dict) else None


def _children(value) -> list[tuple[str, int, object]]:
    """Type, place in the innermost list and value of each child node. A lone
    object counts as a list of one; an object that only wraps a list is it."""
    out: list[tuple[str, int, object]] = []
    if isinstance(value, dict):
        for key, x in value.items():
            if isinstance(x, dict) and len(x) == 1 and isinstance(y := next(iter(x.values())), list) and snake(next(iter(x))) in LIST_WRAPPERS:
                x = y
            if isinstance(x, dict):
                out.append((snake(key), 0, x))
            elif isinstance(x, list):
                out.extend((snake(key), i, y) for i, y in enumerate(x))
    elif isinstance(value, list):
        out.extend(("element", i, y) for i, y in enumerate(value))
    return out


def walk(record: dict) -> Iterator[tuple]:
    """(type, pos, pre, post, depth, parent_pre, parent_type, value) of every
    node, depth first, without recursion; yielded as each node is left."""
    pre = post = 0
    stack = [("", 0, 0, 0, None, None, record, iter(_children(record)))]
    while stack:
        kind, pos, own, depth, up, up_kind, value, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            yield kind, pos, own, post, depth, up, up_kind, value
            post += 1
        else:
            pre += 1
            stack.append((child[0], child[1], pre, depth + 1, own, kind, child[2], iter(_children(child[2]))))


def _text(value) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


_NODES = pa.schema([
    ("type", pa.string()), ("pos", pa.int32()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("parent_pre", pa.int32()),
    ("parent_type", pa.string()), ("is_null", pa.bool_()), ("attributes", pa.map_(pa.string(), pa.string())),
])


def nested_nodes(df: DataFrame, record_id: str, payload: str, *, types: list[str] | None = None, attributes: list[str] | None = None) -> DataFrame:
    """One row for every node of every record: the record itself (type ''),
    each object in a field, and each element of a list.

    Each node bears the pre-order and post-order numbers of a depth-first
    traversal: a is inside b if a.pre > b.pre and a.post < b.post. type is the
    key in one spelling (snake case), pos the place in the innermost list from
    0 (null elements count; a lone object is a list of one), attributes the
    scalar fields as text, is_null marks null elements.

    df          record_id (bigint) and the JSON text payload; others are ignored
    types       emit only nodes of these types (labels still count all nodes)
    attributes  keep only these scalar fields
    returns     record_id, type, pos, pre, post, depth, parent_pre, parent_type,
                is_null, attributes

    Missing payloads and such that are no complete JSON object, even freed of
    what surrounds or quotes them, give no row. A repeated row gives its nodes
    again: drop repeats by record_id before. Records are independent, so the
    work splits evenly however the ids are spread.
    """
    wanted, kept = types and frozenset(types), attributes and frozenset(attributes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(10)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = read_record(text)
                if record is None:
                    continue
                for kind, pos, pre, post, depth, up, up_kind, value in walk(record):
                    if wanted and kind not in wanted:
                        continue
                    if isinstance(value, dict):
                        own = [(n, _text(x)) for k, x in value.items() if not isinstance(x, (dict, list)) and (not kept or (n := snake(k)) in kept) and (n := snake(k))]
                        own = list(dict(own).items())
                    else:
                        own = [] if value is None or isinstance(value, list) else [("value", _text(value))]
                    for column, x in zip(columns, (rid, kind, pos, pre, post, depth, up, up_kind, value is None, own)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, *_NODES.types])], names=["rid", *_NODES.names])

    rows = df.select(F.col(record_id).alias("rid"), F.col(payload).cast("string").alias("payload"))
    kind = rows.schema["rid"].dataType.simpleString()
    shape = f"rid {kind}, type string, pos int, pre int, post int, depth int, parent_pre int, parent_type string, is_null boolean, attributes map<string,string>"
    return rows.mapInArrow(run, shape).withColumnRenamed("rid", record_id)


_NODE = "struct<type:string,pos:int,pre:int,post:int,depth:int,parent_pre:int,parent_type:string,is_null:boolean,attributes:map<string,string>>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType))


def _size(x: Column, kind: T.DataType) -> Column:
    """Number of nodes of a value: of a record itself and all inside it, of a
    list all in it."""
    if isinstance(kind, T.StructType):
        inside = [_size(x[f.name], f.dataType) for f in kind.fields if _is_nested(f.dataType)]
        return F.when(x.isNotNull(), reduce(lambda a, b: a + b, inside, F.lit(1))).otherwise(0)
    if not _is_nested(kind.elementType):
        return F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0))
    each = lambda a, e: a + F.greatest(_size(e, kind.elementType), F.lit(1))  # noqa: E731 - a null element is a node
    return F.coalesce(F.aggregate(x, F.lit(0), each), F.lit(0))


def _node(kind: str, pos: Column, pre: Column, size: Column, depth: int, up: Column, up_kind: str | None, is_null: Column, attributes: Column) -> Column:
    # In a depth-first order, pre - post = depth + 1 - size.
    return F.struct(F.lit(kind), pos.cast("int"), pre.cast("int"), (pre + size - 1 - depth).cast("int"), F.lit(depth), up.cast("int"), F.lit(up_kind), is_null, attributes).cast(_NODE)


def _nodes(x: Column, kind: T.DataType, name: str, pos: Column, pre: Column, depth: int, up: Column, up_kind: str | None, wanted: frozenset | None, kept: frozenset | None) -> Column:
    """The wanted nodes of a value as an array: of a record, whose number is pre,
    or of a list, whose first element has it."""
    none = F.array().cast(f"array<{_NODE}>")
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if not kept or f.name in kept]
        shown = [F.struct(F.lit(f.name).alias("k"), (F.lit(None) if _is_nested(f.dataType) else x[f.name]).cast("string").alias("v"), (x[f.name].isNull() if _is_nested(f.dataType) else F.lit(True)).alias("own")) for f in fields]
        attributes = F.map_from_entries(F.transform(F.filter(F.array(*shown), lambda e: e["own"]), lambda e: F.struct(e["k"], e["v"]))) if shown else F.create_map().cast("map<string,string>")
        own = [F.array(_node(name, pos, pre, _size(x, kind), depth, up, up_kind, F.lit(False), attributes))] if not wanted or name in wanted else []

        def field(f: T.StructField) -> Callable[[Column], Column]:
            return lambda at: _nodes(x[f.name], f.dataType, f.name, F.lit(0), at, depth + 1, pre, name, wanted, kept)

        after = pre + 1
        for f in kind.fields:
            if _is_nested(f.dataType):
                if not wanted or _has(f.dataType, f.name, wanted):
                    own.append(_with(after, field(f)))
                after = after + _size(x[f.name], f.dataType)
        return F.when(x.isNotNull(), F.concat(none, *own)).otherwise(none)
    inner = kind.elementType
    if not _is_nested(inner):
        value = lambda e: F.when(e.isNotNull(), F.create_map(F.lit("value"), e.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
        return F.coalesce(F.transform(x, lambda e, i: _node(name, i, pre + i, F.lit(1), depth, up, up_kind, e.isNull(), value(e))), none)
    sizes = F.transform(x, lambda e: F.greatest(_size(e, inner), F.lit(1)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    empty = F.array(*([_node(name, F.lit(0), F.lit(0), F.lit(1), depth, up, up_kind, F.lit(True), F.create_map().cast("map<string,string>"))] if not wanted or name in wanted else [])).cast(f"array<{_NODE}>")

    def element(e: Column, i: Column, start: Column) -> Column:
        null = F.transform(empty, lambda n: n.withField("pos", i.cast("int")).withField("pre", (pre + start).cast("int")).withField("post", (pre + start - depth).cast("int")).withField("parent_pre", up.cast("int")))
        return F.when(e.isNull(), null).otherwise(_with(pre + start, lambda at: _nodes(e, inner, name, i, at, depth, up, up_kind, wanted, kept)))

    return F.coalesce(_with(starts, lambda at: F.flatten(F.transform(x, lambda e, i: element(e, i, F.get(at, i))))), none)


def _has(kind: T.DataType, name: str, wanted: frozenset) -> bool:
    """Whether nodes of the wanted types may lie in a field."""
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return name in wanted or isinstance(inner, T.StructType) and any(_is_nested(f.dataType) and _has(f.dataType, f.name, wanted) for f in inner.fields)


def typed_nodes(df: DataFrame, record_id: str, *columns: str, types: list[str] | None = None, attributes: list[str] | None = None) -> DataFrame:
    """As nested_nodes, for records whose nested values are typed columns
    (structs, lists, lists of structs) in place of JSON text: the record's own
    node has these columns as its fields. Labels come from the sizes of the
    values, inside the JVM; every column counts, whatever types are emitted.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(record_id, F.struct(*columns).alias("_r"))
    shape = T.StructType([T.StructField(c, kinds[c]) for c in columns])
    nodes = _nodes(F.col("_r"), shape, "", F.lit(0), F.lit(0), 0, F.lit(None), None, types and frozenset(types), attributes and frozenset(attributes))
    return rows.select(record_id, F.explode(nodes).alias("_n")).select(record_id, "_n.*")


def node_table(nodes: DataFrame, record_id: str, kind: str, columns: dict[str, str], *, of: str | None = None) -> DataFrame:
    """The table of one node type: record_id, its labels (pre, post, parent_pre),
    pos, and attributes as columns of the given types (null where they are
    missing or do not fit). Null elements have no row. of: only children of
    nodes of this type."""
    rows = nodes.where((F.col("type") == kind) & ~F.col("is_null"))
    if of is not None:
        rows = rows.where(F.col("parent_type") == of)
    return rows.select(record_id, "pre", "post", "parent_pre", "pos", *(F.try_element_at("attributes", F.lit(c)).try_cast(t).alias(c) for c, t in columns.items()))


def link(nodes: DataFrame, record_id: str, is_child, is_parent, parent_columns: dict[str, str]) -> DataFrame:
    """Children with columns of the nearest parent that contains them.

    Nodes of a record are passed in pre-order; the last parent opened before a
    child contains it if its post number is greater. Parents must not nest in
    each other (elements of one list never do).

    nodes           from nested_nodes
    is_child, is_parent   conditions on a node
    parent_columns  parent's column -> name in the result
    returns         the columns of the child and those of its parent; children
                    without a parent are left out
    """
    opened = Window.partitionBy(record_id).orderBy("pre", F.desc("post")).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.struct("post", *parent_columns)
    with_parent = nodes.where(is_child | is_parent).withColumn("_p", F.last(F.when(is_parent, parent), ignorenulls=True).over(opened))
    return with_parent.where(is_child & (F.col("_p.post") > F.col("post"))).select(
        *nodes.columns, *(F.col(f"_p.{c}").alias(n) for c, n in parent_columns.items())
    )

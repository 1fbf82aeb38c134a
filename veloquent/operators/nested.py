"""Nested JSON documents as flat node tables, linked by interval labels.

A depth-first traversal numbers every value of a document (objects, arrays, scalars and nulls alike): ``pre``
on the way down, ``post`` on the way up, from one counter, so that a node lies inside another of the same
document exactly if ``a.pre < d.pre AND d.post < a.post``. Which node belongs to which is told by these
intervals alone; no other link is kept. Rows are the values found at wanted paths, an array standing for its
elements; an object's scalar fields are its ``fields``, whatever their names, so nothing is lost by fields that
come and go.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloquent.functions.udf import let

_LABELS = "kind:int,pre:int,post:int,pos:int,scalar:boolean"
_ARROW = [pa.field("kind", pa.int32()), pa.field("pre", pa.int32()), pa.field("post", pa.int32()), pa.field("pos", pa.int32()), pa.field("scalar", pa.bool_())]
_FIELDS = pa.field("fields", pa.map_(pa.string(), pa.string()))

_GAP = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"true|false|null|NaN|Infinity|-Infinity|(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_NAMED = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def parse_deep(text: str):
    """``json.loads`` with a stack of its own, for documents nested deeper than the interpreter recurses."""
    top: list = []
    open_: list = [top]  # the containers around the place reached, innermost last
    keys: list = [None]  # per container, the key whose value comes next
    at, state = _GAP.match(text, 0).end(), "value"
    n = len(text)
    while True:
        if state == "done":
            if at != n:
                raise ValueError("text after the document")
            return top[0]
        if at >= n:
            raise ValueError("the document breaks off")
        c, inner = text[at], open_[-1]
        if state == "key" or (state == "first key" and c != "}"):
            if c != '"':
                raise ValueError("a key is due")
            keys[-1], at = scanstring(text, at + 1, True)
            at = _GAP.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("a colon is due")
            at, state = _GAP.match(text, at + 1).end(), "value"
            continue
        if c in "]}" and (state == "next" or state == ("first value" if c == "]" else "first key")):
            if len(open_) == 1 or (inner.__class__ is list) != (c == "]"):
                raise ValueError("nothing to close")
            open_.pop()
            keys.pop()
            at, state = at + 1, "next"
        elif state == "next":
            if c != ",":
                raise ValueError("a comma is due")
            at, state = at + 1, "value" if inner.__class__ is list else "key"
        else:
            if c in "[{":
                v = [] if c == "[" else {}
                at += 1
            elif c == '"':
                v, at = scanstring(text, at + 1, True)
            else:
                m = _ATOM.match(text, at)
                if m is None:
                    raise ValueError("a value is due")
                whole, part, power = m.groups()
                v = _NAMED[m.group()] if whole is None else float(m.group()) if part or power else int(whole)
                at = m.end()
            if inner.__class__ is list:
                inner.append(v)
            else:
                inner[keys[-1]] = v
            state = "next"
            if c in "[{":
                open_.append(v)
                keys.append(None)
                state = "first value" if c == "[" else "first key"
        at = _GAP.match(text, at).end()
        if state == "next" and len(open_) == 1:
            state = "done"


def _loads(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return parse_deep(text)


def read_document(text: str | None):
    """The document a value holds, however deep; a JSON string is read as the document inside it. None if there is none."""
    if text is None:
        return None
    try:
        v = _loads(text)
        while isinstance(v, str):
            v = _loads(v)
        return v
    except ValueError:
        return None


class Paths:
    """Wanted paths as a tree of keys; ``index`` is the path's place among them, None on the way there.

    A None among the wanted takes a place and is never found."""

    __slots__ = ("index", "below")

    def __init__(self) -> None:
        self.index: int | None = None
        self.below: dict[str, Paths] = {}

    @classmethod
    def of(cls, root: str, wanted: Sequence[str | None]) -> Paths:
        tree = cls()
        for i, path in enumerate(wanted):
            if path is None:
                continue
            first, *keys = path.split(".")
            if first != root:
                raise ValueError(f"{path} does not start at {root}")
            at = tree
            for k in keys:
                at = at.below.setdefault(k, cls())
            at.index = i
        return tree


def _values(v) -> int:
    """How many values a value consists of, itself included."""
    n, todo = 0, [v]
    while todo:
        x = todo.pop()
        n += 1
        if x.__class__ is dict:
            todo += x.values()
        elif x.__class__ is list:
            todo += x
    return n


def _text(x) -> str | None:
    return x if x is None or x.__class__ is str else json.dumps(x)


def label(doc, tree: Paths, with_fields: bool = True) -> list[list]:
    """Rows [kind, pre, post, pos, scalar, fields] of one document, by rising ``post``.

    ``kind`` is the index of the wanted path. The labels are those of the whole document, whatever is wanted. The
    scalars of an object are visited before its objects and arrays. Scalars and nulls in an array at a wanted path
    are rows with one field "", as is a scalar in place of such an array; a null in its place is nothing.
    The traversal keeps its own stack, so depth is no limit.
    """
    out: list[list] = []
    clock = 0
    # an entry is (value, place in the tree, pos) going down, or a list on the way up: the row, if there is one
    stack: list = [(doc, tree, 0)]
    while stack:
        item = stack.pop()
        if item.__class__ is list:
            if item:
                item[2] = clock
                out.append(item)
            clock += 1
            continue
        v, at, pos = item
        if at is None:  # nothing is wanted there
            clock += 2 * _values(v)
        elif v.__class__ is dict:
            below = at.below
            row = [] if at.index is None else [at.index, clock, 0, pos, False, None]
            clock += 1
            fields, down = [], []
            for k, x in v.items():
                if x.__class__ is dict or x.__class__ is list:
                    down.append((x, below.get(k), 0))
                    continue
                if below and x is not None and (inside := below.get(k)) and inside.index is not None:
                    out.append([inside.index, clock, clock + 1, 0, True, [("", _text(x))] if with_fields else None])
                clock += 2
                if with_fields:
                    fields.append((k, _text(x)))
            if row and with_fields:
                row[5] = fields
            if down:
                stack.append(row)
                down.reverse()
                stack += down
            else:
                if row:
                    row[2] = clock
                    out.append(row)
                clock += 1
        elif v.__class__ is list:
            clock += 1  # the array's pre; its elements hang below the object that holds it
            stack.append([])
            for i in range(len(v) - 1, -1, -1):
                stack.append((v[i], at, i))
        else:
            if at.index is not None:
                out.append([at.index, clock, clock + 1, pos, True, [("", _text(v))] if with_fields else None])
            clock += 2
    return out


def nodes(df: DataFrame, id_col: str, json_col: str, origin: str, root: str, wanted: Sequence[str | None], with_fields: bool = True) -> DataFrame:
    """(origin, row_id, nodes): per document its node rows, packed, by rising ``post``; documents without any have no row.

    A node is (kind, pre, post, pos, scalar[, fields map]). Scanning, parsing and labelling are one pass without a
    shuffle, an Arrow batch at a time. Values that are null, no complete JSON or hold only ``null`` have no nodes. An
    object where ``root`` should be an array is an array of one; null elements take a position. Only the id and the
    JSON column are read, whatever else the table has.
    """
    tree = Paths.of(root, wanted)
    parts = [*_ARROW, _FIELDS] if with_fields else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, flat = [], [0], []

        def batch() -> pa.RecordBatch:
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), parts)], fields=parts)
            packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            return pa.record_batch([pa.array([origin] * len(ids), pa.string()), pa.array(ids, pa.string()), packed], names=["origin", "row_id", "nodes"])

        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = read_document(text)
                rows = label(doc, tree, with_fields) if doc is not None else ()
                if not rows:
                    continue
                flat += rows
                ids.append(rid)
                ends.append(len(flat))
                if ends[-1] > 20_000:
                    yield batch()
                    ids, ends, flat = [], [0], []
        if ids:
            yield batch()

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).cast("string").alias("doc")).filter(F.col("doc").isNotNull())
    node = _LABELS + (",fields:map<string,string>" if with_fields else "")
    return rows.mapInArrow(run, f"origin string, row_id string, nodes array<struct<{node}>>")


def is_null(n: Column) -> Column:
    """Whether a node (with fields) is a null element of an array, which takes a position and is nothing else."""
    return n["scalar"] & n["fields"][""].isNull()


def of_kind(packed: Column, *kinds: int) -> Column:
    return F.filter(packed, lambda n: n["kind"].isin(list(kinds)))


def childless(packed: Column, parent: int, child: int) -> Column:
    """The objects of kind ``parent`` with no node of kind ``child`` inside.

    By rising ``post``, the node before another is inside it exactly if anything is: its ``post`` is the nearest
    below, and all that is inside comes after all that ended before the parent began. One comparison of ``pre`` a
    node thus decides containment, at any depth and for documents of any length.
    """
    before = lambda xs, i: F.when(i > 0, F.get(xs, i - 1)["pre"])
    alone = lambda xs: F.filter(xs, lambda n, i: (n["kind"] == parent) & ~n["scalar"] & ~F.coalesce(before(xs, i) > n["pre"], F.lit(False)))
    return let(of_kind(packed, parent, child), alone)


def families(packed: Column, parent: int, child: int) -> Column:
    """array<struct<parent, children>>: each node of kind ``parent`` with the nodes of kind ``child`` inside it.

    By rising ``post``, what a parent contains stands between the parent before it and itself, and of that all with
    a greater ``pre`` is inside. So each node is looked at once per document. ``parent`` nodes must not contain
    each other, as elements of one array do not.
    """

    def grouped(xs: Column) -> Column:
        places = F.filter(F.transform(xs, lambda n, i: F.when(n["kind"] == parent, i)), lambda i: i.isNotNull())

        def one(ps: Column, at: Column, k: Column) -> Column:
            start = F.when(k > 0, F.get(ps, k - 1) + 1).otherwise(F.lit(0))
            inside = lambda p: F.filter(F.slice(xs, start + 1, at - start), lambda n: (n["pre"] > p["pre"]) & (n["post"] < p["post"]))
            return let(F.get(xs, at), lambda p: F.struct(p.alias("parent"), inside(p).alias("children")))

        return let(places, lambda ps: F.transform(ps, lambda at, k: one(ps, at, k)))

    return let(of_kind(packed, parent, child), grouped)


def once_per_document(found: DataFrame, rows: Column, columns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(origin, row_id, *columns): a row per element of ``rows``, made by ``columns``; documents delivered twice count once.

    What travels in the one shuffle is a row per document with the finished columns packed in it: neither documents
    nor maps, and an id once for all its nodes. Documents without an id are told apart by their rows.
    """
    slim = found.select("origin", "row_id", F.transform(rows, lambda n: F.struct(*[f(n).alias(c) for c, f in columns.items()])).alias("rows"))
    slim = slim.filter(F.size("rows") > 0).withColumn("_anonymous", F.when(F.col("row_id").isNull(), F.xxhash64("rows")))
    return slim.dropDuplicates(["origin", "row_id", "_anonymous"]).select("origin", "row_id", F.inline("rows"))


def field(name: str, kind: str) -> Callable[[Column], Column]:
    """A field of a node cast to a type; null if absent or unfit."""
    return lambda n: n["fields"][name].try_cast(kind)


def contained(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """Pairs (origin, row_id, ancestor_pre, descendant_pre) of nodes of which one lies inside the other.

    The equality on origin and row keeps each comparison inside one document; containment of the intervals
    decides within it, at any depth. For node tables that were written apart.
    """
    a = ancestors.select("origin", "row_id", F.col("pre").alias("ancestor_pre"), F.col("post").alias("_ap"))
    d = descendants.select("origin", "row_id", F.col("pre").alias("descendant_pre"), F.col("post").alias("_dp"))
    inside = (F.col("ancestor_pre") < F.col("descendant_pre")) & (F.col("_dp") < F.col("_ap"))
    return a.join(d, ["origin", "row_id"]).filter(inside).drop("_ap", "_dp")

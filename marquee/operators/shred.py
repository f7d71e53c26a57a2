"""Nested records to related flat tables by shared inlining of their schema graph.

1. `schema_graph` walks every record once and aggregates the distinct nodes of the nesting: the steps that lead to
   them and what stands there. An object that is built like one it stands in is the same element again, so a
   recursive element is one node with an edge back to itself. The graph is as large as the schema, not as the data.
2. `plan_tables` reads the graph: what wraps a level and how many lists deep it is follow from the structure, not
   from names. Then every element is placed: what occurs at most once below an element is inlined as columns of its
   table; what repeats, recurs, or is built alike below several parents (shared) gets a table of its own.
3. `shred` emits one row per element of each table with its key (the concrete path), the table and key of its parent,
   its positions, and its inlined columns; `relations` gives one typed DataFrame per table.

Records are given as JSON text. What counts as the same structure: a JSON text inside a string, at any level and any
number of times; a record inside more lists or inside an object of its own; a list inside an object that has
otherwise nothing of its elements; a lone object or scalar in place of a list; a list of scalars where lists of lists
are usual. None of these changes a position. Text that is no JSON, null or empty gives no rows; repeated records give
repeated rows; columns of the input other than key and body are ignored, so clashing names cannot occur. Null
elements count positions and give no rows. Keys may hold any characters; in names of columns they are quoted where
they hold a dot. Where a scalar stands in place of an object, it is the column `$`.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpointed

GRAPH = "path string, kind string"
ROWS = "record bigint, element string, key string, parent string, parent_key string, own array<int>, scalar string, columns map<string,string>"
MAX_NODES = 100_000
#: Share of common keys from which an object counts as built like another.
ALIKE = 0.5
TYPES = ("boolean", "bigint", "double", "string")
#: How a string that may be encoded JSON begins.
_OPENS = frozenset('{["') | frozenset(" \t\n\r\x0b\x0c\u00a0\ufeff\u3000") | {""}


def decode(text: str | None):
    """The object or list that a JSON text stands for, however often it is encoded as a string; None if there is none."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value.lstrip("﻿"), strict=False)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, (dict, list)) else None


def opened(value):
    """`value` without encoding as a string."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        inner = decode(value)
        return value if inner is None else inner
    return value


def type_of(value) -> str:
    return "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) and abs(value) < 1 << 63 else "double" if isinstance(value, (int, float)) else "string"


# ---- the schema graph -----------------------------------------------------------------------------------------------


class Seen:
    """What was seen at a place: kinds, the places below by key, the place of list elements, the element it repeats."""

    __slots__ = ("kinds", "kids", "item", "back", "path", "last")

    def __init__(self, path: tuple = ()) -> None:
        self.kinds: set[str] = set()
        self.kids: dict[str, Seen] = {}
        self.item: Seen | None = None
        self.back: set[tuple] = set()
        self.path = path
        self.last = next((s for s in reversed(path) if s != 0), None)

    def below(self, step) -> Seen:
        if step == 0:
            if self.item is None:
                self.item = Seen((*self.path, 0))
            return self.item
        kid = self.kids.get(step)
        if kid is None:
            kid = self.kids[step] = Seen((*self.path, step))
        return kid


def _alike(a, b) -> bool:
    return len(a & b) >= ALIKE * len(a | b) if a or b else False


def walk(value, root: Seen) -> None:
    """Add a record to the graph. Objects built like one above them, reached by the same key or having that key themselves, lead back to it."""
    stack = [(value, root, ())]
    while stack:
        value, at, above = stack.pop()
        value = opened(value)
        if isinstance(value, dict):
            keys = value.keys()
            for place, theirs, step in above:
                if (step in keys or (at.last is not None and at.last == place.last)) and _alike(keys, theirs):
                    at.back.add(place.path)
                    at = place
                    break
            at.kinds.add("object")
            if len(value) == 1:
                at.kinds.add("alone:" + next(iter(value)))
            for k, v in value.items():
                if isinstance(v, (dict, list)) or (isinstance(v, str) and v[:1] in _OPENS):
                    stack.append((v, at.below(k), (*above, (at, keys, k))))
                elif v is not None:
                    at.below(k).kinds.add(type_of(v))
        elif isinstance(value, list):
            at.kinds.add("list")
            for v in value:
                stack.append((v, at.below(0), above))
        elif value is not None:
            at.kinds.add(type_of(value))


def nodes_of(root: Seen) -> Iterator[tuple[str, str]]:
    stack = [root]
    while stack:
        at = stack.pop()
        path = json.dumps(at.path, ensure_ascii=False)
        yield from ((path, k) for k in at.kinds)
        yield from ((path, "back:" + json.dumps(b, ensure_ascii=False)) for b in at.back)
        stack += [*at.kids.values(), *([at.item] if at.item else [])]


def schema_graph(df: DataFrame, body: str) -> DataFrame:
    """Distinct nodes (path: a JSON list of keys, 0 for list elements; kind) of the records' nesting; one set per partition before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = Seen()
        for batch in batches:
            for text in batch["body"]:
                if (value := decode(text)) is not None:
                    walk(value, root)
        yield pd.DataFrame(sorted(nodes_of(root)), columns=["path", "kind"])

    return df.select(F.col(body).alias("body")).mapInPandas(run, GRAPH).distinct()


# ---- from graph to tables -------------------------------------------------------------------------------------------


class Place:
    """An element of the schema: its kids by key, how many lists deep its values are, the keys of objects that wrap it."""

    def __init__(self) -> None:
        self.kinds: set[str] = set()
        self.kids: dict[str, Place] = {}
        self.item: Place | None = None
        self.same: Place | None = None
        self.levels = 0
        self.wraps: set[str] = set()
        self.recursive = False
        self.table: str | None = None  # where it has a table of its own (of its innermost level)
        self.column = ""  # the name of its column where it has none
        self.known: frozenset[str] = frozenset()  # keys of its objects, where some of its kids are left out
        self.steps: dict[str, str] = {}  # what a key adds to the key of a row
        self.name = ""

    def top(self) -> Place:
        at = self
        while at.same is not None:
            at = at.same
        return at


def _merge(a: Place, b: Place) -> Place:
    """`b` becomes the same place as `a`."""
    todo = [(a, b)]
    while todo:
        a, b = (x.top() for x in todo.pop())
        if a is b:
            continue
        b.same = a
        a.kinds |= b.kinds
        a.recursive |= b.recursive
        a.wraps |= b.wraps
        for k, v in b.kids.items():
            if k in a.kids:
                todo.append((a.kids[k], v))
            else:
                a.kids[k] = v
        if b.item is not None:
            if a.item is None:
                a.item = b.item
            else:
                todo.append((a.item, b.item))
    return a.top()


def _keys(p: Place) -> set[str]:
    """Keys of the objects at a place or in its lists."""
    out, at, seen = set(), p.top(), set()
    while at is not None and id(at) not in seen:
        seen.add(id(at))
        out |= set(at.kids)
        at = at.item.top() if at.item else None
    return out


@dataclass
class Element:
    """A table: the tables of its parents (several if shared or recursive) and its inlined columns with their types."""

    name: str
    parents: set[str] = field(default_factory=set)
    columns: dict[str, str] = field(default_factory=dict)
    scalar: str | None = None
    why: str = "root"


@dataclass
class Plan:
    root: Place
    root_wraps: set[str]
    tables: dict[str, Element]


def quoted(key: str) -> str:
    """A key as part of a name: quoted where it holds a dot or could be taken for another name."""
    return json.dumps(key, ensure_ascii=False) if not key or key[0] == "_" or "." in key or "$" in key or '"' in key else key


def plan_tables(graph: list[tuple[str, str]], levels: dict[str, int] | None = None) -> Plan:
    """Tables and inlined columns of a schema graph. `levels`: lists that named elements are deep at least, if the records shown are all short of some."""
    root = Place()

    def place(path: list) -> Place:
        at = root
        for s in path:
            at = at.top()
            if s == 0:
                at.item = at.item or Place()
                at = at.item
            else:
                at = at.kids.setdefault(s, Place())
        return at.top()

    graph = sorted(graph)
    for path, kind in graph:
        p = place(json.loads(path))
        if not kind.startswith("back:"):
            p.kinds.add(kind)
    for path, kind in graph:
        if kind.startswith("back:"):
            target = place(json.loads(kind[5:]))
            target.recursive = True
            _merge(target, place(json.loads(path)))
    # records inside lists, and inside an object of their own
    root_wraps: set[str] = set()
    while True:
        top = root.top()
        if top.item is not None:
            inner, top.item = top.item, None
            top.kinds.discard("list")
            _merge(top, inner)
            continue
        k = next((k for k in top.kids if f"alone:{k}" in top.kinds and top.kids[k].top() is not top and (rest := set(top.kids) - {k} - root_wraps) and len(_keys(top.kids[k]) & rest) * 2 >= len(rest)), None)
        if k is None:
            break
        root_wraps.add(k)
        _merge(top, top.kids.pop(k))
    root = root.top()
    _settle(root, levels or {})
    return Plan(root, root_wraps, _place_tables(root))


def _settle(root: Place, levels: dict[str, int]) -> None:
    """Wrappers and list levels of all places, top down; afterwards every place is its innermost element."""
    root.name = "$"
    stack, seen = [(root, ())], set()
    while stack:
        at, path = stack.pop()
        at = at.top()
        if id(at) in seen:
            continue
        seen.add(id(at))
        if at is not root:
            at.name = ".".join(map(quoted, path))
            while True:  # objects around a list
                at = at.top()
                inner = _keys(at.item) if at.item else set()
                wrap = next((k for k, v in at.kids.items() if v.top() is not at and "list" in v.top().kinds and k not in inner | _keys(v) and (set(at.kids) == {k} and not at.kinds & set(TYPES) or _keys(v) & (inner | (set(at.kids) - {k})))), None)
                if wrap is None:
                    break
                at.wraps.add(wrap)
                _merge(at, at.kids.pop(wrap))
            at = at.top()
            chain, ids = [at], {id(at)}
            while chain[-1].item is not None and id(chain[-1].item.top()) not in ids:
                chain.append(chain[-1].item.top())
                ids.add(id(chain[-1]))
            objects = [i for i, c in enumerate(chain) if "object" in c.kinds and i]
            scalars = [i for i, c in enumerate(chain) if c.kinds & set(TYPES)]
            if "list" in at.kinds or len(chain) > 1:
                at.levels = min(objects) if objects else max([1, *scalars])
            at.levels = max(at.levels, levels.get(at.name, 0))
            at.item = None
            for c in chain[1:]:
                c.item = None
                _merge(at, c)
            at = at.top()
        stack += [(v, (*path, k)) for k, v in sorted(at.kids.items(), reverse=True)]


def _place_tables(root: Place) -> dict[str, Element]:
    # shared elements: objects of one key that are built alike below several parents
    found: dict[tuple, list[Place]] = {}
    stack, seen = [root], set()
    while stack:
        at = stack.pop().top()
        if id(at) in seen:
            continue
        seen.add(id(at))
        for k, v in at.kids.items():
            v = v.top()
            if len(v.kids) > 1 and id(v) not in seen:
                found.setdefault((k, frozenset(v.kids)), []).append(v)
            stack.append(v)
    shared: set[int] = set()
    for (key, _), places in sorted(found.items(), key=lambda x: (x[0][0], sorted(x[0][1]))):
        distinct = {id(p.top()): p.top() for p in places}
        if len(distinct) > 1:
            one, *rest = distinct.values()
            most = max(p.levels for p in distinct.values())
            for r in rest:
                _merge(one, r)
            one = one.top()
            one.levels, one.name = most, quoted(key)
            shared.add(id(one))
    tables = {"$": Element("$")}
    root.table = "$"
    todo, placed = [(root, "$", "")], set()
    while todo:
        at, table, prefix = todo.pop()
        for k, v in sorted(at.kids.items()):
            v = v.top()
            at.steps[k] = f"/{quoted(k)}"
            if v.levels or v.recursive or id(v) in shared:
                why = "recursive" if v.recursive else "shared" if id(v) in shared else "repeated"
                names = [v.name + ".[]" * i for i in range(max(1, v.levels))]
                if v is root:
                    tables["$"].parents.add(table)
                    tables["$"].why = "recursive"
                    continue
                for i, n in enumerate(names):
                    tables.setdefault(n, Element(n, set(), {}, None, why)).parents.add(table if i == 0 else names[i - 1])
                v.table = names[-1]
                if v.kinds & set(TYPES):
                    tables[v.table].scalar = max(v.kinds & set(TYPES), key=TYPES.index) if len(v.kinds & set(TYPES)) == 1 or v.kinds & set(TYPES) == {"bigint", "double"} else "string"
                if id(v) not in placed:
                    placed.add(id(v))
                    todo.append((v, v.table, ""))
            else:
                kinds = v.kinds & set(TYPES)
                v.column = name = f"{prefix}{quoted(k)}" + (".$" if v.kids else "")
                if kinds:
                    tables[table].columns[name] = "double" if kinds == {"bigint", "double"} else next(iter(kinds)) if len(kinds) == 1 else "string"
                todo.append((v, table, f"{prefix}{quoted(k)}."))
    return tables


# ---- rows -----------------------------------------------------------------------------------------------------------


def text_of(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else repr(value) if isinstance(value, float) else str(value)


def records(text: str | None, plan: Plan) -> list[dict]:
    """The records in a body, without the lists and objects around them."""
    out, stack = [], [decode(text)]
    while stack:
        x = opened(stack.pop())
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            if len(x) == 1 and next(iter(x)) in plan.root_wraps:
                stack.append(next(iter(x.values())))
            else:
                out.append(x)
    return out


def elements(value, at: Place) -> list:
    """The value at a repeated place as lists nested `levels` deep."""
    value = opened(value)
    while isinstance(value, dict) and (inner := [k for k in at.wraps if k in value]) and len(inner) == 1 and not (value.keys() - {inner[0]}) & (at.known or at.kids.keys()):
        value = opened(value[inner[0]])

    def nested(v, depth: int):
        v = opened(v)
        if depth == 0:
            return v
        if v is None:
            return None
        if not isinstance(v, list):
            v = [v]
        return [nested(x, depth - 1) for x in v]

    if value is None:
        return []
    if not isinstance(value, list):
        for _ in range(at.levels):
            value = [value]
        return value
    if at.levels == 1:
        value = [opened(x) for x in value]
        if at.kids and any(isinstance(x, list) for x in value):  # one list more around the elements
            value = [y for x in value for y in (x if isinstance(x, list) else [x])]
        return value

    def depth_of(v) -> int:
        v = opened(v)
        return 1 + max((depth_of(x) for x in v), default=0) if isinstance(v, list) else 0

    for _ in range(at.levels - max(1, depth_of(value))):
        if value and all(x is None for x in value):
            break
        value = [value]
    return nested(value, at.levels)


def rows_of(record: dict, plan: Plan, wanted: set[str] | None = None, inherit: bool = False) -> list[tuple]:
    """(element, key, parent, parent key, own, scalar, columns) of each row of each (wanted) table in one record.

    With `inherit` a row also has the inlined columns of its ancestors, named element/column.
    """
    out: list[tuple] = []
    # a table's row and what lies below it: element, place, value, key, parent, parent key, positions, inherited columns
    todo = [("$", plan.root, record, "", None, None, (), {})]
    while todo:
        element, at, value, key, parent, parent_key, own, above = todo.pop()
        value = opened(value)
        columns = dict(above)
        scalar = None
        below = []
        if isinstance(value, dict):
            inline = [(at, value, key)]
            while inline:
                p, v, path = inline.pop()
                for k, kid in p.kids.items():
                    x = v.get(k)
                    if x is None:
                        continue
                    kid = kid.top()
                    if kid.table is not None:
                        below.append((kid, x, path + p.steps[k]))
                        continue
                    x = opened(x)
                    if isinstance(x, dict):
                        inline.append((kid, x, path + p.steps[k]))
                    elif x is not None:
                        columns[kid.column] = text_of(x)
        elif not isinstance(value, list):
            scalar = text_of(value)
        if wanted is None or element in wanted:
            out.append((element, key, parent, parent_key, list(own), scalar, columns))
        down = above | {f"{element}/{c}": v for c, v in columns.items() if c not in above} if inherit else above
        found = []
        for kid, x, path in below:
            if not kid.levels:
                found.append((kid.table, kid, x, path, element, key, own, down))
                continue
            first = kid.table[: len(kid.table) - len(".[]") * (kid.levels - 1)]
            layer = [(v, (*own, i), f"{path}/{i}", element, key) for i, v in enumerate(elements(x, kid))]
            for n in range(1, kid.levels):
                name, nxt = first + ".[]" * (n - 1), []
                for v, o, p, up, up_key in layer:
                    if v is None:
                        continue
                    if wanted is None or name in wanted:
                        out.append((name, p, up, up_key, list(o), None, dict(down)))
                    nxt += [(w, (*o, i), f"{p}/{i}", name, p) for i, w in enumerate(v)]
                layer = nxt
            found += [(kid.table, kid, v, p, up, up_key, o, down) for v, o, p, up, up_key in layer if v is not None]
        todo += reversed(found)
    return out


def pruned(plan: Plan, wanted: set[str] | None, inherit: bool) -> Plan:
    """The plan with only the elements that the wanted tables need."""
    if wanted is None:
        return plan
    known: dict[int, bool] = {}

    def wants(p: Place) -> bool:
        p = p.top()
        if id(p) not in known:
            known[id(p)] = True  # an element that is below itself is kept if it is wanted at all
            tables = {p.table[: len(p.table) - 3 * i] for i in range(max(1, p.levels))} if p.table else set()
            known[id(p)] = bool(tables & wanted) | any([wants(v) for v in p.kids.values()])
        return known[id(p)]

    copies: dict[int, Place] = {}

    def copy(p: Place, inline: bool) -> Place:
        p = p.top()
        if id(p) in copies:
            return copies[id(p)]
        c = copies[id(p)] = Place()
        c.kinds, c.levels, c.wraps, c.recursive, c.table, c.column, c.steps, c.name = p.kinds, p.levels, p.wraps, p.recursive, p.table, p.column, p.steps, p.name
        c.known = frozenset(p.kids)
        here = inline if p.table is None else inherit or p.table in wanted
        c.kids = {k: copy(v, here) for k, v in p.kids.items() if (here and v.top().table is None) or wants(v)}
        return c

    return Plan(copy(plan.root, False), plan.root_wraps, plan.tables)


def shred(df: DataFrame, key: str, body: str, plan: Plan, wanted: list[str] | None = None, inherit: bool = False) -> DataFrame:
    """Rows of all tables (or of `wanted`) as ROWS."""
    only = set(wanted) if wanted is not None else None
    plan = pruned(plan, only, inherit)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        cols = [c.split()[0] for c in ROWS.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=cols).astype({"record": "Int64"})
        for batch in batches:
            out = []
            for record, text in zip(batch["record"].astype("Int64"), batch["body"]):
                for root in records(text, plan):
                    out += [(record, *r) for r in rows_of(root, plan, only, inherit)]
                    if len(out) > 50_000:
                        yield frame(out)
                        out = []
            yield frame(out)

    return df.select(F.col(key).cast("bigint").alias("record"), F.col(body).alias("body")).mapInPandas(emit, ROWS)


def plan_of(df: DataFrame, body: str, levels: dict[str, int] | None = None) -> Plan:
    """The plan of all records of `df`."""
    graph = schema_graph(df, body).limit(MAX_NODES + 1).collect()  # as large as the schema, see MAX_NODES
    if len(graph) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes: keys carry data; map them to values first")
    return plan_tables([tuple(r) for r in graph], levels)


def flatten(df: DataFrame, key: str, body: str, wanted: list[str] | None = None, levels: dict[str, int] | None = None, inherit: bool = False) -> DataFrame:
    """Schema graph, tables and rows of `df` in one call."""
    return shred(df, key, body, plan_of(df, body, levels), wanted, inherit)


def relations(df: DataFrame, key: str, body: str, levels: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """One DataFrame per table: _record, _key (the primary key with _record), _parent, _parent_key (the foreign key), _own (positions), its scalar as `_value`, and its typed columns."""
    plan = plan_of(df, body, levels)
    rows = checkpointed(shred(df, key, body, plan))
    out = {}
    for name, t in plan.tables.items():
        cols = [F.try_element_at("columns", F.lit(c)).try_cast(kind).alias(c) for c, kind in sorted(t.columns.items())]
        value = [F.col("scalar").try_cast(t.scalar).alias("_value")] if t.scalar else []
        out[name] = rows.where(F.col("element") == name).select(*[F.col(c).alias(f"_{c}") for c in ("record", "key", "parent", "parent_key", "own")], *value, *cols)
    return out

"""Deeply nested semi-structured records into related flat tables, by shared inlining.

1. ``schema_graph`` analyses all records: which elements occur, under which element, how often per parent, with which
   scalar fields. It is aggregated on the executors; only element names and field names (not data) reach the driver.
2. ``plan_tables`` decides per element: repeated, shared (reached from several elements) or recursive ones get a table,
   singletons are inlined into the nearest table above them as dotted columns.
3. ``shred`` turns every record into rows of the plan's tables: the path of the element within the record, the path of the
   nearest enclosing row (the foreign key), the path of the nearest enclosing list element, and the inlined scalar fields.
   An element without a table in the plan is inlined, a list of such elements isn't stored. ``child_table`` gives one
   table with typed-as-text columns, ``list_items`` the rows of all tables that are elements of lists.

Typed columns (structs, arrays of structs) are shredded by Catalyst alone, from the schema (``shred_typed``). JSON text
is parsed once per row in Arrow batches, since its shape differs from row to row.

Defined results: a null or invalid text gives no rows; empty lists and null elements give no rows, but null elements
keep their position; JSON text inside a JSON string counts as if it stood there unquoted, if it is an object or a list
(so ``"5"`` stays a string); an object in place of a list counts as a list of one if the element is documented as a list
(``known_repeated``), else it is a row of the element's table that is no list element. NaN and
Infinity aren't JSON. Of repeated names in an object the last counts. Nesting deeper than the parser's limit counts as
invalid. Repeated records give repeated rows here; ``item_rows`` makes them distinct. A null record key is kept.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = "record_key string, relation string, item_path string, parent_path string, list_path string, is_item boolean, fields map<string,string>"
PATHS = "record_key string, item_path string, parent_path string"
MAX_ELEMENTS = 100_000  # bound on distinct (parent, element) names that reach the driver; data used as names raises


def _no_constant(_: str) -> None:
    raise ValueError("not JSON")


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def parse(text: str | None) -> object:
    """The value, with quoted JSON unquoted at the top; None if the text isn't valid JSON."""
    try:
        v = _decode(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    while isinstance(v, str):
        inner = _unquote(v)
        if inner is v:
            break
        v = inner
    return v


def _unquote(s: str) -> object:
    t = s.lstrip(" \t\r\n")
    if t[:1] in ("{", "[", '"'):
        try:
            v = _decode(s)
        except (ValueError, RecursionError):
            return s
        while isinstance(v, str):
            w = _unquote(v)
            if w is v:
                return s  # a quoted plain string stays as it was
            v = w
        return v
    return s


@dataclass
class TablePlan:
    """``known``: elements documented as lists; ``repeated``: elements that are lists of objects somewhere in the graph;
    ``own_table``: elements that get a table; ``columns``: inlined columns per table; ``parents``: tables from which an
    element is reached."""

    known: frozenset[str] = frozenset()
    repeated: set[str] = field(default_factory=set)
    own_table: set[str] = field(default_factory=set)
    columns: dict[str, set[str]] = field(default_factory=dict)
    parents: dict[str, set[str]] = field(default_factory=dict)


def _walk_graph(v: object, element: str, out: dict[tuple[str, str, str], int]) -> None:
    """Counts (parent element, element, kind); kind is list, single or field."""
    stack = [(v, element)]
    while stack:
        v, up = stack.pop()
        if isinstance(v, dict):
            for name, x in v.items():
                if isinstance(x, str):
                    x = _unquote(x)
                if isinstance(x, dict):
                    out[(up, name, "single")] = out.get((up, name, "single"), 0) + 1
                    stack.append((x, name))
                elif isinstance(x, list):
                    stack.append((x, f"{up}\x00{name}"))
                else:
                    out[(up, name, "field")] = out.get((up, name, "field"), 0) + 1
        elif isinstance(v, list):
            parent, _, name = up.rpartition("\x00")
            for x in v:
                if isinstance(x, str):
                    x = _unquote(x)
                if isinstance(x, dict):
                    out[(parent, name, "list")] = out.get((parent, name, "list"), 0) + 1
                    stack.append((x, name))
                elif isinstance(x, list):
                    stack.append((x, up))


def schema_graph(df: DataFrame, json_column: str, root: str) -> DataFrame:
    """(parent, element, kind, n) over all records, counted per batch in Python and summed by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: dict[tuple[str, str, str], int] = {}
            for t in pdf["j"]:
                v = parse(t)
                if isinstance(v, dict):
                    _walk_graph(v, root, got)
                elif isinstance(v, list):
                    _walk_graph(v, f"{root}\x00{root}", got)
            yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["parent", "element", "kind", "n"])

    return df.select(df[json_column].alias("j")).where("j is not null").mapInPandas(count, "parent string, element string, kind string, n long").groupBy("parent", "element", "kind").agg(F.sum("n").alias("n"))


def plan_tables(graph: DataFrame, root: str, known_repeated: Collection[str] = ()) -> TablePlan:
    """Shared inlining on the schema graph. ``known_repeated`` names elements documented as lists, whether or not these data show it."""
    edges = graph.limit(MAX_ELEMENTS + 1).collect()
    if len(edges) > MAX_ELEMENTS:
        raise ValueError(f"more than {MAX_ELEMENTS} element names: data seem to be used as names; shred that part as key-value lists instead")
    p = TablePlan(known=frozenset(known_repeated))
    up: dict[str, set[str]] = {}
    for e in edges:
        if e.kind != "field":
            up.setdefault(e.element, set()).add(e.parent)
            if e.kind == "list" or e.element in p.known:
                p.repeated.add(e.element)

    def recursive(x: str) -> bool:
        seen, todo = set(), [x]
        while todo:
            for y in up.get(todo.pop(), ()):
                if y == x:
                    return True
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return False

    p.own_table = {root} | p.repeated | {x for x, ys in up.items() if len(ys) > 1 or recursive(x)}

    def homes(x: str) -> set[tuple[str, str]]:
        """(table, dotted prefix) under which a singleton's fields stand."""
        if x in p.own_table:
            return {(x, "")}
        return {(t, f"{pre}{x}.") for y in up.get(x, ()) for t, pre in homes(y)}

    for e in edges:
        for t, pre in homes(e.parent):
            if e.kind == "field":
                p.columns.setdefault(t, set()).add(pre + e.element)
            elif e.element in p.own_table:
                p.parents.setdefault(e.element, set()).add(t)
    return p


def _shred(v: object, root: str, plan: TablePlan, with_fields: bool) -> list[tuple]:
    """(relation, path, path of the row above, path of the list element above, is_item, fields) of each row of one record;
    is_item: an element of a list."""
    rows: list[tuple] = []
    known, own = plan.known & plan.repeated, plan.own_table
    top: dict[str, str] = {}
    if isinstance(v, dict):
        rows.append((root, root, "", "", False, top))
    # value, name, path, nearest row above, nearest list element above, fields of that row, prefix within it
    stack = [(v, root, root, root if isinstance(v, dict) else "", "", top, "", False)]
    while stack:
        v, name, path, row, item, fields, prefix, listed = stack.pop()
        if isinstance(v, list):
            if name not in own:
                continue
            for i in range(len(v) - 1, -1, -1):
                x = v[i]
                if isinstance(x, str):
                    x = _unquote(x)
                if isinstance(x, (dict, list)):
                    stack.append((x, name, f"{path}[{i}]", row, item, fields, prefix, True))
            continue
        if listed:
            fields, prefix = {}, ""
            rows.append((name, path, row, item, True, fields))
            row = item = path
        for key, x in v.items():
            if isinstance(x, str):
                x = _unquote(x)
            if isinstance(x, dict):
                if key in known:
                    stack.append((x, key, f"{path}.{key}[0]", row, item, fields, "", True))
                elif key in own:
                    mine: dict[str, str] = {}
                    rows.append((key, f"{path}.{key}", row, item, False, mine))
                    stack.append((x, key, f"{path}.{key}", f"{path}.{key}", item, mine, "", False))
                else:
                    stack.append((x, key, f"{path}.{key}", row, item, fields, f"{prefix}{key}.", False))
            elif isinstance(x, list):
                stack.append((x, key, f"{path}.{key}", row, item, fields, prefix, False))
                if with_fields and x and not any(isinstance(y, (dict, list)) for y in x):
                    fields[prefix + key] = json.dumps(x, ensure_ascii=False)
            elif with_fields and x is not None:
                fields[prefix + key] = x if isinstance(x, str) else json.dumps(x)
    return rows


def shred(df: DataFrame, key_column: str, json_column: str, plan: TablePlan, root: str | None = None, with_fields: bool = True) -> DataFrame:
    """Rows of all tables of the plan: record_key, relation, item_path, parent_path (nearest row above; '' for the root),
    list_path (nearest list element above; '' for none), is_item, fields (empty unless ``with_fields``)."""
    root = root or json_column

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys: list[str | None] = []
            out: list[tuple] = []
            for k, t in zip(pdf["k"], pdf["j"], strict=True):
                v = parse(t)
                if isinstance(v, (dict, list)):
                    got = _shred(v, root, plan, with_fields)
                    out += got
                    keys += [k] * len(got)
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            made = {c: pd.Series(cols[i], dtype=object) for i, c in enumerate(("relation", "item_path", "parent_path", "list_path"))}
            yield pd.DataFrame({"record_key": pd.Series(keys, dtype=object), **made, "is_item": np.array(cols[4], bool), "fields": pd.Series(cols[5] if with_fields else [None] * len(keys), dtype=object)})

    return df.select(df[key_column].cast("string").alias("k"), df[json_column].alias("j")).where("j is not null").mapInPandas(run, ROWS)


def list_items(rows: DataFrame, plan: TablePlan) -> DataFrame:
    """(record_key, item_path, parent_path): the list elements in the child tables of ``shred``'s rows, linked to the list
    element they stand in."""
    tables = sorted(plan.repeated)
    return rows.where(F.col("is_item") & F.col("relation").isin(tables)).select("record_key", "item_path", F.col("list_path").alias("parent_path"))


def child_table(rows: DataFrame, relation: str, plan: TablePlan) -> DataFrame:
    """One flat table of ``shred``'s rows: keys plus a column per inlined field (dots become underscores; a name that is
    taken gets a number)."""
    taken = {"record_key", "item_path", "parent_path"}
    cols = []
    for c in sorted(plan.columns.get(relation, ())):
        name = base = c.replace(".", "_").lower()
        n = 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        cols.append(F.col("fields")[c].alias(name))
    return rows.where(F.col("relation") == relation).select("record_key", "item_path", "parent_path", *cols)


def shred_typed(df: DataFrame, key_column: str, column: str) -> DataFrame:
    """List elements of a typed column (arrays of structs at any depth) as (record_key, item_path, parent_path).

    The lists are found in the schema, so this is one projection with generators and stays in the JVM."""
    key = df[key_column].cast("string").alias("record_key")
    out: list[DataFrame] = []

    def lists(base: DataFrame, kind: T.DataType, value: str, path: str, parent: str) -> None:
        """base has record_key and columns value, path, parent."""
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                if isinstance(f.dataType, (T.StructType, T.ArrayType)):
                    lists(base.select("record_key", F.col(value)[f.name].alias("v"), F.concat(path, F.lit(f".{f.name}")).alias("p"), F.col(parent).alias("u")), f.dataType, "v", "p", "u")
        elif isinstance(kind, T.ArrayType):
            each = base.select("record_key", F.posexplode(value).alias("i", "v"), path, parent).where("v is not null")
            each = each.select("record_key", "v", F.concat(path, F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("p"), F.col(parent).alias("u"))
            if isinstance(kind.elementType, T.StructType):
                out.append(each.select("record_key", F.col("p").alias("item_path"), F.col("u").alias("parent_path")))
                lists(each.select("record_key", "v", "p", F.col("p").alias("u")), kind.elementType, "v", "p", "u")
            elif isinstance(kind.elementType, T.ArrayType):
                lists(each, kind.elementType, "v", "p", "u")

    lists(df.select(key, df[column].alias("v"), F.lit(column).alias("p"), F.lit("").alias("u")), df.schema[column].dataType, "v", "p", "u")
    empty = df.sparkSession.createDataFrame([], PATHS)
    for x in out:
        empty = empty.unionByName(x)
    return empty

"""Observed structure of a collection: types, presence and coverage of every path, in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


from ..catalog import Field, FieldCatalog
from ..errors import InvalidOption
from ..plans.compiler import column
from ..types import NULLS, is_cell, kind

#: The order in which a node lists its types.
ORDER = ("object", "array", "string", "number", "bigint", "boolean", "date", "binary", "null")


@dataclass(frozen=True)
class Node:
    name: str
    path: str
    depth: int
    types: tuple[tuple[str, int], ...]
    present: int
    coverage: float
    optional: bool
    coverage_within_parent: float
    optional_within_parent: bool
    indexed: bool
    children: tuple["Node", ...] = ()


@dataclass(frozen=True)
class Structure:
    collection: str
    path: str | None
    documents: int
    fields: int
    max_depth: int
    root: Node


def _counts(df: DataFrame, fields: list[Field]) -> Row:
    stated = NULLS in df.columns
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = column(f.path)
        if is_cell(f.type):
            for k in ORDER[:-1]:
                aggs.append(F.count_if(c["__kind"] == k).alias(f"{i}:{k}"))
        else:
            aggs.append(F.count(c).alias(f"{i}:{kind(f.type)}"))
        if stated:
            aggs.append(F.count_if(F.array_contains(F.coalesce(NULLS, F.array().cast("array<string>")), f.dotted)).alias(f"{i}:null"))
        else:  # a declared table has no missing fields: what is null was given so, where its parent is there
            parent = column(f.path[:-1]).isNotNull() if len(f.path) > 1 else F.lit(True)
            aggs.append(F.count_if(c.isNull() & parent).alias(f"{i}:null"))
    return df.agg(*aggs).first()


def structure(df: DataFrame, collection: str, path: str | None = None, indexed: frozenset[str] = frozenset()) -> Structure:
    catalog = FieldCatalog(df.schema)
    fields = catalog.fields
    row = _counts(df, fields).asDict()
    n = row["n"]
    types = {f.path: {k: row.get(f"{i}:{k}", 0) for k in ORDER if row.get(f"{i}:{k}", 0)} for i, f in enumerate(fields)}

    def node(f: Field) -> Node:
        t = types[f.path]
        present = sum(t.values())
        within = n if len(f.path) == 1 else types[f.path[:-1]].get("object", 0)
        ratio = lambda a, b: a / b if b else 0.0
        below = tuple(node(x) for x in fields if len(x.path) == len(f.path) + 1 and x.path[:-1] == f.path)
        return Node(f.name, f.dotted, len(f.path), tuple(t.items()), present, ratio(present, n), present < n, ratio(present, within), present < within, f.dotted in indexed, below)

    def count(x: Node) -> int:
        return 1 + sum(count(c) for c in x.children)

    def deepest(x: Node) -> int:
        return max([x.depth, *(deepest(c) for c in x.children)])

    if path is not None:
        found = catalog.resolve(path)
        if not found or found[0].dotted != path:
            raise InvalidOption(f"no field {path!r}")
        root = node(found[0])
        return Structure(collection, path, n, count(root), deepest(root), root)
    tops = tuple(node(f) for f in fields if len(f.path) == 1)
    root = Node(collection, "", 0, (("object", n),) if n else (), n, 1.0 if n else 0.0, False, 1.0 if n else 0.0, False, False, tops)
    return Structure(collection, None, n, count(root) - 1, deepest(root), root)


def structure_table(df: DataFrame) -> DataFrame:
    """(path, type, n) for every observed type: the same single aggregation, kept as a DataFrame."""
    fields = [f for f in FieldCatalog(df.schema).fields]
    pairs = []
    for f in fields:
        c = column(f.path)
        pairs.append((f.dotted, kind(f.type), F.count(c)))
        parent = column(f.path[:-1]).isNotNull() if len(f.path) > 1 else F.lit(True)
        pairs.append((f.dotted, "null", F.count_if(c.isNull() & parent)))
    one = df.agg(*[a.alias(f"c{i}") for i, (_, _, a) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("type"), F.col(f"c{i}").alias("n")) for i, (p, k, _) in enumerate(pairs)])
    return one.select(F.explode(items).alias("x")).select("x.*").where("n > 0")



"""Mutations as one projection over a collection: types evolve, paths are set or removed under a mask."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedSyntax
from ..types import ARRAY, ID, NULLS, dump, infer, is_array, is_cell, is_object, kind, merge, millis, settle

DELETE = object()
Edit = tuple[Column, T.DataType]


def constant(value: Any) -> Edit:
    """A Python value as a Column of its own type."""
    t = infer(value)
    if value is None:
        return F.lit(None), T.NullType()
    if is_array(t):
        return F.struct(F.lit(dump(value)).alias("__arr")), ARRAY
    if is_object(t):
        parts = [(k, constant(v)) for k, v in value.items()]
        t = settle(T.StructType([T.StructField(k, x[1]) for k, x in parts]))
        if not parts:
            return F.struct(F.lit(None).cast("boolean").alias("__empty")), t
        return F.struct(*[convert(x[0], x[1], t[k].dataType).alias(k) for k, x in parts]), t
    if isinstance(t, T.DecimalType):
        return F.lit(str(int(value))).cast(t), t
    if isinstance(t, T.TimestampType):
        return F.timestamp_millis(F.lit(millis(value))), t
    return F.lit(bytes(value) if isinstance(t, T.BinaryType) else int(value) if isinstance(t, T.LongType) else value).cast(t), t


def convert(c: Column, a: T.DataType, b: T.DataType) -> Column:
    """A Column of type ``a`` as type ``b``, which holds it."""
    if a == b:
        return c
    if isinstance(a, T.NullType):
        return F.lit(None).cast(b)
    if is_object(a) and is_object(b):
        kids = [convert(c[f.name], a[f.name].dataType, f.dataType) if f.name in a.fieldNames() else F.lit(None).cast(f.dataType) for f in b]
        return F.when(c.isNotNull(), F.struct(*[k.alias(f.name) for k, f in zip(kids, b, strict=True)]))
    if is_cell(b):
        return to_cell(c, a)
    return c.cast(b)


def to_cell(c: Column, a: T.DataType) -> Column:
    k = kind(a)
    none = lambda t: F.lit(None).cast(t)
    rank = {"number": 1, "boolean": 1, "date": 1, "string": 2, "bigint": 2}.get(k, 3)
    n = F.unix_millis(c.cast("timestamp")).cast("double") if k == "date" else c.cast("double") if rank == 1 else none("double")
    s = c.cast("string") if rank == 2 else c["__arr"] if k == "array" and isinstance(a, T.StructType) else F.to_json(c) if k in ("array", "object") else none("string")
    b = c if k == "binary" else none("binary")
    return F.when(c.isNotNull(), F.struct(F.lit(rank).alias("__rank"), F.lit(k).alias("__kind"), n.alias("__n"), s.alias("__s"), b.alias("__b")))


def leaves(value: dict, at: tuple[str, ...] = ()) -> dict[tuple[str, ...], Any]:
    """Paths that a payload sets; nested objects are merged, all else replaces."""
    out: dict[tuple[str, ...], Any] = {}
    for k, v in value.items():
        if isinstance(v, dict) and v:
            out |= leaves(v, (*at, k))
        else:
            out[(*at, k)] = v
    return out


def widen(schema: T.StructType, edits: dict[tuple[str, ...], Any]) -> T.StructType:
    """``schema`` with room for the edits."""
    for path, e in edits.items():
        if e is DELETE:
            continue
        t: T.DataType = e[1]
        for name in reversed(path):
            t = T.StructType([T.StructField(name, t)])
        schema = merge(schema, t)
    return settle(schema)


def reshape(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``."""
    cols = [convert(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in schema]
    return df.select(*[c.alias(f.name) for c, f in zip(cols, schema, strict=True)])


def rewrite(df: DataFrame, mask: Column, edits: dict[tuple[str, ...], Any]) -> DataFrame:
    """Apply ``edits`` (path to (Column, type) or DELETE) where ``mask`` holds; all right sides see the old row."""
    schema = widen(df.schema, edits)

    def build(old: Column | None, a: T.DataType | None, b: T.DataType, at: tuple[str, ...]) -> Column:
        kept = convert(old, a, b) if old is not None else F.lit(None).cast(b)
        if at in edits:
            e = edits[at]
            return F.when(mask, F.lit(None).cast(b) if e is DELETE else convert(e[0], e[1], b)).otherwise(kept)
        below = [p for p in edits if p[: len(at)] == at]
        if not below:
            return kept
        if not is_object(b):
            if is_cell(b) and any(edits[p] is not DELETE for p in below):
                raise UnsupportedSyntax(f"{'.'.join(at)} holds values of several types; set it as a whole")
            return kept
        inside = a if a is not None and is_object(a) else None
        kids = [build(old[f.name] if inside is not None and f.name in inside.fieldNames() else None, inside[f.name].dataType if inside is not None and f.name in inside.fieldNames() else None, f.dataType, (*at, f.name)).alias(f.name) for f in b]
        made = mask if any(edits[p] is not DELETE for p in below) else F.lit(False)
        there = made | old.isNotNull() if old is not None else made
        return F.when(there, F.struct(*kids))

    cols = []
    for f in schema:
        has = f.name in df.columns
        if f.name in (ID, NULLS):
            cols.append(F.col(f.name))
            continue
        cols.append(build(F.col(f"`{f.name}`") if has else None, df.schema[f.name].dataType if has else None, f.dataType, (f.name,)).alias(f.name))
    if NULLS in df.columns:
        cols = [_nulls(mask, edits).alias(NULLS) if f.name == NULLS else c for f, c in zip(schema, cols, strict=True)]
    return df.select(*cols)


def _nulls(mask: Column, edits: dict[tuple[str, ...], Any]) -> Column:
    now = F.coalesce(F.col(NULLS), F.array().cast("array<string>"))
    dotted = [".".join(p) for p in edits]

    def stays(x: Column) -> Column:
        gone = F.lit(False)
        for d in dotted:
            parts = d.split(".")
            above = [".".join(parts[:i]) for i in range(1, len(parts))]
            gone = gone | (x == d) | F.startswith(x, F.lit(d + ".")) | (x.isin(above) if above else F.lit(False))
        return ~gone

    new = F.filter(now, stays)
    for p, e in edits.items():
        if e is not DELETE:
            d = F.array(F.lit(".".join(p)))
            new = F.concat(new, d if isinstance(e[1], T.NullType) else F.when(e[0].isNull(), d).otherwise(F.array().cast("array<string>")))
    return F.when(mask, new).otherwise(F.col(NULLS))



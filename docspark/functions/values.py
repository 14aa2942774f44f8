"""Columns with a storage class, and the arithmetic and comparison rules between classes.

Classes: int, real, bool (a condition), text, blob, null, array, object, cell. Numbers sort before
text and text before blobs; across classes nothing is equal. Booleans and dates count as numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOption, UnsupportedSyntax
from ..types import BigInt, is_object, kind, millis

NUMERIC = {"int", "real", "bool"}
RANK = {"int": 1, "real": 1, "bool": 1, "text": 2, "blob": 3, "array": 3, "object": 3}


@dataclass(frozen=True)
class Value:
    col: Column
    cls: str
    literal: Any = None
    typed: Value | None = None  # what it is where it is compared or reckoned with, if not what it shows
    costly: bool = False  # a cell that is worked out anew wherever its Column stands


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)``, with ``c`` worked out a single time however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def _each(v: Value, f: Callable[[Column], Column]) -> Column:
    return once(v.col, f) if v.costly else f(v.col)


def null() -> Value:
    return Value(F.lit(None), "null")


def literal(x: Any) -> Value:
    """A bound parameter or a constant."""
    from datetime import datetime

    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(int(x)).cast("long"), "int", int(x))
    if isinstance(x, BigInt):
        return Value(F.lit(str(int(x))), "text", str(int(x)))
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), "int", x) if -(2**63) <= x < 2**63 else Value(F.lit(str(x)), "text", str(x))
    if isinstance(x, float):
        if x != x or x in (float("inf"), float("-inf")):
            raise InvalidOption("parameters are finite numbers")
        return Value(F.lit(int(x)).cast("long"), "int", int(x)) if x.is_integer() and abs(x) < 2**53 else Value(F.lit(x), "real", x)
    if isinstance(x, str):
        return Value(F.lit(x), "text", x)
    if isinstance(x, (bytes, bytearray)):
        return Value(F.lit(bytes(x)), "blob", bytes(x))
    if isinstance(x, datetime):
        return Value(F.lit(millis(x)).cast("long"), "int", millis(x))
    raise InvalidOption(f"a parameter of {type(x).__name__} cannot be bound")


def field(col: Column, t: T.DataType) -> Value:
    """A stored field as expressions see it."""
    k = kind(t)
    if k == "boolean":
        return Value(col.cast("long"), "int")
    if k == "number":
        return Value(col.cast("long"), "int") if isinstance(t, T.IntegralType) else Value(col.cast("double"), "real")
    if k == "bigint":
        return Value(col.cast("string"), "text")
    if k == "date":
        return Value(F.unix_millis(col.cast("timestamp")), "int")
    return Value(col, {"string": "text", "binary": "blob", "null": "null"}.get(k, "object" if is_object(t) else k))


def cell_of(v: Value) -> Column:
    """A value as a struct that sorts as storage classes do; null stays null."""
    if v.cls == "cell":
        return _each(v, lambda c: F.when(c.isNotNull(), F.struct(c["__rank"].alias("r"), c["__n"].alias("n"), c["__s"].alias("s"), c["__b"].alias("b"))))
    c, r = v.col, RANK.get(v.cls, 1)
    none = lambda t: F.lit(None).cast(t)
    n = c.cast("double") if v.cls in NUMERIC else none("double")
    s = c if v.cls == "text" else c["__arr"] if v.cls == "array" else none("string")
    b = c if v.cls == "blob" else none("binary")
    if v.cls == "null":
        return F.lit(None).cast("struct<r:int,n:double,s:string,b:binary>")
    return F.when(c.isNotNull(), F.struct(F.lit(r).alias("r"), n.alias("n"), s.alias("s"), b.alias("b")))


def number(v: Value) -> Value:
    """Text counts by its numeric beginning, and other classes as 0."""
    v = v.typed or v
    if v.cls in ("int", "real"):
        return v
    if v.cls == "bool":
        return Value(v.col.cast("long"), "int")
    if v.cls == "null":
        return Value(F.lit(None).cast("long"), "int")
    if v.cls == "text":
        head = F.regexp_extract(v.col, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
        if isinstance(v.literal, str):
            m = re.match(r"\s*([+-]?\d+)(?![\d.eE])", v.literal)
            if m:
                return literal(int(m[1]))
        return Value(F.when(v.col.isNotNull(), F.coalesce(head.try_cast("double"), F.lit(0.0))), "real")
    if v.cls == "cell":
        return Value(_each(v, lambda c: F.when(c.isNotNull(), F.coalesce(c["__n"], F.regexp_extract(c["__s"], r"^\s*([+-]?\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0)))), "real")
    return Value(F.when(v.col.isNotNull(), F.lit(0)).cast("long"), "int")


def condition(v: Value) -> Column:
    """The truth of a value: numbers other than 0 are true."""
    if v.cls == "bool":
        return v.col
    if v.cls == "null":
        return F.lit(None).cast("boolean")
    return number(v).col != 0


def output(v: Value) -> Column:
    """A value as a result shows it."""
    if v.cls == "bool":
        return v.col.cast("long")
    if v.cls == "null":
        return v.col.cast("string")
    return v.col


def text(v: Value) -> Column:
    if v.cls == "bool":
        return v.col.cast("long").cast("string")
    if v.cls == "cell":
        return F.coalesce(v.col["__s"], v.col["__n"].cast("string"))
    if v.cls == "array":
        return v.col["__arr"]
    return v.col.cast("string")


def compare(op: str, a: Value, b: Value) -> Value:
    a, b = a.typed or a, b.typed or b
    if "null" in (a.cls, b.cls):
        return Value(F.lit(None).cast("boolean"), "bool")
    if "object" in (a.cls, b.cls):
        raise UnsupportedSyntax("objects cannot be compared")
    if "cell" in (a.cls, b.cls) or "array" in (a.cls, b.cls):
        # Null where either is, as cells themselves are.
        return Value(_apply(op, cell_of(a), cell_of(b)), "bool")
    if RANK[a.cls] != RANK[b.cls]:
        known = {"=": False, "!=": True, "<": RANK[a.cls] < RANK[b.cls], "<=": RANK[a.cls] < RANK[b.cls], ">": RANK[a.cls] > RANK[b.cls], ">=": RANK[a.cls] > RANK[b.cls]}[op]
        return Value(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(known)), "bool")
    return Value(_apply(op, output(a), output(b)), "bool")


def _apply(op: str, x: Column, y: Column) -> Column:
    return {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()


def same(a: Value, b: Value) -> Column:
    """IS: equality that knows nulls."""
    if a.cls == "null" or b.cls == "null":
        return output(a).isNull() & output(b).isNull()
    eq = compare("=", a, b).col
    return F.coalesce(eq, F.lit(False)) | (a.col.isNull() & b.col.isNull())


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Whole numbers stay whole (a division truncates, an overflow is null); dividing by 0 is null."""
    x, y = number(a), number(b)
    whole = x.cls == y.cls == "int"
    if op == "%":
        return Value(F.try_mod(x.col.cast("long"), y.col.cast("long")), "int") if whole else Value(F.try_mod(x.col.cast("long"), y.col.cast("long")).cast("double"), "real")
    if op == "/":
        return Value(F.when(y.col != 0, F.call_function("div", x.col, F.when(y.col != 0, y.col))), "int") if whole else Value(F.try_divide(x.col.cast("double"), y.col.cast("double")), "real")
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    return Value(f(x.col, y.col), "int") if whole else Value(f(x.col.cast("double"), y.col.cast("double")), "real")


def bitwise(op: str, a: Value, b: Value) -> Value:
    x, y = number(a).col.cast("long"), number(b).col.cast("long")
    if op == "&":
        return Value(x.bitwiseAND(y), "int")
    if op == "|":
        return Value(x.bitwiseOR(y), "int")
    left, right = F.call_function("shiftleft", x, y.cast("int")), F.call_function("shiftright", x, y.cast("int"))
    return Value(left if op == "<<" else right, "int")


def glob_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "^" else body) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def match(op: str, a: Value, pattern: Value, escape: Value | None) -> Value:
    """LIKE (case folded), GLOB and REGEXP."""
    if "null" in (a.cls, pattern.cls):
        return Value(F.lit(None).cast("boolean"), "bool")
    if op == "like":
        mark = escape.literal if escape is not None else "\x01"
        if not isinstance(mark, str) or len(mark) != 1:
            raise UnsupportedSyntax("ESCAPE takes one character")
        return Value(F.ilike(text(a), text(pattern), F.lit(mark)), "bool")
    if op == "match":
        raise UnsupportedSyntax("MATCH has no function behind it")
    if not isinstance(pattern.literal, str):
        raise UnsupportedSyntax(f"{op.upper()} takes a constant or bound pattern")
    return Value(text(a).rlike(glob_regex(pattern.literal) if op == "glob" else pattern.literal), "bool")


def common(values: list[Value]) -> tuple[list[Column], str]:
    """Columns of one type for a choice between values (CASE, COALESCE), and their class."""
    classes = {v.cls for v in values if v.cls != "null"}
    if not classes:
        return [v.col.cast("string") for v in values], "null"
    if classes <= {"int", "bool"}:
        return [output(v).cast("long") for v in values], "int"
    if classes <= NUMERIC:
        return [output(v).cast("double") for v in values], "real"
    if len(classes) == 1:
        c = classes.pop()
        return [v.col if v.cls != "null" else F.lit(None) for v in values], c
    return [mixed(v) for v in values], "cell"


def mixed(v: Value) -> Column:
    """A value as a typed cell."""
    if v.cls == "cell":
        return v.col
    kinds = {"int": "number", "real": "number", "bool": "number", "text": "string", "blob": "binary", "array": "array"}
    if v.cls == "null":
        return F.lit(None)
    c = cell_of(v)
    return F.when(c.isNotNull(), F.struct(c["r"].alias("__rank"), F.lit(kinds[v.cls]).alias("__kind"), c["n"].alias("__n"), c["s"].alias("__s"), c["b"].alias("__b")))

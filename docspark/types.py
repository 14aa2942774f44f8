"""The document model: Python values, their Spark types, and the way between them.

An object is a struct, a homogeneous path has one Spark type. An array is atomic and stored as a
struct around tagged JSON. A path that holds values of several types is a typed cell. A null that
was given, as against a field that is missing, is listed in the row's ``__nulls``.
"""

from __future__ import annotations

import base64
import json
import math
from datetime import datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from .errors import InvalidDocument

ID, NULLS, ROOT = "object_id", "__nulls", "__root"
MAX_DEPTH = 128
UNSAFE = {"__proto__", "prototype", "constructor"}

ARRAY = T.StructType([T.StructField("__arr", T.StringType())])
#: rank: 1 number, 2 text, 3 blob and structured; kind: the logical type.
CELL = T.StructType(
    [
        T.StructField("__rank", T.IntegerType()),
        T.StructField("__kind", T.StringType()),
        T.StructField("__n", T.DoubleType()),
        T.StructField("__s", T.StringType()),
        T.StructField("__b", T.BinaryType()),
    ]
)
BIGINT = T.DecimalType(38, 0)


class BigInt(int):
    """An integer stored as a big integer: it compares as its decimal text."""


class Record(dict):
    """A dictionary decoded from a heterogeneous path."""


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) or isinstance(t, T.StructType) and t.fieldNames() == ["__arr"]


def is_cell(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames()[:1] == ["__rank"]


def is_object(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and not is_array(t) and not is_cell(t)


def kind(t: T.DataType) -> str:
    """Logical type of a Spark type: string, number, bigint, boolean, date, binary, array, object, cell or null."""
    if is_array(t):
        return "array"
    if is_cell(t):
        return "cell"
    if isinstance(t, T.StructType):
        return "object"
    if isinstance(t, T.DecimalType):
        return "bigint" if t.scale == 0 else "number"
    for cls, name in ((T.BooleanType, "boolean"), (T.NumericType, "number"), (T.StringType, "string"), (T.BinaryType, "binary"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "date")):
        if isinstance(t, cls):
            return name
    return "null" if isinstance(t, T.NullType) else "array"


def check(value: Any, depth: int = 0, above: tuple[int, ...] = ()) -> None:
    """Raise for anything that cannot be stored: before any write."""
    if depth > MAX_DEPTH:
        raise InvalidDocument(f"documents nest at most {MAX_DEPTH} levels")
    if isinstance(value, (dict, list, tuple)):
        if id(value) in above:
            raise InvalidDocument("circular reference")
        above = (*above, id(value))
        if isinstance(value, dict):
            for k, v in value.items():
                if not isinstance(k, str):
                    raise InvalidDocument("field names are strings")
                if k in UNSAFE or "." in k or "\0" in k or not k:
                    raise InvalidDocument(f"field name {k!r} is not allowed")
                check(v, depth + 1, above)
        else:
            for v in value:
                check(v, depth + 1, above)
    elif isinstance(value, float) and not math.isfinite(value):
        raise InvalidDocument("numbers are finite")
    elif value is not None and not isinstance(value, (bool, int, float, str, bytes, bytearray, datetime, Decimal)):
        raise InvalidDocument(f"values of {type(value).__name__} cannot be stored")


def infer(value: Any) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, BigInt) or isinstance(value, int) and not -(2**63) <= value < 2**63:
        return BIGINT
    if isinstance(value, int) or isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return T.LongType()
    if isinstance(value, (float, Decimal)):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(value, datetime):
        return T.TimestampType()
    if isinstance(value, (list, tuple)):
        return ARRAY
    return T.StructType([T.StructField(k, infer(v)) for k, v in value.items()])


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a path that holds values of both."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if is_object(a) and is_object(b):
        names = [*a.fieldNames(), *(n for n in b.fieldNames() if n not in a.fieldNames())]
        pick = lambda t, n: t[n].dataType if n in t.fieldNames() else T.NullType()
        return T.StructType([T.StructField(n, merge(pick(a, n), pick(b, n))) for n in names])
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return CELL


def settle(t: T.DataType) -> T.DataType:
    """Paths of which only nulls are known become strings; an object without fields keeps a hidden one."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if is_object(t):
        return T.StructType([T.StructField(f.name, settle(f.dataType)) for f in t] or [T.StructField("__empty", T.BooleanType())])
    return t


def tag(value: Any) -> Any:
    """JSON for a value inside an array or a cell."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, BigInt) or isinstance(value, int) and abs(value) >= 2**53:
        return {"$bigint": str(int(value))}
    if isinstance(value, (int, float)):
        return int(value) if isinstance(value, float) and value.is_integer() else value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, datetime):
        return {"$date": millis(value)}
    if isinstance(value, (bytes, bytearray)):
        return {"$binary": base64.b64encode(value).decode()}
    if isinstance(value, (list, tuple)):
        return [tag(v) for v in value]
    plain = {k: tag(v) for k, v in value.items()}
    return {"$record": plain} if any(k.startswith("$") for k in plain) else plain


def untag(value: Any) -> Any:
    if isinstance(value, list):
        return [untag(v) for v in value]
    if isinstance(value, dict):
        if len(value) == 1:
            (k, v), = value.items()
            if k == "$bigint":
                return BigInt(v)
            if k == "$date":
                return from_millis(v)
            if k == "$binary":
                return base64.b64decode(v)
            if k == "$record":
                return {n: untag(x) for n, x in v.items()}
        return {k: untag(v) for k, v in value.items()}
    return value


def millis(value: datetime) -> int:
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return round((value - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000)


def from_millis(ms: float) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def dump(value: Any) -> str:
    return json.dumps(tag(value), ensure_ascii=False, separators=(",", ":"), sort_keys=False)


def cell(value: Any) -> tuple | None:
    if value is None:
        return None
    k = kind(infer(value))
    if isinstance(value, bool):
        return (1, k, float(value), None, None)
    if k == "number":
        return (1, k, float(value), None, None)
    if k == "date":
        return (1, k, float(millis(value)), None, None)
    if k in ("string", "bigint"):
        return (2, k, None, str(value), None)
    if k == "binary":
        return (3, k, None, None, bytes(value))
    return (3, k, None, dump(value), None)


def uncell(rank: int, k: str, n: float | None, s: str | None, b: bytes | None) -> Any:
    if k == "boolean":
        return bool(n)
    if k == "number":
        return int(n) if n == int(n) else n
    if k == "date":
        return from_millis(n)
    if k == "bigint":
        return BigInt(s)
    if k in ("array", "object"):
        return untag(json.loads(s))
    return bytes(b) if k == "binary" else s


def encode(value: Any, t: T.DataType) -> Any:
    """A Python value as Spark wants it for type ``t``."""
    if value is None:
        return None
    if is_cell(t):
        return cell(value)
    if is_array(t):
        return (dump(value),) if isinstance(t, T.StructType) else value
    if isinstance(t, T.StructType):
        return tuple(encode(value.get(f.name), f.dataType) for f in t)
    if isinstance(t, T.DoubleType):
        return float(value)
    if isinstance(t, T.LongType):
        return int(value)
    if isinstance(t, T.DecimalType):
        return Decimal(int(value))
    if isinstance(t, T.TimestampType) and value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return bytes(value) if isinstance(t, T.BinaryType) else value


def nulls(value: Any, path: str = "") -> list[str]:
    """Paths of the nulls that a document states."""
    if value is None:
        return [path]
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in nulls(v, f"{path}.{k}" if path else k)]
    return []


def decode(value: Any, t: T.DataType, given: frozenset[str] | None = None, path: str = "") -> Any:
    """The Python value of a Spark value. ``given``: the nulls that were stated; None keeps all nulls."""
    if value is None:
        return None
    if is_cell(t):
        return uncell(*value)
    if is_array(t):
        return untag(json.loads(value[0])) if isinstance(t, T.StructType) else plain(value)
    if isinstance(t, T.StructType):
        out = {}
        for f, v in zip(t, value, strict=True):
            at = f"{path}.{f.name}" if path else f.name
            if f.name != "__empty" and (v is not None or given is None or at in given):
                out[f.name] = decode(v, f.dataType, given, at)
        return out
    if isinstance(t, T.DecimalType):
        return BigInt(value) if t.scale == 0 else float(value)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return value.astimezone(timezone.utc) if value.tzinfo else value.replace(tzinfo=timezone.utc)
    return bytes(value) if isinstance(t, T.BinaryType) else value


def plain(value: Any) -> Any:
    if isinstance(value, T.Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list) else value

"""The functions of the dialect by name. Names that are not here are errors; text never reaches a parser of Spark's."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SyntaxProblem, UnknownFunction
from .values import RANK, Value, bitwise, cell_of, common, compare, literal, match, null, number, once, output, text  # noqa: F401

Fn = Callable[[list[Value]], Value]
SCALARS: dict[str, Fn] = {}
AGGREGATES = {"count", "sum", "total", "avg", "min", "max", "group_concat"}


def define(*names: str, least: int = 1, most: int | None = None):
    def add(f: Fn) -> Fn:
        def checked(args: list[Value]) -> Value:
            if len(args) < least or len(args) > (least if most is None else most):
                raise SyntaxProblem(f"{names[0]} takes {least if most is None else f'{least} to {most}'} arguments")
            return f(args)

        for n in names:
            SCALARS[n] = checked
        return f

    return add


def call(name: str, args: list[Value]) -> Value:
    if name not in SCALARS:
        raise UnknownFunction(f"no such function: {name}")
    return SCALARS[name](args)


def _strings(name: str, f: Callable[..., Column], least: int, most: int | None = None) -> None:
    define(name, least=least, most=most)(lambda a: Value(f(*[text(x) for x in a]), "text"))


# Case is that of the letters A to Z alone.
_strings("lower", lambda x: F.translate(x, ascii_uppercase, ascii_lowercase), 1)
_strings("upper", lambda x: F.translate(x, ascii_lowercase, ascii_uppercase), 1)
_strings("trim", lambda x, c=None: F.trim(x) if c is None else F.trim(x, c), 1, 2)
_strings("ltrim", lambda x, c=None: F.ltrim(x) if c is None else F.ltrim(x, c), 1, 2)
_strings("rtrim", lambda x, c=None: F.rtrim(x) if c is None else F.rtrim(x, c), 1, 2)
_strings("replace", lambda x, a, b: F.when(F.length(a) == 0, x).otherwise(F.replace(x, a, b)), 3)


@define("length")
def _length(a):
    return Value((F.octet_length(a[0].col) if a[0].cls == "blob" else F.length(text(a[0]))).cast("long"), "int")


@define("substr", "substring", least=2, most=3)
def _substr(a):
    x, start = text(a[0]), number(a[1]).col.cast("int")
    n = number(a[2]).col.cast("int") if len(a) > 2 else F.lit(2**31 - 1)
    size = F.length(x)
    # Position 0 stands before the first character; a start before the text uses up length.
    begin = F.when(start < 0, size + start + 1).otherwise(start)
    end = F.when(n < 0, begin).when(begin.cast("long") + n > size + 1, size + 1).otherwise(begin + n)
    first = F.greatest(F.when(n < 0, begin + n).otherwise(begin), F.lit(1))
    return Value(F.when(end > first, F.substring(x, first, (end - first).cast("int"))).when(x.isNotNull() & start.isNotNull() & n.isNotNull(), F.lit("")), "text")


@define("instr", least=2)
def _instr(a):
    return Value(F.call_function("instr", text(a[0]), text(a[1])).cast("long"), "int")


define("hex")(lambda a: Value(F.hex(a[0].col if a[0].cls == "blob" else F.encode(text(a[0]), "utf-8")), "text"))
define("unhex")(lambda a: Value(F.unhex(text(a[0])), "blob"))
define("unicode")(lambda a: Value(F.ascii(text(a[0])).cast("long"), "int"))
define("char", least=0, most=64)(lambda a: Value(F.concat(*[F.decode(F.unhex(F.lpad(F.hex(number(x).col.cast("long")), 8, "0")), "UTF-32") for x in a]) if a else F.lit(""), "text"))
define("concat", least=1, most=64)(lambda a: Value(F.concat(*[F.coalesce(text(x), F.lit("")) for x in a]), "text"))
define("concat_ws", least=2, most=64)(lambda a: Value(F.call_function("concat_ws", *[text(x) for x in a]), "text"))
define("like", least=2, most=3)(lambda a: match("like", a[1], a[0], a[2] if len(a) > 2 else None))
define("glob", least=2)(lambda a: match("glob", a[1], a[0], None))


@define("quote")
def _quote(a):
    if a[0].cls in ("int", "real", "bool"):
        return Value(F.coalesce(text(a[0]), F.lit("NULL")), "text")
    if a[0].cls == "blob":
        return Value(F.coalesce(F.concat(F.lit("X'"), F.hex(a[0].col), F.lit("'")), F.lit("NULL")), "text")
    return Value(F.coalesce(F.concat(F.lit("'"), F.replace(text(a[0]), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")), "text")


@define("printf", "format", least=1, most=32)
def _printf(a):
    if not isinstance(a[0].literal, str):
        raise SyntaxProblem("printf takes a constant format")
    form, args, given = [], [], iter(a[1:])
    for plain, spec in re.findall(r"([^%]+)|(%[-+ 0,#]*\d*(?:\.\d+)?(?:ll|l)?[A-Za-z%]|%)", a[0].literal):
        if plain or spec == "%%":
            form.append(plain or spec)
            continue
        kind = spec[-1]
        if kind not in "disfgeExXoc":
            raise SyntaxProblem(f"printf does not know {spec}")
        # Each argument becomes what its place asks for; a missing one is 0 or empty.
        x = next(given, null())
        if kind in "di":
            args.append(F.coalesce(number(x).col.cast("long"), F.lit(0).cast("long")))
        elif kind in "xXo":
            args.append(F.coalesce(number(x).col.cast("long"), F.lit(0).cast("long")))
        elif kind in "fgeE":
            args.append(F.coalesce(number(x).col.cast("double"), F.lit(0.0)))
        else:
            args.append(F.coalesce(text(x) if kind == "s" else F.substring(text(x), 1, 1), F.lit("")))
        form.append(re.sub("l+", "", spec[:-1]) + {"i": "d", "c": "s"}.get(kind, kind))
    return Value(F.format_string("".join(form), *args) if args else F.lit("".join(form).replace("%%", "%")), "text")


def _choice(a: list[Value], f: Callable[[list[Column]], Column]) -> Value:
    cols, cls = common(a)
    return Value(f(cols), cls)


define("coalesce", least=2, most=64)(lambda a: _choice(a, lambda c: F.coalesce(*c)))
define("ifnull", least=2)(lambda a: _choice(a, lambda c: F.coalesce(*c)))
define("nullif", least=2)(lambda a: Value(F.when(~F.coalesce(compare("=", *a).col, F.lit(False)), output(a[0])), "int" if a[0].cls == "bool" else a[0].cls))


@define("iif", "if", least=2, most=3)
def _iif(a):
    from .values import condition

    cols, cls = common([a[1], a[2] if len(a) > 2 else null()])
    return Value(F.when(condition(a[0]), cols[0]).otherwise(cols[1]), cls)


@define("typeof")
def _typeof(a):
    v = a[0]
    if v.cls == "cell":
        k = v.col["__kind"]
        name = F.when(k.isin("boolean", "date"), "integer").when(k == "number", F.when(v.col["__n"] == F.floor(v.col["__n"]), "integer").otherwise("real")).when(k.isin("binary", "array"), "blob").otherwise("text")
        return Value(F.when(v.col.isNull(), "null").otherwise(name), "text")
    name = {"int": "integer", "bool": "integer", "real": "real", "text": "text", "null": "null"}.get(v.cls, "blob")
    return Value(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(name)), "text")


@define("abs")
def _abs(a):
    n = number(a[0])
    return Value(F.abs(n.col), n.cls)


@define("round", least=1, most=2)
def _round(a):
    digits = a[1].literal if len(a) > 1 else 0
    if not isinstance(digits, int):
        raise SyntaxProblem("round takes a constant number of digits")
    return Value(F.round(number(a[0]).col.cast("double"), max(0, digits)), "real")


def _rounded(v: Value, f: Callable[[Column], Column]) -> Value:
    """Whole numbers stay what they are, real ones stay real."""
    if v.cls == "int":
        return v
    x = v.col.cast("double")
    return Value(F.when(F.abs(x) >= 2.0**53, x).otherwise(f(x).cast("double")), "real")


define("sign")(lambda a: Value(F.signum(number(a[0]).col.cast("double")).cast("long"), "int"))
for _name, _f in {"ceil": F.ceil, "ceiling": F.ceil, "floor": F.floor}.items():
    define(_name)(lambda a, f=_f: _rounded(number(a[0]), f))
define("trunc")(lambda a: _rounded(number(a[0]), lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))
for _name in ("exp", "sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "degrees", "radians"):
    define(_name)(lambda a, f=getattr(F, _name): Value(f(number(a[0]).col.cast("double")), "real"))


def _within(name: str, f: Callable[[Column], Column], ok: Callable[[Column], Column]) -> None:
    def run(a: list[Value]) -> Value:
        x = number(a[0]).col.cast("double")
        return Value(F.when(ok(x), f(x)), "real")

    define(name)(run)


_within("sqrt", F.sqrt, lambda x: x >= 0)
_within("ln", F.ln, lambda x: x > 0)
_within("log10", F.log10, lambda x: x > 0)
_within("log2", F.log2, lambda x: x > 0)
_within("asin", F.asin, lambda x: F.abs(x) <= 1)
_within("acos", F.acos, lambda x: F.abs(x) <= 1)


@define("log", least=1, most=2)
def _log(a):
    x = number(a[-1]).col.cast("double")
    if len(a) == 1:
        return Value(F.when(x > 0, F.log10(x)), "real")
    b = number(a[0]).col.cast("double")
    return Value(F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b)), "real")



SCALARS["pow"] = SCALARS["power"] = lambda a: Value(F.pow(number(a[0]).col.cast("double"), number(a[1]).col.cast("double")), "real")
define("atan2", least=2)(lambda a: Value(F.atan2(number(a[0]).col.cast("double"), number(a[1]).col.cast("double")), "real"))
define("mod", least=2)(lambda a: Value(F.try_mod(number(a[0]).col.cast("double"), number(a[1]).col.cast("double")), "real"))
define("pi", least=0)(lambda a: Value(F.pi(), "real"))


def extreme(name: str, a: list[Value]) -> Value:
    """MIN and MAX of several arguments: null if any is."""
    cols, cls = common(a)
    best = (F.least if name == "min" else F.greatest)(*cols)
    return Value(F.when(reduce(lambda x, y: x & y, [c.isNotNull() for c in cols]), best), cls)


# Dates: an argument in milliseconds is divided by 1000 and marked 'unixepoch' by the caller.
def _moment(a: list[Value]) -> Column:
    mods = [x.literal for x in a[1:]]
    if a and a[0].literal == "now":
        base = F.current_timestamp()
    elif "unixepoch" in mods:
        base = F.timestamp_seconds(number(a[0]).col)
    elif a[0].cls in ("int", "real"):
        base = F.timestamp_seconds((number(a[0]).col.cast("double") - F.lit(2440587.5)) * 86400.0)
    else:
        base = F.try_to_timestamp(text(a[0]))
    for m in mods:
        if m in ("unixepoch", "utc", "auto"):
            continue
        if m == "start of day":
            base = F.date_trunc("day", base)
        elif m == "start of month":
            base = F.date_trunc("month", base)
        elif m == "start of year":
            base = F.date_trunc("year", base)
        else:
            n, unit = (str(m).split() + [""])[:2]
            unit = unit.rstrip("s")
            if unit not in ("second", "minute", "hour", "day", "month", "year"):
                raise SyntaxProblem(f"date modifier {m!r}")
            if unit in ("month", "year"):
                base = base + F.make_ym_interval(F.lit(int(n) if unit == "year" else 0), F.lit(int(n) if unit == "month" else 0))
            else:
                base = F.timestamp_seconds(F.unix_micros(base) / 1e6 + float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit])
    return base


for _name, _pattern in {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}.items():
    define(_name, least=1, most=8)(lambda a, p=_pattern: Value(F.date_format(_moment(a), p), "text"))
define("unixepoch", least=1, most=8)(lambda a: Value(F.unix_seconds(_moment(a)), "int"))
define("julianday", least=1, most=8)(lambda a: Value(F.unix_micros(_moment(a)) / 86400e6 + 2440587.5, "real"))


@define("strftime", least=2, most=9)
def _strftime(a):
    codes = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS", "%%": "%"}
    at, out, form = _moment(a[1:]), [], a[0].literal
    if not isinstance(form, str):
        raise SyntaxProblem("strftime takes a constant format")
    i = 0
    while i < len(form):
        code = form[i : i + 2]
        if code == "%s":
            out.append(F.unix_seconds(at).cast("string"))
        elif code == "%w":
            out.append((F.dayofweek(at) - 1).cast("string"))
        elif code == "%%":
            out.append(F.lit("%"))
        elif code in codes:
            out.append(F.date_format(at, codes[code]))
        else:
            out.append(F.lit(form[i]))
            i -= 1
        i += 2
    return Value(F.concat(*out), "text")


def _json(v: Value) -> Column:
    return v.col["__arr"] if v.cls == "array" else F.to_json(v.col) if v.cls == "object" else text(v)


@define("json_extract", least=2)
def _json_extract(a):
    if not isinstance(a[1].literal, str):
        raise SyntaxProblem("json_extract takes a constant path")
    # Shown as text; where it is compared or reckoned with, it has its own type.
    return Value(F.get_json_object(_json(a[0]), a[1].literal), "text", typed=_typed(_variant(a[0], a[1].literal)))


def _variant(v: Value, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(_json(v)), path, "variant")


def _typed(v: Column) -> Value:
    """A JSON value as a cell: true and false are 1 and 0, arrays and objects their text. It is parsed once."""

    def cell(v: Column, kind: Column) -> Column:
        n = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
        s = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(v))
        return once(F.struct(n.alias("n"), s.alias("s")), lambda x: _cell(x["n"], x["s"]))

    return Value(once(v, lambda v: once(F.schema_of_variant(v), lambda kind: cell(v, kind))), "cell", costly=True)


def _cell(n: Column, s: Column) -> Column:
    one = F.when(n.isNotNull(), F.struct(F.lit(RANK["int"]).alias("__rank"), F.lit("number").alias("__kind"), n.alias("__n"), F.lit(None).cast("string").alias("__s"), F.lit(None).cast("binary").alias("__b")))
    return one.when(s.isNotNull(), F.struct(F.lit(RANK["text"]).alias("__rank"), F.lit("string").alias("__kind"), F.lit(None).cast("double").alias("__n"), s.alias("__s"), F.lit(None).cast("binary").alias("__b")))


@define("json_arrow", least=2)
def _json_arrow(a):
    """What ``->`` gives: JSON text, with the quotes of strings."""
    return Value(F.to_json(_variant(a[0], a[1].literal)), "text")


@define("json_type", least=1, most=2)
def _json_type(a):
    path = a[1].literal if len(a) > 1 else "$"
    if not isinstance(path, str):
        raise SyntaxProblem("json_type takes a constant path")

    def name(v: Column, kind: Column) -> Column:
        known = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", F.try_variant_get(v, "$", "string")).when(kind == "BIGINT", "integer").when(kind == "STRING", "text")
        return F.when(v.isNotNull(), known.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("real"))

    return Value(once(_variant(a[0], path), lambda v: once(F.schema_of_variant(v), lambda kind: name(v, kind))), "text")


define("json_array_length")(lambda a: Value(F.json_array_length(_json(a[0])).cast("long"), "int"))
define("json_valid")(lambda a: Value(F.try_parse_json(_json(a[0])).isNotNull().cast("long"), "int"))
define("random", least=0)(lambda a: Value((F.rand() * 2.0**62).cast("long"), "int"))


def register(name: str, f: Callable[..., Column], returns: str = "text") -> None:
    """Add a function over Columns (built in or a UDF) to the dialect; ``returns`` is a storage class."""
    SCALARS[name.lower()] = lambda a: Value(f(*[output(x) for x in a]), returns)

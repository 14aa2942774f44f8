"""Statements' trees to DataFrames: names resolved here, all else left to Catalyst."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Field, FieldCatalog
from ..errors import AmbiguousField, InvalidOption, SyntaxProblem, UnsupportedSyntax
from ..functions import registry
from ..functions import values as V
from ..functions.values import Value
from ..types import ID, is_array, is_object
from . import syntax as S


class Bindings:
    """Positional parameters by slot, named ones by ``$n`` or ``n``; a lone value serves every slot."""

    def __init__(self, params: Any = None) -> None:
        self.params = params

    def get(self, p: S.Param) -> Any:
        given = self.params
        if p.name is not None:
            if isinstance(given, dict):
                for k in ("$" + p.name, p.name):
                    if k in given:
                        return given[k]
            raise InvalidOption(f"parameter ${p.name} has no value")
        if isinstance(given, (list, tuple)):
            if p.slot >= len(given):
                raise InvalidOption(f"parameter {p.slot + 1} has no value")
            return given[p.slot]
        if given is None or isinstance(given, dict):
            raise InvalidOption("positional parameters come as a list")
        return given


@dataclass
class Output:
    """One column of a result: its name and its Column; ``type`` where it is a stored value as it is."""

    name: str
    col: Column
    type: T.DataType | None = None
    value: Value | None = None


def column(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))


class Scope:
    """Compiles expressions over a collection's fields."""

    def __init__(self, catalog: FieldCatalog, collection: str, alias: str | None, bindings: Bindings) -> None:
        self.catalog, self.bindings = catalog, bindings
        self.qualifiers = {q.lower() for q in (collection, alias) if q}
        self.used: list[tuple[str, str]] = []  # (path, how) for the layout learner
        self.aliases: dict[str, S.Item] = {}

    # names
    def strip(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        if len(parts) > 1 and parts[0].lower() in self.qualifiers and not self.catalog.resolve(".".join(parts)):
            return parts[1:]
        return parts

    def fields(self, n: S.Name) -> list[Field]:
        return self.catalog.resolve(".".join(self.strip(n.parts)))

    def is_id(self, n: S.Name) -> bool:
        return self.strip(n.parts) == (ID,)

    def of(self, f: Field) -> Value:
        return V.field(column(f.path), f.type)

    # expressions
    def value(self, e: Any) -> Value:
        if isinstance(e, S.Literal):
            return V.literal(e.value)
        if isinstance(e, S.Param):
            return V.literal(self.bindings.get(e))
        if isinstance(e, S.Name):
            return self.name(e)
        if isinstance(e, S.Unary):
            return self.unary(e)
        if isinstance(e, S.Binary):
            return self.binary(e)
        if isinstance(e, S.Between):
            return self.spread(e.arg, e.negated, lambda v: self.between(v, e))
        if isinstance(e, S.In):
            return self.spread(e.arg, e.negated, lambda v: self.among(v, e))
        if isinstance(e, S.Case):
            return self.case(e)
        if isinstance(e, S.Call):
            return self.call(e)
        raise SyntaxProblem("a wildcard is not an expression")

    def name(self, n: S.Name) -> Value:
        if self.is_id(n):
            return Value(F.col(ID).cast("long"), "int")
        found = self.fields(n)
        if len(found) > 1:
            raise AmbiguousField(f"{'.'.join(n.parts)} could be {', '.join(f.dotted for f in found)}")
        if found:
            return self.of(found[0])
        item = self.aliases.get(n.parts[-1].lower()) if len(n.parts) == 1 else None
        if item is not None:
            kept, self.aliases = self.aliases, {}
            try:
                return self.value(item.expr)
            finally:
                self.aliases = kept
        return V.null()

    def unary(self, e: S.Unary) -> Value:
        if e.op == "not":
            return Value(~V.condition(self.value(e.arg)), "bool")
        n = V.number(self.value(e.arg))
        if e.op == "~":
            return Value(F.bitwise_not(n.col.cast("long")), "int")
        if e.op == "+":
            return self.value(e.arg)
        return Value(-n.col, n.cls, -n.literal if n.literal is not None else None)

    def spread(self, arg: Any, negated: bool, test) -> Value:
        """A predicate on a leaf name that several paths share: any of them, or all if negated."""
        found = self.fields(arg) if isinstance(arg, S.Name) and not self.is_id(arg) else []
        if len(found) > 1:
            cols = [test(self.of(f)).col for f in found]
            return Value(reduce((lambda a, b: a & b) if negated else (lambda a, b: a | b), cols), "bool")
        if len(found) == 1:
            self.used.append((found[0].dotted, "range"))
        return test(self.value(arg))

    def between(self, v: Value, e: S.Between) -> Value:
        c = V.compare(">=", v, self.value(e.low)).col & V.compare("<=", v, self.value(e.high)).col
        return Value(~c if e.negated else c, "bool")

    def among(self, v: Value, e: S.In) -> Value:
        items = [self.value(x) for x in e.items]
        if not items:
            return Value(F.lit(e.negated), "bool")
        plain = [x.literal for x in items]
        if v.cls in ("int", "text") and all(p is not None and V.RANK[x.cls] == V.RANK[v.cls] for p, x in zip(plain, items, strict=True)):
            c = v.col.isin(plain)
        else:
            c = reduce(lambda a, b: a | b, [V.compare("=", v, x).col for x in items])
        return Value(~c if e.negated else c, "bool")

    def binary(self, e: S.Binary) -> Value:
        if e.op in ("and", "or"):
            a, b = V.condition(self.value(e.left)), V.condition(self.value(e.right))
            return Value(a & b if e.op == "and" else a | b, "bool")
        if e.op in ("+", "-", "*", "/", "%"):
            return V.arithmetic(e.op, self.value(e.left), self.value(e.right))
        if e.op in ("&", "|", "<<", ">>"):
            return V.bitwise(e.op, self.value(e.left), self.value(e.right))
        if e.op == "||":
            return Value(F.concat(V.text(self.value(e.left)), V.text(self.value(e.right))), "text")
        if e.op in ("->", "->>"):
            path = self.value(e.right).literal
            path = f"$[{path}]" if isinstance(path, int) else path if str(path).startswith("$") else f"$.{path}"
            return registry.call("json_arrow" if e.op == "->" else "json_extract", [self.value(e.left), V.literal(path)])
        negated = e.op == "!=" or e.op.startswith("not ")
        op = e.op.removeprefix("not ")
        if op in ("like", "glob", "regexp", "match"):
            right = self.value(e.right)
            escape = self.value(e.escape) if e.escape is not None else None

            def test(v: Value) -> Value:
                m = V.match(op, v, right, escape)
                return Value(~m.col, "bool") if negated else m

            return self.spread(e.left, negated, test)
        if op in ("is", "is not"):
            right = self.value(e.right)
            return self.spread(e.left, False, lambda v: Value(~V.same(v, right) if op == "is not" else V.same(v, right), "bool"))
        for one, other, flip in ((e.left, e.right, False), (e.right, e.left, True)):
            found = self.fields(one) if isinstance(one, S.Name) and not self.is_id(one) else []
            if found and isinstance(other, (S.Literal, S.Param)):
                if len(found) == 1:
                    self.used.append((found[0].dotted, "equality" if op == "=" else "other" if op == "!=" else "range"))
                swap = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
                o = swap.get(op, op) if flip else op
                right = self.value(other)
                cols = [V.compare(o, self.of(f), right).col for f in found]
                return Value(reduce((lambda a, b: a & b) if negated else (lambda a, b: a | b), cols), "bool")
        return V.compare(op, self.value(e.left), self.value(e.right))

    def case(self, e: S.Case) -> Value:
        base = self.value(e.base) if e.base is not None else None
        tests = [V.condition(self.value(c)) if base is None else V.compare("=", base, self.value(c)).col for c, _ in e.branches]
        cols, cls = V.common([*(self.value(r) for _, r in e.branches), self.value(e.otherwise) if e.otherwise is not None else V.null()])
        out = F.when(tests[0], cols[0])
        for t, c in zip(tests[1:], cols[1:-1], strict=True):
            out = out.when(t, c)
        return Value(out.otherwise(cols[-1]), cls)

    def call(self, e: S.Call) -> Value:
        if e.name in registry.AGGREGATES and not (e.name in ("min", "max") and len(e.args) > 1):
            raise SyntaxProblem(f"{e.name} is an aggregate and cannot stand here")
        args = [self.value(a) for a in e.args]
        if e.name in ("min", "max"):
            return registry.extreme(e.name, args)
        return registry.call(e.name, args)


def has_aggregate(e: Any, only_single: bool = False) -> bool:
    if isinstance(e, S.Call):
        if e.name in registry.AGGREGATES and not (only_single and e.name in ("min", "max") and len(e.args) > 1):
            return True
        return any(has_aggregate(a, only_single) for a in e.args)
    if isinstance(e, S.Unary):
        return has_aggregate(e.arg, only_single)
    if isinstance(e, S.Binary):
        return has_aggregate(e.left, only_single) or has_aggregate(e.right, only_single)
    if isinstance(e, S.Between):
        return any(has_aggregate(x, only_single) for x in (e.arg, e.low, e.high))
    if isinstance(e, S.In):
        return any(has_aggregate(x, only_single) for x in (e.arg, *e.items))
    if isinstance(e, S.Case):
        return any(has_aggregate(x, only_single) for p in e.branches for x in p) or has_aggregate(e.base, only_single) or has_aggregate(e.otherwise, only_single)
    return False


class Grouped(Scope):
    """Expressions over groups: keys, aggregates, and bare fields (the row of a lone MIN or MAX, else the first document's)."""

    def __init__(self, inner: Scope, keys: list[Any], lone: S.Call | None) -> None:
        super().__init__(inner.catalog, "", None, inner.bindings)
        self.qualifiers, self.inner, self.keys, self.lone = inner.qualifiers, inner, keys, lone
        self.key_values = [inner.value(k) for k in keys]
        self.key_cols = [V.cell_of(v) if v.cls == "cell" else V.output(v) for v in self.key_values]
        self.aggs: dict[Any, tuple[Column, str]] = {}
        self.aliases, self.used = inner.aliases, inner.used

    def value(self, e: Any) -> Value:
        for i, k in enumerate(self.keys):
            if e == k or isinstance(e, S.Name) and isinstance(k, S.Name) and self.fields(e) and self.fields(e) == self.inner.fields(k):
                v = self.key_values[i]
                return Value(F.col(f"__b{i}") if v.cls == "cell" else F.col(f"__k{i}"), "int" if v.cls == "bool" else v.cls)
        return super().value(e)

    def agg(self, key: Any, col: Column, cls: str) -> Value:
        if key not in self.aggs:
            self.aggs[key] = (col, cls)
        return Value(F.col(f"__a{list(self.aggs).index(key)}"), cls)

    def name(self, n: S.Name) -> Value:
        if self.is_id(n):
            return self.agg(("id",), F.min(ID), "int")
        found = self.fields(n)
        if not found:
            return super().name(n)
        if len(found) > 1:
            return super().name(n)
        v = self.of(found[0])
        if self.lone is not None:
            at = self.inner.value(self.lone.args[0])
            f = F.max_by if self.lone.name == "max" else F.min_by
            return self.agg(("bare", found[0].dotted), f(V.output(v), V.output(at)), v.cls)
        return self.agg(("bare", found[0].dotted), F.min_by(V.output(v), F.col(ID)), v.cls)

    def call(self, e: S.Call) -> Value:
        if e.name not in registry.AGGREGATES or e.name in ("min", "max") and len(e.args) > 1:
            return super().call(e)
        if e.star:
            if e.name != "count":
                raise SyntaxProblem(f"{e.name}(*) is not an aggregate")
            return self.agg(e, F.count(F.lit(1)), "int")
        if not e.args:
            raise SyntaxProblem(f"{e.name} takes an argument")
        if has_aggregate(e.args[0], True):
            raise SyntaxProblem("aggregates do not nest")
        x = self.inner.value(e.args[0])
        if x.cls == "object":
            raise UnsupportedSyntax("objects cannot be aggregated")
        c = V.cell_of(x) if x.cls in ("cell", "array") else V.output(x)
        if e.name == "count":
            return self.agg(e, F.count_distinct(c) if e.distinct else F.count(c), "int")
        if e.name in ("min", "max"):
            f = F.min if e.name == "min" else F.max
            if x.cls == "cell":
                best = f(F.when(x.col.isNotNull(), F.struct(c.alias("o"), x.col.alias("v"))))
                return self.agg(e, best["v"], "cell")
            return self.agg(e, f(c), "int" if x.cls == "bool" else x.cls)
        if e.name == "group_concat":
            sep = self.value(e.args[1]).literal if len(e.args) > 1 else ","
            s = V.text(x)
            items = F.sort_array(F.collect_set(s) if e.distinct else F.collect_list(s))
            return self.agg(e, F.when(F.count(s) > 0, F.array_join(items, sep)), "text")
        n = V.number(x)
        if e.name == "avg":
            return self.agg(e, F.avg(n.col) if not e.distinct else F.sum_distinct(n.col) / F.count_distinct(n.col), "real")
        total = F.sum_distinct(n.col) if e.distinct else F.sum(n.col)
        if e.name == "total":
            return self.agg(e, F.coalesce(total.cast("double"), F.lit(0.0)), "real")
        return self.agg(e, total, n.cls)


@dataclass
class Plan:
    """A compiled statement: its rows and how to read them."""

    df: DataFrame
    outputs: list[Output]
    documents: bool
    used: list[tuple[str, str]]


def compile_select(s: S.Select, df: DataFrame, bindings: Bindings) -> Plan:
    catalog = FieldCatalog(df.schema)
    scope = Scope(catalog, s.collection, s.alias, bindings)
    lone = len(s.items) == 1 and isinstance(s.items[0].expr, S.Wild) and s.items[0].expr.deep
    if lone and all(p.lower() in scope.qualifiers for p in s.items[0].expr.parts[:1]) and len(s.items[0].expr.parts) < 2 and not (s.items[0].expr.parts and catalog.resolve(s.items[0].expr.parts[0])):
        if s.distinct or s.group or s.having is not None:
            raise UnsupportedSyntax("whole documents take no DISTINCT, GROUP BY or HAVING")
        rows = paged(ordered(filtered(df, s, scope), s, scope), s, scope)
        names = [c for c in rows.columns if c != ID]
        return Plan(rows.select(*[F.col(f"`{c}`") for c in names]), [Output(c, F.col(f"`{c}`"), df.schema[c].dataType) for c in names], True, scope.used)
    for i in s.items:
        if i.alias:
            scope.aliases.setdefault(i.alias.lower(), i)
    aggregated = bool(s.group) or s.having is not None or any(has_aggregate(i.expr, True) for i in s.items)
    any_aggregate = any(has_aggregate(i.expr) for i in s.items)
    rows = filtered(df, s, scope)
    if aggregated:
        return grouped(s, rows, scope, any_aggregate)
    outs = [o for i in s.items for o in expand(i, scope)]
    explicit = any(isinstance(i.expr, S.Name) and scope.is_id(i.expr) for i in s.items)
    if not explicit and not s.distinct and not any_aggregate:
        outs.insert(0, Output(ID, F.col(ID), T.LongType()))
    check_names(outs)
    if s.distinct:
        return distinct(s, rows, scope, outs)
    rows = paged(ordered(rows, s, scope, outs), s, scope)
    return Plan(rows.select(*[o.col.alias(o.name) for o in outs]), outs, False, scope.used)


def check_names(outs: list[Output]) -> None:
    seen = set()
    for o in outs:
        if o.name.lower() in seen:
            raise SyntaxProblem(f"duplicate column {o.name!r}")
        seen.add(o.name.lower())


def filtered(df: DataFrame, s: S.Select, scope: Scope) -> DataFrame:
    if s.where is None:
        return df
    kept, scope.aliases = scope.aliases, {}
    try:
        return df.where(V.condition(scope.value(s.where)))
    finally:
        scope.aliases = kept


def sort_column(v: Value, descending: bool) -> Column:
    c = V.cell_of(v) if v.cls in ("cell", "array") else V.output(v)
    return c.desc_nulls_last() if descending else c.asc_nulls_first()


def ordered(df: DataFrame, s: S.Select, scope: Scope, outs: list[Output] | None = None) -> DataFrame:
    if not s.order:
        return df
    keys = []
    for o in s.order:
        if isinstance(o.expr, S.Literal) and isinstance(o.expr.value, int) and outs is not None:
            visible = [x for x in outs if x.name != ID] if len(outs) and outs[0].name == ID else outs
            if not 1 <= o.expr.value <= len(visible):
                raise SyntaxProblem(f"ORDER BY {o.expr.value} is out of range")
            c = visible[o.expr.value - 1].col
            keys.append(c.desc_nulls_last() if o.descending else c.asc_nulls_first())
            continue
        if isinstance(o.expr, S.Name) and len(scope.fields(o.expr)) == 1:
            scope.used.append((scope.fields(o.expr)[0].dotted, "order"))
        keys.append(sort_column(scope.value(o.expr), o.descending))
    return df.orderBy(*keys)


def constant(e: Any, scope: Scope, what: str) -> int | None:
    if e is None:
        return None
    x = scope.bindings.get(e) if isinstance(e, S.Param) else e.value if isinstance(e, S.Literal) else -e.arg.value if isinstance(e, S.Unary) and e.op == "-" and isinstance(e.arg, S.Literal) else None
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x):
        raise SyntaxProblem(f"{what} takes a whole number")
    return int(x)


def paged(df: DataFrame, s: S.Select, scope: Scope) -> DataFrame:
    limit, offset = constant(s.limit, scope, "LIMIT"), constant(s.offset, scope, "OFFSET")
    if offset and offset > 0:
        df = df.offset(offset)
    return df if limit is None or limit < 0 else df.limit(limit)


def expand(i: S.Item, scope: Scope) -> list[Output]:
    e, catalog = i.expr, scope.catalog
    if isinstance(e, S.Wild):
        parts = scope.strip(e.parts) if e.parts and (len(e.parts) > 1 or e.parts[0].lower() not in scope.qualifiers or catalog.resolve(e.parts[0])) else ()
        if not parts and e.deep:
            raise UnsupportedSyntax("* stands alone, for whole documents")
        found = catalog.children(".".join(parts), e.deep) if parts else catalog.top()
        if i.alias and len(found) > 1:
            raise SyntaxProblem("an alias names one column")
        return [Output(i.alias or catalog.alias(f), children(f) if is_object(f.type) else stored(f), None if is_object(f.type) else f.type) for f in found]
    if isinstance(e, S.Name):
        if scope.is_id(e):
            return [Output(i.alias or ID, F.col(ID), T.LongType())]
        found = scope.fields(e)
        if len(found) > 1:
            if i.alias:
                raise SyntaxProblem("an alias names one column")
            return [Output(f.dotted, stored(f), f.type) for f in found]
        if found:
            f = found[0]
            return [Output(i.alias or catalog.alias(f), stored(f), f.type)]
        return [Output(i.alias or e.parts[-1], F.lit(None).cast("string"))]
    v = scope.value(e)
    return [Output(i.alias or i.source, V.output(v), value=v)]


def stored(f: Field) -> Column:
    """A field as it is, but for booleans and dates, which results show as numbers, and big integers, as text."""
    if is_object(f.type) or is_array(f.type):
        return column(f.path)
    v = V.field(column(f.path), f.type)
    if v.cls == "int" and not isinstance(f.type, (T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column(f.path)
    return V.output(v)


def children(f: Field) -> Column:
    """An object that a wildcard meets shows how many fields it has."""
    c = column(f.path)
    n = reduce(lambda a, b: a + b, [column((*f.path, x.name)).isNotNull().cast("long") for x in f.type if x.name != "__empty"], F.lit(0).cast("long"))
    return F.when(c.isNotNull(), n)


def distinct(s: S.Select, rows: DataFrame, scope: Scope, outs: list[Output]) -> Plan:
    if any(o.type is not None and is_object(o.type) for o in outs):
        raise UnsupportedSyntax("objects take no DISTINCT")
    keys = [f"__d{i}" for i in range(len(outs))]
    plain = [F.when(o.col.isNotNull(), F.struct(o.col["__rank"].alias("r"), o.col["__n"].alias("n"), o.col["__s"].alias("s"), o.col["__b"].alias("b"))) if is_celled(o) else o.col for o in outs]
    sorts = [(f"__o{j}", scope.value(o.expr), o.descending) for j, o in enumerate(s.order) if not isinstance(o.expr, S.Literal)]
    wide = rows.select(*[c.alias(k) for c, k in zip(plain, keys, strict=True)], *[o.col.alias(f"__v{i}") for i, o in enumerate(outs)], *[(V.cell_of(v) if v.cls == "cell" else V.output(v)).alias(n) for n, v, _ in sorts])
    firsts = [F.min(f"__v{i}").alias(f"__w{i}") for i in range(len(outs))]
    out = wide.groupBy(*keys).agg(*firsts, *[F.min(n).alias(n) for n, _, _ in sorts])
    by = []
    j = 0
    for o in s.order:
        if isinstance(o.expr, S.Literal):
            c = F.col(f"__w{int(o.expr.value) - 1}")
        else:
            c, j = F.col(f"__o{j}"), j + 1
        by.append(c.desc_nulls_last() if o.descending else c.asc_nulls_first())
    if by:
        out = out.orderBy(*by)
    out = paged(out, s, scope).select(*[F.col(f"__w{i}").alias(o.name) for i, o in enumerate(outs)])
    return Plan(out, outs, False, scope.used)


def is_celled(o: Output) -> bool:
    from ..types import is_cell

    return o.type is not None and is_cell(o.type) or o.value is not None and o.value.cls == "cell"


def grouped(s: S.Select, rows: DataFrame, scope: Scope, any_aggregate: bool) -> Plan:
    keys = []
    for k in s.group:
        if isinstance(k, S.Literal) and isinstance(k.value, int):
            k = s.items[k.value - 1].expr
        if isinstance(k, S.Name) and not scope.fields(k) and not scope.is_id(k) and k.parts[-1].lower() in scope.aliases:
            k = scope.aliases[k.parts[-1].lower()].expr
        found = scope.fields(k) if isinstance(k, S.Name) else []
        if found and is_object(found[0].type):
            raise UnsupportedSyntax("objects take no GROUP BY")
        if len(found) == 1:
            scope.used.append((found[0].dotted, "order"))
        keys.append(k)
    singles = [c for i in s.items for c in calls(i.expr) if c.name in ("min", "max") and len(c.args) == 1]
    others = [c for i in s.items for c in calls(i.expr) if c.name in registry.AGGREGATES]
    g = Grouped(scope, keys, singles[0] if len(singles) == 1 and len(others) == 1 else None)
    outs = []
    for i in s.items:
        if isinstance(i.expr, S.Wild):
            raise UnsupportedSyntax("wildcards take no GROUP BY")
        if isinstance(i.expr, S.Name) and (f := scope.fields(i.expr)) and is_object(f[0].type):
            raise UnsupportedSyntax("objects take no GROUP BY")
        name = i.alias or (scope.catalog.alias(scope.fields(i.expr)[0]) if isinstance(i.expr, S.Name) and scope.fields(i.expr) else i.source)
        v = g.value(i.expr)
        t = scope.fields(i.expr)[0].type if isinstance(i.expr, S.Name) and scope.fields(i.expr) and v.cls in ("array", "cell") else None
        outs.append(Output(name, V.output(v), t, v))
    if not any_aggregate and not any(isinstance(i.expr, S.Name) and scope.is_id(i.expr) for i in s.items):
        outs.insert(0, Output(ID, g.agg(("id",), F.min(ID), "int").col, T.LongType()))
    check_names(outs)
    having = V.condition(g.value(s.having)) if s.having is not None else None
    order = []
    for o in s.order:
        if isinstance(o.expr, S.Literal) and isinstance(o.expr.value, int):
            visible = [x for x in outs if x.name != ID]
            c = visible[o.expr.value - 1].col
            order.append(c.desc_nulls_last() if o.descending else c.asc_nulls_first())
        else:
            order.append(sort_column(g.value(o.expr), o.descending))
    aggs = [c.alias(f"__a{i}") for i, (c, _) in enumerate(g.aggs.values())]
    for i, v in enumerate(g.key_values):
        if v.cls == "cell":
            aggs.append(F.min(F.struct(V.cell_of(v).alias("o"), v.col.alias("v")))["v"].alias(f"__b{i}"))
    grouping = [c.alias(f"__k{i}") for i, c in enumerate(g.key_cols)]
    if grouping:
        out = rows.groupBy(*grouping).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    else:
        out = rows.agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    if having is not None:
        out = out.where(having)
    if order:
        out = out.orderBy(*order)
    out = paged(out, s, scope)
    if s.distinct:
        out = out.select(*[o.col.alias(o.name) for o in outs]).distinct()
    else:
        out = out.select(*[o.col.alias(o.name) for o in outs])
    return Plan(out, outs, False, scope.used)


def calls(e: Any) -> list[S.Call]:
    if isinstance(e, S.Call):
        return [e, *(c for a in e.args for c in calls(a))]
    if isinstance(e, S.Unary):
        return calls(e.arg)
    if isinstance(e, S.Binary):
        return calls(e.left) + calls(e.right)
    if isinstance(e, S.Between):
        return calls(e.arg) + calls(e.low) + calls(e.high)
    if isinstance(e, S.In):
        return [c for x in (e.arg, *e.items) for c in calls(x)]
    if isinstance(e, S.Case):
        return [c for p in e.branches for x in p for c in calls(x)] + (calls(e.base) if e.base else []) + (calls(e.otherwise) if e.otherwise else [])
    return []


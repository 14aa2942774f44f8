"""Tokens and trees of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import SyntaxProblem, UnsupportedSyntax


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, number, string, param, op, end
    text: str
    at: int
    end: int


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<param>\$[A-Za-z_]\w*)
    |(?P<word>[^\W\d]\w*)
    |(?P<op>\|\||<<|>>|<=|>=|<>|!=|==|->>|->|[-+*/%=<>(),.?~&|;])""",
    re.X | re.S,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return [*out, Token("end", "", at, at)]


# Trees. Names keep the case they were written in.
@dataclass(frozen=True)
class Name:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Wild:
    parts: tuple[str, ...]
    deep: bool  # p.* (with no parts: all documents), else ? and p.?


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Param:
    slot: int | None
    name: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any
    escape: Any = None


@dataclass(frozen=True)
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class In:
    arg: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Case:
    base: Any
    branches: tuple
    otherwise: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None
    source: str


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool


@dataclass
class Select:
    items: list[Item]
    collection: str
    alias: str | None = None
    distinct: bool = False
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None
    order: list[Order] = field(default_factory=list)
    limit: Any = None
    offset: Any = None


_STOP = {"from", "where", "group", "having", "order", "limit", "offset", "as", "and", "or", "not", "then", "when", "else", "end", "in", "is", "like", "glob", "between", "asc", "desc", "by", "escape", "union", "intersect", "except", "join", "inner", "left", "right", "cross", "full", "on", "natural", "outer", "regexp", "match", "set", "distinct", "collate"}
_JOIN = {"join", "inner", "left", "right", "cross", "full", "natural", "outer", "on", "using"}
_SETS = {"union", "intersect", "except"}


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.toks, self.i, self.slots = text, tokens(text), 0, 0

    # helpers
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def word(self, *words: str) -> bool:
        return self.tok.kind == "word" and self.tok.text.lower() in words

    def op(self, *ops: str) -> bool:
        return self.tok.kind == "op" and self.tok.text in ops

    def take(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def accept(self, *words: str) -> bool:
        if self.word(*words) or self.op(*words):
            self.i += 1
            return True
        return False

    def expect(self, what: str) -> None:
        if not self.accept(what):
            raise SyntaxProblem(f"expected {what.upper()} near {self.text[self.tok.at : self.tok.at + 20]!r}")

    def done(self) -> None:
        self.accept(";")
        if self.tok.kind != "end":
            low = self.tok.text.lower()
            if low in _SETS or low in _JOIN or self.tok.text == ",":
                raise UnsupportedSyntax(f"{self.tok.text.upper()} is not part of the dialect; use QUERY ON")
            raise SyntaxProblem(f"unexpected {self.tok.text!r} at {self.tok.at}")

    @staticmethod
    def unquote(t: Token) -> str:
        if t.kind != "quoted":
            return t.text
        return t.text[1:-1].replace('""', '"') if t.text[0] == '"' else t.text[1:-1]

    def identifier(self, what: str = "name") -> str:
        if self.tok.kind == "quoted" or self.tok.kind == "word" and self.tok.text.lower() not in _STOP:
            return self.unquote(self.take())
        raise SyntaxProblem(f"expected a {what} near {self.text[self.tok.at : self.tok.at + 20]!r}")

    def collection(self) -> str:
        """A collection's name; bare names may hold hyphens and digits."""
        if self.tok.kind == "quoted":
            return self.unquote(self.take())
        if self.op("("):
            raise UnsupportedSyntax("subqueries are not part of the dialect; use QUERY ON")
        first = self.tok
        joined = self.toks[min(self.i + 1, len(self.toks) - 1)].text == "-"
        if first.kind not in ("word", "number") or first.text.lower() in _STOP and not joined:
            raise SyntaxProblem("expected a collection")
        last = self.take()
        while self.tok.at == last.end and (self.tok.kind in ("word", "number") or self.op("-")):
            last = self.take()
        return self.text[first.at : last.end]

    # statements
    def select(self) -> Select:
        if self.word("with", "values"):
            raise UnsupportedSyntax("WITH and VALUES are not part of the dialect; use QUERY ON")
        self.expect("select")
        distinct = self.accept("distinct")
        items = [self.item()]
        while self.accept(","):
            items.append(self.item())
        self.expect("from")
        s = Select(items, self.collection(), distinct=distinct)
        if self.accept("as"):
            s.alias = self.identifier("alias")
        elif self.tok.kind in ("word", "quoted") and self.tok.text.lower() not in _STOP:
            s.alias = self.identifier("alias")
        self.clauses(s)
        self.done()
        return s

    def clauses(self, s: Select, grouped: bool = True) -> None:
        if self.accept("where"):
            s.where = self.expression()
        if self.word("group"):
            if not grouped:
                raise UnsupportedSyntax("a selector takes no GROUP BY")
            self.take()
            self.expect("by")
            s.group.append(self.expression())
            while self.accept(","):
                s.group.append(self.expression())
        if self.word("having"):
            if not grouped:
                raise UnsupportedSyntax("a selector takes no HAVING")
            self.take()
            s.having = self.expression()
        if self.accept("order"):
            self.expect("by")
            while True:
                e = self.expression()
                s.order.append(Order(e, self.accept("desc") or (self.accept("asc") and False)))
                if self.word("nulls", "collate"):
                    raise UnsupportedSyntax(f"{self.tok.text.upper()} is not part of the dialect")
                if not self.accept(","):
                    break
        if self.accept("limit"):
            s.limit = self.expression()
            if self.accept(","):
                raise UnsupportedSyntax("write LIMIT n OFFSET m")
            if self.accept("offset"):
                s.offset = self.expression()

    def item(self) -> Item:
        start = self.tok.at
        wild = self.wildcard()
        expr = wild if wild is not None else self.expression()
        source = self.text[start : self.toks[self.i - 1].end]
        alias = None
        if self.accept("as"):
            alias = self.unquote(self.take()) if self.tok.kind in ("word", "quoted") else self.take().text.strip("'")
        elif self.tok.kind == "quoted" or self.tok.kind == "word" and self.tok.text.lower() not in _STOP:
            alias = self.identifier("alias")
        return Item(expr, alias, source)

    def wildcard(self) -> Wild | None:
        save = self.i
        if self.op("*"):
            self.take()
            return Wild((), True)
        if self.op("?") and (self.toks[self.i + 1].text.lower() in (",", "from")):
            self.take()
            return Wild((), False)
        parts = []
        while self.tok.kind in ("word", "quoted") and self.toks[self.i + 1].text == ".":
            parts.append(self.unquote(self.take()))
            self.take()
            if self.op("*", "?"):
                return Wild(tuple(parts), self.take().text == "*")
        self.i = save
        return None

    # expressions, loosest first
    def expression(self) -> Any:
        e = self.conjunction()
        while self.accept("or"):
            e = Binary("or", e, self.conjunction())
        return e

    def conjunction(self) -> Any:
        e = self.negation()
        while self.accept("and"):
            e = Binary("and", e, self.negation())
        return e

    def negation(self) -> Any:
        return Unary("not", self.negation()) if self.accept("not") else self.equality()

    def equality(self) -> Any:
        e = self.comparison()
        while True:
            negated = False
            if self.op("=", "==", "!=", "<>"):
                op = self.take().text
                e = Binary("=" if op in ("=", "==") else "!=", e, self.comparison())
                continue
            if self.word("is"):
                self.take()
                op = "is not" if self.accept("not") else "is"
                e = Binary(op, e, self.comparison())
                continue
            if self.word("not") and self.toks[self.i + 1].text.lower() in ("like", "glob", "regexp", "match", "in", "between"):
                self.take()
                negated = True
            if self.word("like", "glob", "regexp", "match"):
                op = self.take().text.lower()
                right = self.comparison()
                escape = self.comparison() if self.accept("escape") else None
                e = Binary(("not " if negated else "") + op, e, right, escape)
            elif self.accept("between"):
                low = self.comparison()
                self.expect("and")
                e = Between(e, low, self.comparison(), negated)
            elif self.accept("in"):
                self.expect("(")
                if self.word("select"):
                    raise UnsupportedSyntax("subqueries are not part of the dialect; use QUERY ON")
                items = []
                if not self.op(")"):
                    items.append(self.expression())
                    while self.accept(","):
                        items.append(self.expression())
                self.expect(")")
                e = In(e, tuple(items), negated)
            else:
                if self.word("collate"):
                    raise UnsupportedSyntax("COLLATE is not part of the dialect")
                return e

    def _chain(self, below, *ops: str) -> Any:
        e = below()
        while self.op(*ops):
            op = self.take().text
            e = Binary(op, e, below())
        return e

    def comparison(self) -> Any:
        return self._chain(self.bits, "<", "<=", ">", ">=")

    def bits(self) -> Any:
        return self._chain(self.sum, "&", "|", "<<", ">>")

    def sum(self) -> Any:
        return self._chain(self.product, "+", "-")

    def product(self) -> Any:
        return self._chain(self.join, "*", "/", "%")

    def join(self) -> Any:
        return self._chain(self.unary, "||", "->", "->>")

    def unary(self) -> Any:
        if self.op("-", "+", "~"):
            return Unary(self.take().text, self.unary())
        return self.primary()

    def primary(self) -> Any:
        t = self.tok
        if t.kind == "number":
            self.take()
            x = float(t.text)
            return Literal(int(t.text) if t.text.isdigit() else int(x) if x.is_integer() and abs(x) < 2**53 else x)
        if t.kind == "string":
            return Literal(self.take().text[1:-1].replace("''", "'"))
        if t.kind == "param":
            return Param(None, self.take().text[1:])
        if self.accept("?"):
            self.slots += 1
            return Param(self.slots - 1)
        if self.accept("("):
            if self.word("select"):
                raise UnsupportedSyntax("subqueries are not part of the dialect; use QUERY ON")
            e = self.expression()
            self.expect(")")
            return e
        if t.kind == "word":
            low = t.text.lower()
            if low in ("null", "true", "false"):
                self.take()
                return Literal({"null": None, "true": 1, "false": 0}[low])
            if low == "case":
                return self.case()
            if low in ("exists", "cast") and self.toks[self.i + 1].text == "(":
                raise UnsupportedSyntax(f"{low.upper()} is not part of the dialect")
            if self.toks[self.i + 1].text == "(":
                return self.call()
        if t.kind in ("word", "quoted") and (t.kind == "quoted" or t.text.lower() not in _STOP):
            parts = [self.identifier()]
            while self.op(".") and self.toks[self.i + 1].kind in ("word", "quoted"):
                self.take()
                parts.append(self.unquote(self.take()))
            return Name(tuple(parts))
        raise SyntaxProblem(f"unexpected {t.text or 'end of statement'!r} at {t.at}")

    def case(self) -> Case:
        self.take()
        base = None if self.word("when") else self.expression()
        branches = []
        while self.accept("when"):
            c = self.expression()
            self.expect("then")
            branches.append((c, self.expression()))
        if not branches:
            raise SyntaxProblem("CASE needs WHEN")
        otherwise = self.expression() if self.accept("else") else None
        self.expect("end")
        return Case(base, tuple(branches), otherwise)

    def call(self) -> Call:
        name = self.take().text.lower()
        self.expect("(")
        distinct = self.accept("distinct")
        if self.accept("*"):
            self.expect(")")
            return Call(name, (), star=True)
        args = []
        if not self.op(")"):
            args.append(self.expression())
            while self.accept(","):
                args.append(self.expression())
        self.expect(")")
        if self.word("over", "filter"):
            raise UnsupportedSyntax("window functions and FILTER are not part of the dialect; use QUERY ON")
        return Call(name, tuple(args), distinct)


def parse_select(text: str) -> Select:
    return Parser(text).select()

"""The engine: collections by name, statements in, rows and documents out."""

from __future__ import annotations

import re
import tempfile
import threading
import time
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as D
from .errors import Closed, DocsparkError, InvalidDocument, InvalidOption, ReadOnly, SyntaxProblem, UnsupportedSyntax

from .functions import values as V
from .operators import mutations as M
from .operators.indexing import PRESETS, Learner, policy
from .operators.structure import Structure, structure
from .plans import syntax as S
from .plans.guard import read_only
from .plans.compiler import Bindings, Plan, Scope, column, compile_select
from .catalog import FieldCatalog
from .sources.backup import write_backup
from .sources.storage import Store, check_name, discover
from .streaming.results import MOST_BATCH, USUAL_BATCH, Matched, Signal, batches, scope

_WRITES = re.compile(r"\s*(insert\s+into|update|upsert\s+into|replace\s+into|unset|delete\s+from)\b", re.I)
_GUIDANCE = {
    "insert": "write INSERT INTO collection, with the documents as the payload",
    "upsert": "write UPSERT INTO collection WHERE ...",
    "replace": "write REPLACE INTO collection WHERE ...",
    "delete": "write DELETE FROM collection WHERE ..., or UNSET fields FROM collection",
    "with": "WITH is not part of the dialect; use QUERY ON collection SELECT ...",
    "remove": "write UNSET fields FROM collection",
    "create": "collections come into being with their first INSERT INTO",
    "drop": "write DELETE FROM collection",
}


def _shared(spark: SparkSession) -> str | None:
    """The session's checkpoint folder if it is a mounted one: executors must see ``:memory:`` collections too."""
    found = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not found.startswith("/"):
        return None
    Path(found).mkdir(parents=True, exist_ok=True)
    return found


@dataclass(frozen=True)
class Outcome:
    """What ``run`` returns instead of raising."""

    ok: bool
    value: Any = None
    error: DocsparkError | None = None


class Engine:
    """Document collections in a storage folder, or, with ``:memory:``, in a temporary one.

    ``register`` binds a DataFrame as a read-only collection. Statements run on a fixed version of
    their collection; writers take a lock per collection, so concurrent engines do not lose updates.
    """

    def __init__(self, spark: SparkSession, path: str = ":memory:", *, mode: str = "readwrite", durability: str = "balanced", max_open: int = 16, field_indexes: Any = "auto", lease_s: float = 600) -> None:
        if mode not in ("readwrite", "readonly"):
            raise InvalidOption("mode is readwrite or readonly")
        if durability not in ("strict", "balanced"):
            raise InvalidOption("durability is strict or balanced")
        if mode == "readonly" and path == ":memory:":
            raise InvalidOption("a read-only engine needs a path")
        if not isinstance(max_open, int) or max_open < 1:
            raise InvalidOption("max_open is a positive number")
        if lease_s < 0:
            raise InvalidOption("lease_s is not negative")
        self.lease_s = lease_s
        self.spark, self.readonly, self.durable, self.max_open = spark, mode == "readonly", durability == "strict", max_open
        self._temp = tempfile.TemporaryDirectory(prefix="docspark-", dir=_shared(spark)) if path == ":memory:" else None
        self.root = Path(self._temp.name if self._temp else path)
        if not self.readonly:
            self.root.mkdir(parents=True, exist_ok=True)
        self.policy = policy(field_indexes)
        self._registered: dict[str, DataFrame] = {}
        self._open: OrderedDict[str, tuple[int, DataFrame]] = OrderedDict()
        self._learners: dict[str, Learner] = {}
        self._guard, self._active, self._closed = threading.RLock(), 0, False

    # collections
    def register(self, name: str, df: DataFrame, id: str | None = None) -> Engine:
        """Bind a DataFrame; ``id`` names the column that serves as object_id (it also stays a field)."""
        check_name(name)
        if D.ID not in df.columns:
            df = df.withColumn(D.ID, F.col(id).cast("long") if id else F.monotonically_increasing_id() + 1)
        self._registered[name.lower()] = df
        return self

    def load(self, name: str, df: DataFrame, id: str | None = None) -> int:
        """Append a DataFrame's rows as documents, without the driver seeing them; returns how many.

        ``id`` names a column of unique positive integers for object_id; else ids are unique, not dense.
        """
        store = self._locked(name)
        with store.lock():
            body = store.read()
            names = [f for f in df.columns if f != D.ID]
            ids = F.col(id).cast("long") if id else F.monotonically_increasing_id() + F.lit(body["next_id"])
            rows = df.select(ids.alias(D.ID), F.array().cast("array<string>").alias(D.NULLS), *[F.col(f"`{n}`") for n in names])
            old = T.StructType.fromJson(body["schema"])
            new = D.settle(D.merge(old, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])))
            parts = list(body["parts"])
            if parts and self._retyped(old, new):
                parts = [store.new_part(M.reshape(store.load(self.spark, body), new))]
            parts.append(store.new_part(M.reshape(rows, new)))
            made = self.spark.read.schema(new).parquet(str(store.dir / parts[-1])).agg(F.count(F.lit(1)), F.max(D.ID)).first()
            body = body | {"parts": parts, "schema": new.jsonValue(), "rows": body["rows"] + made[0], "next_id": max(body["next_id"], (made[1] or 0) + 1)}
            store.commit(body | {"history": self._history(body, new)}, body["version"])
        return made[0]

    def collections(self) -> list[str]:
        return sorted({*discover(self.root), *self._registered})

    def _store(self, name: str) -> Store:
        return Store(self.root, name, self.readonly, self.durable)

    def frame(self, name: str) -> DataFrame:
        """The current version of a collection as a DataFrame: object_id and its fields."""
        self._check_open()
        low = check_name(name).lower()
        if low in self._registered:
            return self._registered[low]
        store = self._store(name)
        body = store.read()
        store.lease(body)
        with self._guard:
            kept = self._open.get(low)
            if kept is None or kept[0] != body["version"]:
                kept = self._open[low] = (body["version"], store.load(self.spark, body))
            self._open.move_to_end(low)
            while len(self._open) > self.max_open:
                self._open.popitem(last=False)
        return kept[1]

    def _check_open(self) -> None:
        if self._closed:
            raise Closed("the engine is closed")

    # reading
    def compile(self, statement: str, params: Any = None) -> Plan:
        text = re.sub(r"^\s*find\s+", "SELECT * FROM ", statement, count=1, flags=re.I)
        s = S.parse_select(text)
        return compile_select(s, self.frame(s.collection), Bindings(params))

    def query(self, statement: str, params: Any = None) -> DataFrame:
        """A SELECT or FIND as a lazy DataFrame."""
        return self.compile(statement, params).df

    def execute(self, statement: str, params: Any = None, *, signal: Signal | None = None, timeout_ms: float | None = None, require_match: bool = False) -> Any:
        """Rows of a SELECT, documents of ``SELECT *`` and FIND, ids of a mutation (a ``Matched`` if they are many)."""
        self._check_open()
        if not isinstance(statement, str):
            raise InvalidOption("a statement is text")
        with self._guard:
            self._active += 1
        try:
            with scope(self.spark, signal, timeout_ms):
                return self._run(statement, params, require_match)
        finally:
            with self._guard:
                self._active -= 1

    def run(self, statement: str, params: Any = None, **options: Any) -> Outcome:
        try:
            return Outcome(True, self.execute(statement, params, **options))
        except DocsparkError as e:
            return Outcome(False, error=e)

    def _run(self, statement: str, params: Any, require_match: bool) -> Any:
        words = re.findall(r"[A-Za-z]+", statement[:200])[:2]
        first = words[0].lower() if words else ""
        if m := _WRITES.match(statement):
            kind = re.sub(r"\s+", " ", m[1].lower())
            if require_match and kind not in ("upsert into", "replace into"):
                raise InvalidOption("require_match goes with UPSERT INTO and REPLACE INTO")
            if self.readonly:
                raise ReadOnly("the engine is read-only")
            rest = statement[m.end() :]
            return {"insert into": self._insert, "update": self._update, "upsert into": self._upsert, "replace into": self._upsert, "unset": self._unset, "delete from": self._delete}[kind](rest, params, kind, require_match)
        if require_match:
            raise InvalidOption("require_match goes with UPSERT INTO and REPLACE INTO")
        if first in ("select", "find"):
            began = time.time()
            plan = self.compile(statement, params)
            rows = [self._decoder(plan)(r) for r in plan.df.collect()]
            self._learn(statement, plan, (time.time() - began) * 1000, len(rows))
            return rows
        if first == "query":
            return [D.plain(r) for r in self.raw(statement, params).collect()]
        raise SyntaxProblem(_GUIDANCE.get(first, f"unknown statement {first.upper()!r}"))

    def _decoder(self, plan: Plan):
        types = [o.type for o in plan.outputs]
        schema = plan.df.schema

        def row(r: T.Row) -> Any:
            if plan.documents:
                given = frozenset(r[D.NULLS] or ()) if D.NULLS in r else None
                out = {}
                for f, v in zip(schema, r, strict=True):
                    if f.name == D.ROOT:
                        if v is not None:
                            return D.decode(v, f.dataType)
                    elif f.name != D.NULLS and (v is not None or given is None or f.name in given):
                        out[f.name] = D.decode(v, f.dataType, given, f.name)
                return out
            out = {}
            for o, t, f, v in zip(plan.outputs, types, schema, r, strict=True):
                special = t is not None and (D.is_object(t) or D.is_array(t) or D.is_cell(t)) or D.is_cell(f.dataType) or D.is_array(f.dataType)
                x = D.decode(v, f.dataType, frozenset()) if special else v
                if D.is_cell(f.dataType):
                    x = int(x) if isinstance(x, bool) else D.millis(x) if isinstance(x, datetime) else str(int(x)) if isinstance(x, D.BigInt) else x
                out[o.name] = bytes(x) if isinstance(x, bytearray) else x
            return out

        return row

    def stream(self, statement: str, params: Any = None, *, batch_size: int = USUAL_BATCH, signal: Signal | None = None, timeout_ms: float | None = None) -> Iterator[list]:
        """Results of a SELECT or FIND in batches, pulled from one job over one version."""
        if not re.match(r"\s*(select|find)\b", statement, re.I):
            raise SyntaxProblem("only SELECT and FIND stream")
        plan = self.compile(statement, params)
        return batches(plan.df, self._decoder(plan), batch_size, signal, timeout_ms)

    def raw(self, statement: str, params: Any = None) -> DataFrame:
        """``QUERY ON c SELECT|WITH|EXPLAIN ...``: Spark SQL in which every collection is a view by its name."""
        m = re.match(r"\s*query\s+on\s+(?:\"([^\"]+)\"|([A-Za-z0-9_-]+))\s+((select|with|explain)\b.*)$", statement, re.I | re.S)
        if not m:
            raise SyntaxProblem("write QUERY ON collection SELECT ... or EXPLAIN ...")
        self.frame(m[1] or m[2])
        sql, args = m[3], params if isinstance(params, (list, dict)) else None if params is None else [params]
        if isinstance(args, dict):
            args, sql = {k.lstrip("$"): v for k, v in args.items()}, re.sub(r"\$(\w+)", r":\1", sql)
        names = {(m[1] or m[2]).lower(), *(n.lower() for n in self.collections())}
        for name in read_only(self.spark, sql, names):
            self.frame(name).createOrReplaceTempView(f"`{name}`")
        return self.spark.sql(sql, args=args)

    def bounded(self, statement: str, params: Any = None, limit: int = 500) -> tuple[list, bool]:
        """At most ``limit`` rows of one SELECT, and whether there were more."""
        if len(statement) > 100_000 or not 1 <= limit <= 10_000:
            raise InvalidOption("statements have up to 100,000 characters, limits are up to 10,000")
        plan = self.compile(statement, params)
        rows = plan.df.limit(limit + 1).collect()
        read = self._decoder(plan)
        return [read(r) for r in rows[:limit]], len(rows) > limit

    def list_documents(self, name: str, *, limit: int = 50, offset: int = 0) -> dict:
        """A page of documents by object_id, with the total."""
        df = self.frame(name)
        total = df.count()
        page = df.orderBy(D.ID).offset(offset).limit(limit)
        plan = compile_select(S.parse_select(f'SELECT * FROM "{name}"'), page, Bindings())
        read = self._decoder(plan)
        rows = page.collect()
        names = [f for f in page.columns if f != D.ID]
        docs = [{"object_id": r[D.ID], "document": read(T.Row(*names)(*[r[n] for n in names]))} for r in rows]
        return {"total": total, "has_more": offset + len(docs) < total, "documents": docs}

    # writing
    def _locked(self, name: str):
        if name.lower() in self._registered:
            raise ReadOnly(f"{name} is a registered DataFrame")
        return self._store(name)

    def _name_of(self, p: S.Parser) -> str:
        return p.collection()

    def _documents(self, payload: Any, many: bool = True) -> list:
        docs = payload if isinstance(payload, list) and many else [payload]
        for d in docs:
            D.check(d)
        return docs

    def _encode(self, docs: list, first: int, schema: T.StructType) -> list[tuple]:
        rows = []
        for i, d in enumerate(docs):
            body = d if isinstance(d, dict) else {D.ROOT: d}
            rows.append(tuple(first + i if f.name == D.ID else D.nulls(body) if f.name == D.NULLS else D.encode(body.get(f.name), f.dataType) for f in schema))
        return rows

    def _append(self, store: Store, body: dict, docs: list) -> tuple[dict, list[int]]:
        old = T.StructType.fromJson(body["schema"])
        new: T.DataType = old
        for d in docs:
            new = D.merge(new, D.infer(d if isinstance(d, dict) else {D.ROOT: d}))
        new = D.settle(new)
        parts = list(body["parts"])
        if parts and self._retyped(old, new):
            parts = [store.new_part(M.reshape(store.load(self.spark, body), new))]
        first = body["next_id"]
        parts.append(store.new_part(self.spark.createDataFrame(self._encode(docs, first, new), new).coalesce(1)))
        body = body | {"parts": parts, "schema": new.jsonValue(), "rows": body["rows"] + len(docs), "next_id": first + len(docs), "history": self._history(body, new)}
        return body, list(range(first, first + len(docs)))

    @staticmethod
    def _history(body: dict, schema: T.StructType) -> list[str]:
        return sorted({*body["history"], *(f.dotted for f in FieldCatalog(schema).fields)})

    @staticmethod
    def _retyped(a: T.DataType, b: T.DataType) -> bool:
        """Whether files written as ``a`` cannot be read as ``b``; added fields can."""
        if D.is_object(a) and D.is_object(b):
            return any(f.name in b.fieldNames() and Engine._retyped(f.dataType, b[f.name].dataType) for f in a)
        return a != b

    def _insert(self, rest: str, payload: Any, kind: str, _: bool) -> Any:
        p = S.Parser(rest)
        name = p.collection()
        p.done()
        docs = self._documents(payload)
        store = self._locked(name)
        if not docs:
            return []
        with store.lock():
            body = store.read()
            new, ids = self._append(store, body, docs)
            store.commit(new, body["version"])
        return ids if isinstance(payload, list) else ids[0]

    def _selector(self, p: S.Parser, name: str) -> S.Select:
        s = S.Select([], name)
        p.clauses(s, grouped=False)
        p.done()
        return s

    def _matched(self, df: DataFrame, s: S.Select, params: Any) -> tuple[Any, DataFrame]:
        """The rows a selector picks: a condition, and the table with it in reach."""
        sc = Scope(FieldCatalog(df.schema), s.collection, s.alias, Bindings(params))
        if not s.order and s.limit is None and s.offset is None:
            return (F.coalesce(V.condition(sc.value(s.where)), F.lit(False)) if s.where is not None else F.lit(True)), df
        s.items = [S.Item(S.Name((D.ID,)), "__hit", D.ID)]
        hits = compile_select(s, df, Bindings(params)).df
        both = df.join(hits, F.col(D.ID) == F.col("__hit"), "left")
        return F.col("__hit").isNotNull(), both

    def _change(self, name: str, s: S.Select, params: Any, edit, insert: list | None = None, removed: bool = False) -> list[dict] | Matched:
        """Commit a version in which ``edit(df, mask)`` replaces the rows; ids of the matched ones, which the driver
        holds only if they are few."""
        store = self._locked(name)
        with store.lock():
            body = store.read()
            df = store.load(self.spark, body)
            mask, reach = self._matched(df, s, params)
            ids = self._ids(store, reach.where(mask).select(D.ID))
            if not ids:
                if insert is None:
                    return []
                new, made = self._append(store, body, insert)
                store.commit(new, body["version"])
                return [{"object_id": i, "inserted": True} for i in made]
            out = edit(reach, mask, df)
            if "__hit" in out.columns:
                out = out.drop("__hit")
            new = body | {"parts": [store.new_part(out)], "schema": out.schema.jsonValue(), "rows": body["rows"] - (len(ids) if removed else 0)}
            new["history"] = self._history(new, out.schema)
            store.commit(new, body["version"])
        return ids

    def _ids(self, store: Store, hits: DataFrame) -> list[dict] | Matched:
        """Ids of the rows that a mutation picks; many are noted in a part of their own, which no version names, so
        that they are what the mutation saw, and a vacuum takes them."""
        if hits.count() <= MOST_BATCH:
            return [{"object_id": r[0]} for r in hits.orderBy(D.ID).collect()]
        part = store.new_part(hits)
        lease = lambda: store.lease({"parts": [part]})
        lease()
        noted = self.spark.read.schema(hits.schema).parquet(str(store.dir / part))
        return Matched(noted, noted.count(), lease)

    def _payload(self, payload: Any) -> dict:
        if isinstance(payload, (list, tuple)) or not isinstance(payload, dict):
            raise InvalidDocument("an update takes one object")
        D.check(payload)
        return payload

    def _update(self, rest: str, params: Any, kind: str, _: bool) -> list[dict] | Matched:
        p = S.Parser(rest)
        name = p.collection()
        if not p.accept("set"):
            s = self._selector(p, name)
            payload = self._payload(params)
            edits = {path: M.constant(v) for path, v in M.leaves(payload).items()}
            return self._change(name, s, params, lambda df, mask, _old: M.rewrite(df, mask, edits) if edits else df)
        sets: list[tuple[tuple[str, ...], Any]] = []
        while True:
            path = [p.identifier("field")]
            while p.accept("."):
                path.append(p.identifier("field"))
            p.expect("=")
            sets.append((tuple(path), p.expression()))
            if not p.accept(","):
                break
        s = self._selector(p, name)
        for path, _e in sets:
            for seg in path:
                D.check({seg: None})

        def edit(df: DataFrame, mask, old: DataFrame) -> DataFrame:
            catalog = FieldCatalog(old.schema)
            sc = Scope(catalog, name, None, Bindings(params))
            edits = {}
            for path, e in sets:
                path = sc.strip(path)
                found = catalog.resolve(".".join(path))
                edits[found[0].path if len(found) == 1 else path] = self._assigned(e, sc)
            return M.rewrite(df, mask, edits)

        return self._change(name, s, params, edit)

    @staticmethod
    def _assigned(e: Any, sc: Scope) -> tuple:
        """The right side of SET: parameters and single fields keep their type, expressions have SQL's."""
        if isinstance(e, S.Param):
            value = sc.bindings.get(e)
            D.check(value)
            return M.constant(value)
        if isinstance(e, S.Name) and not sc.is_id(e):
            found = sc.fields(e)
            if len(found) == 1:
                return column(found[0].path), found[0].type
        v = sc.value(e)
        types = {"int": T.LongType(), "bool": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "null": T.NullType(), "cell": D.CELL, "array": D.ARRAY}
        return V.output(v) if v.cls != "null" else F.lit(None), types[v.cls]

    def _upsert(self, rest: str, payload: Any, kind: str, require_match: bool) -> list[dict] | Matched:
        p = S.Parser(rest)
        name = p.collection()
        s = self._selector(p, name)
        if s.where is None:
            raise SyntaxProblem(f"{kind.upper()} needs WHERE")
        docs = self._documents(payload)
        params = payload if isinstance(payload, dict) else None

        def edit(df: DataFrame, mask, old: DataFrame) -> DataFrame:
            if isinstance(payload, list):
                raise InvalidDocument("a matched document takes one object")
            body = self._payload(payload)
            edits: dict = {}
            if kind == "replace into":
                edits = {f.path: M.DELETE for f in FieldCatalog(old.schema).top()}
                if D.ROOT in old.columns:
                    edits[(D.ROOT,)] = M.DELETE
                edits |= {(k,): M.constant(v) for k, v in body.items()}
            else:
                edits = {path: M.constant(v) for path, v in M.leaves(body).items()}
            return M.rewrite(df, mask, edits) if edits else df

        return self._change(name, s, params, edit, insert=None if require_match else docs)

    def _unset(self, rest: str, params: Any, kind: str, _: bool) -> list[dict] | Matched:
        p = S.Parser(rest)
        targets: list[Any] = []
        while True:
            wild = p.wildcard()
            if wild is not None and not wild.parts:
                raise UnsupportedSyntax("UNSET * would remove whole documents; use DELETE FROM")
            targets.append(wild if wild is not None else p.primary())
            if not p.accept(","):
                break
        p.expect("from")
        name = p.collection()
        s = self._selector(p, name)

        def edit(df: DataFrame, mask, old: DataFrame) -> DataFrame:
            catalog = FieldCatalog(old.schema)
            sc = Scope(catalog, name, None, Bindings(params))
            paths = set()
            for t in targets:
                if isinstance(t, S.Wild):
                    paths |= {f.path for f in catalog.children(".".join(sc.strip(t.parts)), t.deep)}
                elif isinstance(t, S.Name):
                    if len(t.parts) == 1 and t.parts[0].lower() == name.lower() and not catalog.resolve(t.parts[0]):
                        raise SyntaxProblem("UNSET takes fields, not the collection")
                    paths |= {f.path for f in sc.fields(t)}
                else:
                    raise SyntaxProblem("UNSET takes fields")
            paths = {x for x in paths if not any(x[:i] in paths for i in range(1, len(x)))}
            return M.rewrite(df, mask, {x: M.DELETE for x in paths}) if paths else df

        return self._change(name, s, params, edit)

    def _delete(self, rest: str, params: Any, kind: str, _: bool) -> list[dict] | Matched:
        p = S.Parser(rest)
        name = p.collection()
        s = self._selector(p, name)
        return self._change(name, s, params, lambda df, mask, _old: df.where(~mask), removed=True)

    # structure, layout and upkeep
    def structure(self, name: str, path: str | None = None) -> Structure:
        return structure(self.frame(name), name, path, frozenset(self._laid_out(name)))

    def _laid_out(self, name: str) -> list[str]:
        return [] if name.lower() in self._registered else self._store(name).read()["layout_paths"]

    def _learner(self, name: str) -> Learner:
        low = name.lower()
        if low not in self._learners:
            self._learners[low] = Learner() if low in self._registered else Learner(self._store(name).read()["learner"])
        return self._learners[low]

    def _learn(self, statement: str, plan: Plan, ms: float, rows: int) -> None:
        m = re.search(r"\bfrom\s+\"?([A-Za-z0-9_-]+)|^\s*find\s+\"?([A-Za-z0-9_-]+)", statement, re.I)
        if not m or not plan.used:
            return
        name = m[1] or m[2]
        learner = self._learner(name)
        learner.record(plan.used, ms, rows, time.time() * 1000)
        if self.policy.mode == "auto" and learner.since >= (self.policy.auto or PRESETS["balanced"])["evaluation_interval"]:
            self.evaluate(name)

    def evaluate(self, name: str) -> dict:
        """What the learner makes of the queries so far. Its action is taken (the next compaction lays out
        accordingly) and its state stored; reading engines and registered frames only learn in memory."""
        learner, now, stored = self._learner(name), time.time() * 1000, name.lower() not in self._registered
        plan = learner.plan(self.policy, name, self._store(name).read()["rows"] if stored else 0, now)
        learner.apply(plan["action"], now)
        if stored and not self.readonly:
            store = self._store(name)
            with store.lock():
                body = store.read()
                if body["version"]:
                    store.commit(body | {"learner": learner.state()}, body["version"])
        return plan

    def optimize(self, name: str, *, dry_run: bool = False) -> dict:
        """Propose a layout change from what queries did, and, unless ``dry_run``, take it and compact."""
        learner, now = self._learner(name), time.time() * 1000
        documents = self.frame(name).count() if name.lower() in self._registered else self._store(name).read()["rows"]
        plan = learner.plan(self.policy, name, documents, now)
        if not dry_run and name.lower() not in self._registered:
            learner.apply(plan["action"], now)
            self.vacuum(name)
        return plan

    def vacuum(self, name: str) -> dict:
        """Rewrite a collection as one compact part, laid out for its paths, and delete the parts whose lease is over."""
        store = self._locked(name)
        with store.lock():
            body = store.read()
            learner = self._learner(name)
            df = store.load(self.spark, body)
            fields = {f.dotted: f for f in FieldCatalog(df.schema).fields if not D.is_object(f.type) and not D.is_cell(f.type) and not D.is_array(f.type)}
            wanted = [p for p in fields if p in learner.managed or self.policy.decision(name, p) == "enabled" and self.policy.rules]
            options = {}
            for p in wanted:
                options[f"parquet.bloom.filter.enabled#{p}"] = "true"
            if wanted:
                df = df.sortWithinPartitions(*[column(fields[p].path) for p in wanted[:3]])
            new = body | {"parts": [store.new_part(df, options)] if body["parts"] else [], "layout_paths": wanted, "learner": learner.state()}
            store.commit(new, body["version"])
            removed, leased = store.sweep(new, self.lease_s)
            return {"removed": removed, "leased": leased} | store.sizes(new)

    def analyze(self, name: str) -> dict:
        """Row count and, by path, how many values it has: one job."""
        s = self.structure(name)
        return {"documents": s.documents, "fields": s.fields, "max_depth": s.max_depth}

    def storage_stats(self, name: str | None = None) -> dict:
        names = [name] if name else discover(self.root)
        return {n: self._store(n).sizes(self._store(n).read()) for n in names}

    def diagnostics(self) -> dict:
        self._check_open()
        return {"path": str(self.root), "mode": "readonly" if self.readonly else "readwrite", "open": list(self._open), "max_open": self.max_open, "active": self._active, "collections": self.collections()}

    def refresh(self) -> list[str]:
        with self._guard:
            self._open.clear()
        return self.collections()

    def backup(self, target: str, *, overwrite: bool = False) -> dict:
        """Copy every stored collection's current version, held still by their locks."""
        self._check_open()
        stores = [self._store(n) for n in discover(self.root)]
        held = []
        try:
            for s in stores:
                if not s.readonly:
                    lock = s.lock()
                    lock.__enter__()
                    held.append(lock)
            return write_backup(self.root, target, {s.dir.name: s.read() for s in stores}, overwrite)
        finally:
            for lock in reversed(held):
                lock.__exit__(None, None, None)

    def close(self) -> None:
        """Terminal and idempotent; waits for what runs."""
        while True:
            with self._guard:
                if not self._active:
                    self._closed = True
                    self._open.clear()
                    break
            time.sleep(0.05)
        if self._temp:
            self._temp.cleanup()
            self._temp = None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class QueryBuilder:
    """A statement from checked parts: fields, filters, order and a limit."""

    OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "LIKE", "IS NULL", "IS NOT NULL")

    def __init__(self, collection: str) -> None:
        self.collection, self.fields, self.filters, self.sort, self.params, self._limit = check_name(collection), [], [], [], [], 100

    @staticmethod
    def quote(path: str) -> str:
        return ".".join('"' + p.replace('"', '""') + '"' for p in path.split("."))

    def select(self, *paths: str) -> QueryBuilder:
        self.fields += [self.quote(p) for p in paths]
        return self

    def where(self, path: str, operator: str, value: Any = None) -> QueryBuilder:
        if operator not in self.OPERATORS:
            raise InvalidOption(f"operator {operator!r}")
        if operator.startswith("IS"):
            self.filters.append(f"{self.quote(path)} {operator}")
        else:
            self.filters.append(f"{self.quote(path)} {operator} ?")
            self.params.append(value)
        return self

    def order(self, path: str, descending: bool = False) -> QueryBuilder:
        self.sort.append(self.quote(path) + (" DESC" if descending else ""))
        return self

    def limit(self, n: int) -> QueryBuilder:
        if not 1 <= n <= 500:
            raise InvalidOption("a limit is 1 to 500")
        self._limit = n
        return self

    def build(self) -> tuple[str, list]:
        text = f'SELECT {", ".join(self.fields) or "*"} FROM "{self.collection}"'
        if self.filters:
            text += " WHERE " + " AND ".join(self.filters)
        if self.sort:
            text += " ORDER BY " + ", ".join(self.sort)
        return f"{text} LIMIT {self._limit}", self.params



"""Fields of a collection and how names in statements find them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .types import ID, NULLS, ROOT, is_object

_HIDDEN = {ID, NULLS, ROOT, "__empty"}


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]
    type: T.DataType

    @property
    def name(self) -> str:
        return self.path[-1]

    @property
    def dotted(self) -> str:
        return ".".join(self.path)


class FieldCatalog:
    """Every path of a schema. Exact paths win, then paths in any case, then leaf names at any depth."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema
        self.fields: list[Field] = []
        self._walk(schema, ())
        self.by_path = {f.dotted: f for f in self.fields}
        names: dict[str, int] = {}
        for f in self.fields:
            names[f.name.lower()] = names.get(f.name.lower(), 0) + 1
        self._repeated = {n for n, k in names.items() if k > 1}

    def _walk(self, t: T.StructType, at: tuple[str, ...]) -> None:
        for f in t:
            if f.name in _HIDDEN:
                continue
            self.fields.append(Field((*at, f.name), f.dataType))
            if is_object(f.dataType):
                self._walk(f.dataType, (*at, f.name))

    def resolve(self, name: str) -> list[Field]:
        if name in self.by_path:
            return [self.by_path[name]]
        low = name.lower()
        if same := [f for f in self.fields if f.dotted.lower() == low]:
            return same[:1]
        if "." in name:
            return []
        return [f for f in self.fields if f.name == name] or [f for f in self.fields if f.name.lower() == low]

    def alias(self, field: Field) -> str:
        return field.dotted if field.name.lower() in self._repeated else field.name

    def top(self) -> list[Field]:
        return [f for f in self.fields if len(f.path) == 1]

    def children(self, name: str, deep: bool) -> list[Field]:
        base = self.resolve(name)
        if not base:
            return []
        p = base[0].path
        return [f for f in self.fields if f.path[: len(p)] == p and (len(f.path) > len(p) if deep else len(f.path) == len(p) + 1)]

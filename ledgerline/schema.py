"""Tables, columns and constraints; all driver-side and immutable."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import TypeMismatch, quoted

TEXT, INTEGER, BOOLEAN = "TEXT", "INTEGER", "BOOLEAN"
SPARK_TYPES = {TEXT: T.StringType(), INTEGER: T.LongType(), BOOLEAN: T.BooleanType()}
TAGS = {TEXT: "T", INTEGER: "I", BOOLEAN: "B"}
RID = "__rid"
RESTRICT, CASCADE, SET_NULL = "RESTRICT", "CASCADE", "SET NULL"


class _NoDefault:
    def __repr__(self) -> str:
        return "NO_DEFAULT"

    def __reduce__(self):
        return "NO_DEFAULT"


#: No default at all, which is another state than DEFAULT NULL.
NO_DEFAULT = _NoDefault()


def type_of(value: Any) -> str:
    """The dialect's type of a literal; NULL is one of its own."""
    return "NULL" if value is None else BOOLEAN if isinstance(value, bool) else INTEGER if isinstance(value, int) else TEXT


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: Any = NO_DEFAULT

    def checked(self, value: Any) -> Any:
        """`value`, if the column may hold it; there are no casts."""
        if value is None:
            if not self.nullable:
                raise TypeMismatch(f"column {quoted(self.name)} is NOT NULL")
        elif type_of(value) != self.type:
            raise TypeMismatch(f"column {quoted(self.name)} expects {self.type}, got {type_of(value)}")
        return value


@dataclass(frozen=True)
class ForeignKey:
    column: int
    table: str
    target: str
    on_delete: str = RESTRICT
    on_update: str = RESTRICT


@dataclass(frozen=True)
class Leaf:
    """column <op> value; `value` is a literal, a list for IN, LIKE atoms, or None for IS [NOT] NULL."""

    column: tuple[int, int]
    op: str
    value: Any = None


@dataclass(frozen=True)
class Node:
    """AND or OR over two children or more."""

    op: str
    children: tuple[Any, ...]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: int | None = None
    unique: tuple[int, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Any, ...] = ()
    auto_increment: int | None = None
    last: int = 0

    def index(self, name: str) -> int | None:
        return next((i for i, c in enumerate(self.columns) if c.name == name), None)

    @property
    def struct(self) -> T.StructType:
        """The hidden row number, then c0, c1, ...; nullability is the catalog's, not Spark's."""
        return T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(f"c{i}", SPARK_TYPES[c.type]) for i, c in enumerate(self.columns))])

    def advanced(self, key: int) -> Table:
        return replace(self, last=max(self.last, key))


@dataclass
class Catalog:
    """Tables in creation order, and the storage format version, which only grows."""

    tables: dict[str, Table] = field(default_factory=dict)
    version: int = 2

    def copy(self) -> Catalog:
        return Catalog(dict(self.tables), self.version)

    def upgraded(self) -> None:
        for t in self.tables.values():
            if t.checks or t.unique or any(c.default is not NO_DEFAULT for c in t.columns) or any((f.on_delete, f.on_update) != (RESTRICT, RESTRICT) for f in t.foreign_keys):
                self.version = 3

    def inbound(self, name: str) -> list[tuple[Table, ForeignKey]]:
        """Foreign keys that point at a table, by child table in creation order and column."""
        return [(t, f) for t in self.tables.values() for f in t.foreign_keys if f.table == name]

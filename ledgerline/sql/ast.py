"""Statements as parsed, before any name is resolved."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Name:
    """A column as written: with the table's name before it, or bare."""

    table: str | None
    column: str


@dataclass(frozen=True)
class Predicate:
    column: Name
    op: str
    value: Any = None

    @property
    def units(self) -> int:
        return len(self.value) if self.op == "IN" else 1


@dataclass(frozen=True)
class Group:
    """AND or OR, flattened: no child is a group of the same kind."""

    op: str
    children: tuple[Any, ...]

    @property
    def units(self) -> int:
        return sum(c.units for c in self.children)


@dataclass(frozen=True)
class Star:
    table: str | None


@dataclass(frozen=True)
class Join:
    table: str
    conditions: tuple[tuple[Name, Name], ...]


@dataclass(frozen=True)
class Select:
    table: str
    joins: tuple[Join, ...]
    items: tuple[Name | Star, ...]
    where: Any
    order: tuple[tuple[Name, bool], ...]
    limit: int | None
    offset: int | None


@dataclass(frozen=True)
class CreateTable:
    """`elements` in order: ("column", name, type, modifiers), ("primary_key", name), ("unique", name), ("foreign_key", name, reference), ("check", expression)."""

    table: str
    elements: tuple[tuple, ...]


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    on_delete: str
    on_update: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Any], ...]
    where: Any


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class ShowCreate:
    table: str


@dataclass(frozen=True)
class Describe:
    table: str


@dataclass(frozen=True)
class ExplainSelect:
    select: Select

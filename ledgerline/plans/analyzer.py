"""Names and types. The order of the checks decides which of several errors is reported."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from .. import limits as L
from ..errors import SchemaError, TypeMismatch, quoted
from ..functions.predicates import like_atoms
from ..results import ResultColumn
from ..schema import INTEGER, NO_DEFAULT, SET_NULL, TEXT, Catalog, Column, ForeignKey, Leaf, Node, Table, type_of
from ..sql import ast as A

NULL_EQUAL = "NULL cannot be compared with `=` or `!=`; use IS NULL or IS NOT NULL"
NULL_ORDER = "NULL cannot be compared with `<`, `<=`, `>`, or `>=`; use IS NULL or IS NOT NULL"
NULL_CHECK = "NULL cannot be used as a comparison operand; use IS NULL or IS NOT NULL"


@dataclass(frozen=True)
class ResolvedSelect:
    sources: tuple[Table, ...]
    items: tuple[tuple[int, int], ...]
    joins: tuple[tuple[tuple[tuple[int, int], tuple[int, int]], ...], ...]
    where: Any
    order: tuple[tuple[tuple[int, int], bool], ...]
    limit: int | None
    offset: int | None

    @property
    def columns(self) -> list[ResultColumn]:
        out = []
        for s, c in self.items:
            t = self.sources[s]
            out.append(ResultColumn(t.columns[c].name, t.name, t.columns[c].name, t.columns[c].type, t.columns[c].nullable))
        return out


def table(catalog: Catalog, name: str) -> Table:
    if name not in catalog.tables:
        raise SchemaError(f"unknown table {quoted(name)}")
    return catalog.tables[name]


def column(sources: tuple[Table, ...], name: A.Name) -> tuple[int, int]:
    if name.table is not None:
        for s, t in enumerate(sources):
            if t.name == name.table:
                c = t.index(name.column)
                if c is None:
                    raise SchemaError(f"unknown column {quoted(name.column)} in table {quoted(t.name)}")
                return s, c
        if len(sources) == 1:
            raise SchemaError(f"unknown table qualifier {quoted(name.table)} for table {quoted(sources[0].name)}")
        raise SchemaError(f"unknown table qualifier {quoted(name.table)}")
    found = [(s, c) for s, t in enumerate(sources) if (c := t.index(name.column)) is not None]
    if len(found) > 1:
        raise SchemaError(f"ambiguous column {quoted(name.column)}; qualify it with a table name")
    if not found:
        where = f" in table {quoted(sources[0].name)}" if len(sources) == 1 else ""
        raise SchemaError(f"unknown column {quoted(name.column)}{where}")
    return found[0]


def predicate(sources: tuple[Table, ...], p: A.Predicate) -> Leaf:
    at = column(sources, p.column)
    c = sources[at[0]].columns[at[1]]
    if p.op in ("=", "!=", "<", "<=", ">", ">="):
        if p.value is None:
            raise TypeMismatch(NULL_EQUAL if p.op in ("=", "!=") else NULL_ORDER)
        return Leaf(at, p.op, c.checked(p.value))
    if p.op == "LIKE":
        if c.type != TEXT:
            raise TypeMismatch(f"LIKE requires a TEXT column; {quoted(c.name)} is {c.type}")
        return Leaf(at, p.op, like_atoms(p.value))
    if p.op == "IN":
        return Leaf(at, p.op, tuple(None if v is None else c.checked(v) for v in p.value))
    return Leaf(at, p.op)


def expression(x: Any, leaf) -> Any:
    if isinstance(x, A.Group):
        return Node(x.op, tuple(expression(c, leaf) for c in x.children))
    return leaf(x)


def where(sources: tuple[Table, ...], x: Any, limits: L.Limits) -> Any:
    if x is None:
        return None
    L.check(x.units, limits.max_predicates, L.WHERE_PREDICATES)
    return expression(x, lambda p: predicate(sources, p))


def select(catalog: Catalog, s: A.Select, limits: L.Limits) -> ResolvedSelect:
    L.check(1 + len(s.joins), limits.max_join_sources, L.JOIN_SOURCES)
    sources: list[Table] = []
    for name in (s.table, *(j.table for j in s.joins)):
        if any(t.name == name for t in sources):
            raise SchemaError(f"table {quoted(name)} appears more than once in a SELECT")
        sources.append(table(catalog, name))
    found = tuple(sources)
    items: list[tuple[int, int]] = []
    for item in s.items:
        if isinstance(item, A.Name):
            items.append(column(found, item))
            continue
        at = [k for k, t in enumerate(found) if item.table in (None, t.name)]
        if not at:
            raise SchemaError(f"unknown table qualifier {quoted(item.table)} in projection")
        items += [(k, c) for k in at for c in range(len(found[k].columns))]
    joins = []
    for k, join in enumerate(s.joins, 1):
        visible, conditions, connected = found[: k + 1], [], False
        for a, b in join.conditions:
            left, right = column(visible, a), column(visible, b)
            x, y = (visible[i].columns[c] for i, c in (left, right))
            if x.type != y.type:
                names = [f"{quoted(visible[i].name)}.{quoted(visible[i].columns[c].name)}" for i, c in (left, right)]
                raise TypeMismatch(f"JOIN columns {names[0]} and {names[1]} have different types")
            connected |= (left[0] == k) != (right[0] == k)
            conditions.append((left, right))
        if not connected:
            raise SchemaError(f"JOIN for table {quoted(join.table)} must connect it to an earlier table")
        joins.append(tuple(conditions))
    condition = where(found, s.where, limits)
    order = tuple((column(found, n), ascending) for n, ascending in s.order)
    out = ResolvedSelect(found, tuple(items), tuple(joins), condition, order, s.limit, s.offset)
    L.check(sum(len(c.label.encode()) for c in out.columns), limits.max_query_output_bytes, L.QUERY_OUTPUT_BYTES)
    return out


# -- statements that change data


def insert(t: Table, s: A.Insert) -> tuple[list[Any], Table]:
    """The row, and the table with its sequence advanced."""
    from ..errors import ConstraintError

    if s.columns is None:
        if len(s.values) != len(t.columns):
            raise TypeMismatch(f"table {quoted(t.name)} expects {len(t.columns)} values, got {len(s.values)}")
        row = list(s.values)
        given = set(range(len(row)))
    else:
        if len(s.columns) != len(s.values):
            raise TypeMismatch(f"INSERT names {len(s.columns)} columns but supplies {len(s.values)} values")
        row = [None if c.default is NO_DEFAULT else c.default for c in t.columns]
        given = set()
        for name, value in zip(s.columns, s.values, strict=True):
            i = t.index(name)
            if i is None:
                raise SchemaError(f"unknown column {quoted(name)} in table {quoted(t.name)}")
            if i in given:
                raise SchemaError(f"duplicate INSERT column {quoted(name)}")
            given.add(i)
            row[i] = value
    k = t.auto_increment
    if k is not None and row[k] is None:
        if t.last == (1 << 63) - 1:
            raise ConstraintError(f"auto-increment sequence for table {quoted(t.name)} is exhausted")
        row[k] = t.last + 1
    for c, value in zip(t.columns, row, strict=True):
        c.checked(value)
    if k is not None:
        t = t.advanced(row[k])
    return row, t


def assignments(t: Table, s: A.Update) -> dict[int, Any]:
    out: dict[int, Any] = {}
    for name, value in s.assignments:
        i = t.index(name)
        if i is None:
            raise SchemaError(f"unknown column {quoted(name)} in table {quoted(t.name)}")
        if i in out:
            raise SchemaError(f"duplicate UPDATE assignment for column {quoted(name)}")
        out[i] = t.columns[i].checked(value)
    return out


# -- CREATE TABLE


def _check_leaf(t: Table, p: A.Predicate) -> Leaf:
    if p.column.table is not None:
        raise SchemaError(f"CHECK references must be unqualified local columns; {quoted(p.column.column)} is qualified")
    i = t.index(p.column.column)
    if i is None:
        raise SchemaError(f"CHECK references unknown column {quoted(p.column.column)} in table {quoted(t.name)}")
    c = t.columns[i]

    def typed(value: Any) -> Any:
        if value is not None and type_of(value) != c.type:
            raise TypeMismatch(f"CHECK column {quoted(c.name)} expects {c.type}, got {type_of(value)}")
        return value

    if p.op in ("=", "!=", "<", "<=", ">", ">="):
        if p.value is None:
            raise TypeMismatch(NULL_CHECK)
        return Leaf((0, i), p.op, typed(p.value))
    if p.op == "LIKE":
        if c.type != TEXT:
            raise TypeMismatch(f"LIKE requires a TEXT column; {quoted(c.name)} is {c.type}")
        return Leaf((0, i), p.op, like_atoms(p.value))
    return Leaf((0, i), p.op, tuple(map(typed, p.value)) if p.op == "IN" else None)


def create(catalog: Catalog, s: A.CreateTable, limits: L.Limits) -> Table:
    if s.table in catalog.tables:
        raise SchemaError(f"table {quoted(s.table)} already exists")
    columns: list[Column] = []
    for e in s.elements:
        if e[0] == "column":
            if any(c.name == e[1] for c in columns):
                raise SchemaError(f"duplicate column name {quoted(e[1])}")
            columns.append(Column(e[1], e[2]))
    if not columns:
        raise SchemaError("table must contain at least one column")
    t = Table(s.table, tuple(columns))
    primary: int | None = None
    not_null: set[int] = set()
    unique: set[int] = set()
    foreign: dict[int, ForeignKey] = {}
    checks: list[Any] = []
    used = 0
    automatic: int | None = None

    def at(name: str, what: str) -> int:
        i = t.index(name)
        if i is None:
            raise SchemaError(f"{what} references unknown column {quoted(name)} in table {quoted(t.name)}")
        return i

    def set_primary(i: int) -> None:
        nonlocal primary
        if primary == i:
            raise SchemaError(f"duplicate PRIMARY KEY declaration for column {quoted(columns[i].name)}")
        if primary is not None:
            raise SchemaError(f"table {quoted(t.name)} may have only one PRIMARY KEY column")
        primary = i

    def set_unique(i: int) -> None:
        if i in unique:
            raise SchemaError(f"duplicate UNIQUE declaration for column {quoted(columns[i].name)}")
        unique.add(i)

    def set_foreign(i: int, r: A.Reference, what: str) -> None:
        if i in foreign:
            raise SchemaError(f"duplicate {what} declaration for column {quoted(columns[i].name)}")
        foreign[i] = ForeignKey(i, r.table, r.column, r.on_delete, r.on_update)

    def add_check(x: Any) -> None:
        nonlocal used
        used += x.units
        L.check(used, limits.max_predicates, L.CHECK_PREDICATES)
        checks.append(expression(x, lambda p: _check_leaf(t, p)))

    position = -1
    for e in s.elements:
        if e[0] == "column":
            position += 1
            i = position
            for m in e[3]:
                name = columns[i].name
                if m[0] == "not_null":
                    if i in not_null:
                        raise SchemaError(f"duplicate NOT NULL declaration for column {quoted(name)}")
                    not_null.add(i)
                elif m[0] == "primary_key":
                    set_primary(i)
                elif m[0] == "unique":
                    set_unique(i)
                elif m[0] == "references":
                    set_foreign(i, m[1], "REFERENCES")
                elif m[0] == "auto_increment":
                    if automatic == i:
                        raise SchemaError(f"duplicate AUTOINCREMENT declaration for column {quoted(name)}")
                    if automatic is not None:
                        raise SchemaError(f"table {quoted(t.name)} may have only one auto-increment column")
                    automatic = i
                elif m[0] == "default":
                    if columns[i].default is not NO_DEFAULT:
                        raise SchemaError(f"duplicate DEFAULT declaration for column {quoted(name)}")
                    if m[1] is not None:
                        columns[i].checked(m[1])
                    columns[i] = replace(columns[i], default=m[1])
                else:
                    add_check(m[1])
        elif e[0] == "primary_key":
            set_primary(at(e[1], "PRIMARY KEY"))
        elif e[0] == "unique":
            set_unique(at(e[1], "UNIQUE"))
        elif e[0] == "foreign_key":
            set_foreign(at(e[1], "FOREIGN KEY"), e[2], "FOREIGN KEY")
        else:
            add_check(e[1])
    if primary is not None:
        not_null.add(primary)
    columns = [replace(c, nullable=i not in not_null) for i, c in enumerate(columns)]
    for i, c in enumerate(columns):
        if c.default is None and not c.nullable:
            raise SchemaError(f"DEFAULT NULL is invalid for NOT NULL column {quoted(t.name)}.{quoted(c.name)}")
    if automatic is not None:
        c = columns[automatic]
        if primary != automatic or c.type != INTEGER:
            raise SchemaError(f"auto-increment column {quoted(t.name)}.{quoted(c.name)} must be its INTEGER primary key")
        if c.default is not NO_DEFAULT:
            raise SchemaError(f"auto-increment column {quoted(t.name)}.{quoted(c.name)} cannot have a DEFAULT")
    out = Table(t.name, tuple(columns), primary, tuple(sorted(unique - {primary})), tuple(foreign[i] for i in sorted(foreign)), tuple(checks), automatic)
    for f in out.foreign_keys:
        c = columns[f.column]
        if f.on_delete == SET_NULL and not c.nullable:
            raise SchemaError(f"ON DELETE SET NULL requires nullable foreign-key column {quoted(t.name)}.{quoted(c.name)}")
        parent = out if f.table == out.name else catalog.tables.get(f.table)
        if parent is None:
            raise SchemaError(f"foreign key references unknown or later table {quoted(f.table)}")
        k = parent.index(f.target)
        if k is None or parent.primary_key != k:
            raise SchemaError(f"foreign key target {quoted(f.table)}.{quoted(f.target)} is not its table's primary key")
        if parent.columns[k].type != c.type:
            raise SchemaError(f"foreign-key columns {quoted(t.name)}.{quoted(c.name)} and {quoted(f.table)}.{quoted(f.target)} have different types")
    return out


__all__ = ["ResolvedSelect", "assignments", "create", "insert", "select", "table", "where"]

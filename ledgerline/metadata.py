"""SHOW TABLES, DESCRIBE and SHOW CREATE TABLE: rows the driver makes from the catalog."""

from __future__ import annotations

from typing import Any

from .functions.predicates import like_text
from .results import ResultColumn, RowSet
from .schema import BOOLEAN, NO_DEFAULT, TEXT, Catalog, Node, Table
from .sql.lexer import RESERVED

TABLES, COLUMNS = "information_schema.tables", "information_schema.columns"


def literal(value: Any) -> str:
    """A value as SQL that parses back to it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def identifier(name: str) -> str:
    return f'"{name}"' if name.upper() in RESERVED else name


def check_text(t: Table, x: Any) -> str:
    """Each group of AND or OR in its own parentheses."""
    if isinstance(x, Node):
        return "(" + f" {x.op} ".join(check_text(t, c) for c in x.children) + ")"
    name = identifier(t.columns[x.column[1]].name)
    if x.op in ("IS NULL", "IS NOT NULL"):
        return f"{name} {x.op}"
    if x.op == "LIKE":
        return f"{name} LIKE {literal(like_text(x.value))}"
    return f"{name} IN ({', '.join(map(literal, x.value))})" if x.op == "IN" else f"{name} {x.op} {literal(x.value)}"


def create_statement(t: Table) -> str:
    parts = []
    for i, c in enumerate(t.columns):
        words = [identifier(c.name), c.type]
        words += ["NOT NULL"] * (not c.nullable) + ["PRIMARY KEY"] * (t.primary_key == i) + ["AUTOINCREMENT"] * (t.auto_increment == i) + ["UNIQUE"] * (i in t.unique)
        if c.default is not NO_DEFAULT:
            words.append(f"DEFAULT {literal(c.default)}")
        words += [f"REFERENCES {identifier(f.table)}({identifier(f.target)}) ON DELETE {f.on_delete} ON UPDATE {f.on_update}" for f in t.foreign_keys if f.column == i]
        parts.append(" ".join(words))
    parts += [f"CHECK ({check_text(t, x)})" for x in t.checks]
    return f"CREATE TABLE {identifier(t.name)} ({', '.join(parts)})"


def show_tables(catalog: Catalog) -> RowSet:
    return RowSet([ResultColumn("table_name", TABLES, "table_name", TEXT, False)], None, [(n,) for n in catalog.tables])


def describe(t: Table) -> RowSet:
    names = [("column_name", TEXT), ("data_type", TEXT), ("nullable", BOOLEAN), ("primary_key", BOOLEAN), ("unique", BOOLEAN), ("default_value", TEXT), ("auto_increment", BOOLEAN)]
    rows = []
    for i, c in enumerate(t.columns):
        key = t.primary_key == i
        rows.append((c.name, c.type, c.nullable, key, key or i in t.unique, None if c.default is NO_DEFAULT else literal(c.default), t.auto_increment == i))
    return RowSet([ResultColumn(n, COLUMNS, n, k, n == "default_value") for n, k in names], None, rows)


def show_create(t: Table) -> RowSet:
    return RowSet([ResultColumn(n, TABLES, n, TEXT, False) for n in ("table_name", "create_statement")], None, [(t.name, create_statement(t))])

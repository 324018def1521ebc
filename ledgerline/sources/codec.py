"""The one-string format: every record ends in a semicolon, text cells escape the characters that delimit.

Header ``V2;`` or ``V3;``, then each table's records in the order schema, primary key, foreign keys, sequence,
defaults, unique columns, checks; then all rows in insertion order. Encoding is canonical: one database, one string.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import replace
from typing import Any

from ..errors import CorruptStorage, quoted
from ..functions.predicates import ANY, ONE
from ..schema import BOOLEAN, CASCADE, INTEGER, NO_DEFAULT, RESTRICT, SET_NULL, TAGS, TEXT, Catalog, Column, ForeignKey, Leaf, Node, Table

TYPES = {v: k for k, v in TAGS.items()}
ACTIONS = {RESTRICT: "R", CASCADE: "C", SET_NULL: "N"}
OPCODES = {"=": "EQ", "!=": "NE", "<": "LT", "<=": "LE", ">": "GT", ">=": "GE", "LIKE": "LIKE", "IS NULL": "ISNULL", "IS NOT NULL": "NOTNULL", "IN": "IN"}
OPERATORS = {v: k for k, v in OPCODES.items()}
NAME = re.compile(r"[a-z_][a-z0-9_]*\Z")
NUMBER = re.compile(r"(?:0|-?[1-9][0-9]*)\Z")
COUNT = re.compile(r"(?:0|[1-9][0-9]*)\Z")
#: Characters that text cells escape: delimiters, line separators, control characters. As a Java and Python class.
ESCAPE_CLASS = "[%~|;\u2028\u2029\x00-\x1f\x7f-\x9f]"
_ESCAPE = re.compile(ESCAPE_CLASS)


def escaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"%{ord(m[0]):06X}", text)


def must_escape(c: str) -> bool:
    return c in "%~|;\u2028\u2029" or unicodedata.category(c) == "Cc"


def cell(value: Any, column: Column) -> str:
    if value is None:
        return "N"
    return {TEXT: lambda: "T" + escaped(value), INTEGER: lambda: f"I{value}", BOOLEAN: lambda: f"B{int(value)}"}[column.type]()


# -- writing


def encoded_check(t: Table, x: Any) -> str:
    out: list[str] = []

    def walk(x: Any) -> None:
        if isinstance(x, Node):
            out.extend((x.op, str(len(x.children))))
            for c in x.children:
                walk(c)
            return
        i = x.column[1]
        out.extend((OPCODES[x.op], str(i)))
        if x.op == "LIKE":
            out.append(str(len(x.value)))
            out.extend("M" if a == ANY else "S" if a == ONE else "L" + escaped(a[0]) for a in x.value)
        elif x.op == "IN":
            out.append(str(len(x.value)))
            out.extend(cell(v, t.columns[i]) for v in x.value)
        elif x.op not in ("IS NULL", "IS NOT NULL"):
            out.append(cell(x.value, t.columns[i]))

    walk(x)
    return "|".join(out)


def encoded_table(t: Table) -> str:
    name = lambda i: t.columns[i].name
    out = [f"~S|{t.name}|" + "|".join(f"{c.name}:{TAGS[c.type]}:{'?' if c.nullable else '!'}" for c in t.columns)]
    if t.primary_key is not None:
        out.append(f"~P|{t.name}|{name(t.primary_key)}")
    for f in t.foreign_keys:
        actions = "" if (f.on_delete, f.on_update) == (RESTRICT, RESTRICT) else f"|{ACTIONS[f.on_delete]}|{ACTIONS[f.on_update]}"
        out.append(f"~F|{t.name}|{name(f.column)}|{f.table}|{f.target}{actions}")
    if t.auto_increment is not None:
        out.append(f"~A|{t.name}|{name(t.auto_increment)}|I{t.last}")
    out += [f"~D|{t.name}|{c.name}|{cell(c.default, c)}" for c in t.columns if c.default is not NO_DEFAULT]
    out += [f"~U|{t.name}|{name(i)}" for i in t.unique]
    out += [f"~C|{t.name}|{encoded_check(t, x)}" for x in t.checks]
    return "".join(r + ";" for r in out)


def encoded_metadata(catalog: Catalog) -> str:
    return f"V{catalog.version};" + "".join(map(encoded_table, catalog.tables.values()))


def encoded_row(t: Table, values: tuple) -> str:
    return f"~R|{t.name}|" + "|".join(cell(v, c) for v, c in zip(values, t.columns, strict=True)) + ";"


# -- reading


def _text(payload: str, offset: int) -> str:
    out, i = [], 0
    while i < len(payload):
        c = payload[i]
        at = offset + len(payload[:i].encode())
        if c == "%":
            digits = payload[i + 1 : i + 7]
            if len(digits) < 6:
                raise CorruptStorage("truncated text escape", at)
            if not re.fullmatch("[0-9A-F]{6}", digits):
                raise CorruptStorage("malformed text escape", at)
            scalar = int(digits, 16)
            if scalar > 0x10FFFF or 0xD800 <= scalar <= 0xDFFF:
                raise CorruptStorage("escape is not a Unicode scalar", at)
            if not must_escape(chr(scalar)):
                raise CorruptStorage("unnecessary noncanonical text escape", at)
            out.append(chr(scalar))
            i += 7
        elif must_escape(c):
            raise CorruptStorage("unescaped structural character", at)
        else:
            out.append(c)
            i += 1
    return "".join(out)


def decoded_cell(raw: str, c: Column, offset: int, null: bool = True) -> Any:
    if raw == "N":
        if not null:
            raise CorruptStorage(f"NULL in NOT NULL column {quoted(c.name)}", offset)
        return None
    if raw[:1] != TAGS[c.type]:
        raise CorruptStorage(f"cell type does not match column {quoted(c.name)}", offset)
    body = raw[1:]
    if c.type == TEXT:
        return _text(body, offset + 1)
    if c.type == BOOLEAN:
        if body not in ("0", "1"):
            raise CorruptStorage("malformed BOOLEAN cell", offset)
        return body == "1"
    if not NUMBER.match(body) or not -(1 << 63) <= int(body) < 1 << 63:
        raise CorruptStorage("malformed INTEGER cell", offset)
    return int(body)


class Decoder:
    """Reads a whole string; every malformed record is an error at its byte offset."""

    def __init__(self, text: str):
        self.catalog, self.rows = Catalog(), []
        #: byte offsets of rows, for errors found later
        self.offsets: list[int] = []
        head = text[:3]
        if head not in ("V2;", "V3;"):
            raise CorruptStorage("unsupported or missing format header", 0)
        self.catalog.version = int(head[1])
        self.phase: dict[str, tuple[int, int]] = {}
        self.open: str | None = None
        offset, rest = 3, text[3:]
        if rest and not rest.endswith(";"):
            last = rest.rfind(";") + 1
            raise CorruptStorage("unterminated record", offset + len(rest[:last].encode()))
        for record in rest.split(";")[:-1]:
            self._record(record, offset)
            offset += len(record.encode()) + 1
        for t in self.catalog.tables.values():
            self._finished(t)

    def _finished(self, t: Table) -> None:
        if self.catalog.version == 2 and (t.checks or t.unique or any(c.default is not NO_DEFAULT for c in t.columns) or any((f.on_delete, f.on_update) != (RESTRICT, RESTRICT) for f in t.foreign_keys)):
            raise CorruptStorage(f"table {quoted(t.name)} needs format V3", 0)

    def _record(self, record: str, offset: int) -> None:
        bad = lambda message: CorruptStorage(message, offset)
        parts = record.split("|")
        kind, name = parts[0], parts[1] if len(parts) > 1 else ""
        if kind == "~S":
            return self._schema(parts, offset, bad)
        if kind not in ("~P", "~F", "~A", "~D", "~U", "~C", "~R"):
            raise bad("unknown record kind")
        t = self.catalog.tables.get(name)
        if t is None:
            raise bad(f"record for unknown table {quoted(name)}")
        if kind == "~R":
            self.open = None
            cells = parts[2:]
            if len(cells) != len(t.columns):
                raise bad(f"row of table {quoted(name)} has {len(cells)} cells, expected {len(t.columns)}")
            at, values = offset + len(f"~R|{name}|".encode()), []
            for c, raw in zip(t.columns, cells, strict=True):
                values.append(decoded_cell(raw, c, at, c.nullable))
                at += len(raw.encode()) + 1
            self.rows.append((name, tuple(values)))
            self.offsets.append(offset)
            return None
        if name != self.open:
            raise bad("metadata record outside its table's section")
        order = "PFADUC".index(kind[1])
        column = t.index(parts[2]) if kind != "~C" and len(parts) > 2 else -1
        if column is None or len(parts) < 3:
            raise bad("metadata record names an unknown column")
        before = self.phase[name]
        if order < before[0] or order == before[0] and (kind in ("~P", "~A") or kind != "~C" and column <= before[1]):
            raise bad("metadata records are duplicated or out of order")
        self.phase[name] = (order, column)
        if kind in ("~D", "~U", "~C") and self.catalog.version == 2:
            raise bad("record kind needs format V3")
        self.catalog.tables[name] = getattr(self, f"_{kind[1].lower()}")(t, column, parts, offset, bad)
        return None

    def _schema(self, parts: list[str], offset: int, bad) -> None:
        name = parts[1] if len(parts) > 1 else ""
        if self.rows:
            raise bad("schema record after rows")
        if not NAME.match(name):
            raise bad("malformed table name")
        if name in self.catalog.tables:
            raise bad(f"duplicate table {quoted(name)}")
        columns = []
        for p in parts[2:]:
            f = p.split(":")
            if len(f) != 3 or not NAME.match(f[0]) or f[1] not in TYPES or f[2] not in ("?", "!"):
                raise bad("malformed column definition")
            if any(c.name == f[0] for c in columns):
                raise bad(f"duplicate column {quoted(f[0])}")
            columns.append(Column(f[0], TYPES[f[1]], f[2] == "?"))
        if not columns:
            raise bad("table without columns")
        self.catalog.tables[name] = Table(name, tuple(columns))
        self.phase[name], self.open = (-1, -1), name

    def _p(self, t: Table, i: int, parts: list[str], offset: int, bad) -> Table:
        if len(parts) != 3 or t.columns[i].nullable:
            raise bad("malformed primary key")
        return replace(t, primary_key=i)

    def _f(self, t: Table, i: int, parts: list[str], offset: int, bad) -> Table:
        tags = {v: k for k, v in ACTIONS.items()}
        if len(parts) not in (5, 7):
            raise bad("malformed foreign key")
        delete, update = (tags.get(x) for x in parts[5:7]) if len(parts) == 7 else (RESTRICT, RESTRICT)
        if delete is None or update not in (RESTRICT, CASCADE) or len(parts) == 7 and (delete, update) == (RESTRICT, RESTRICT):
            raise bad("malformed referential action")
        if len(parts) == 7 and self.catalog.version == 2:
            raise bad("referential actions need format V3")
        parent = self.catalog.tables.get(parts[3])
        k = parent.index(parts[4]) if parent else None
        if k is None or parent.primary_key != k or parent.columns[k].type != t.columns[i].type or delete == SET_NULL and not t.columns[i].nullable:
            raise bad("foreign key has no fitting target")
        return replace(t, foreign_keys=(*t.foreign_keys, ForeignKey(i, parts[3], parts[4], delete, update)))

    def _a(self, t: Table, i: int, parts: list[str], offset: int, bad) -> Table:
        if len(parts) != 4 or t.primary_key != i or t.columns[i].type != INTEGER or not parts[3].startswith("I") or not COUNT.match(parts[3][1:]) or int(parts[3][1:]) >= 1 << 63:
            raise bad("malformed auto-increment record")
        return replace(t, auto_increment=i, last=int(parts[3][1:]))

    def _d(self, t: Table, i: int, parts: list[str], offset: int, bad) -> Table:
        if len(parts) != 4 or t.auto_increment == i:
            raise bad("malformed default")
        at = offset + len("|".join(parts[:3]).encode()) + 1
        value = decoded_cell(parts[3], t.columns[i], at, t.columns[i].nullable)
        return replace(t, columns=tuple(replace(c, default=value) if k == i else c for k, c in enumerate(t.columns)))

    def _u(self, t: Table, i: int, parts: list[str], offset: int, bad) -> Table:
        if len(parts) != 3 or t.primary_key == i:
            raise bad("malformed unique record")
        return replace(t, unique=(*t.unique, i))

    def _c(self, t: Table, i: int, parts: list[str], offset: int, bad) -> Table:
        fields, at = parts[2:], 0

        def take() -> str:
            nonlocal at
            if at >= len(fields):
                raise bad("truncated CHECK program")
            at += 1
            return fields[at - 1]

        def count() -> int:
            raw = take()
            if not COUNT.match(raw):
                raise bad("malformed CHECK program")
            return int(raw)

        def node(parent: str | None) -> Any:
            op = take()
            if op in ("AND", "OR"):
                n = count()
                if n < 2 or op == parent:
                    raise bad("CHECK program is not a canonical complete expression")
                return Node(op, tuple(node(op) for _ in range(n)))
            if op not in OPERATORS:
                raise bad("unknown CHECK opcode")
            k = count()
            if k >= len(t.columns):
                raise bad("CHECK program names an unknown column")
            c, name = t.columns[k], OPERATORS[op]
            if name in ("IS NULL", "IS NOT NULL"):
                return Leaf((0, k), name)
            if name == "LIKE":
                if c.type != TEXT:
                    raise bad("LIKE over a column that is not TEXT")
                atoms: list[Any] = []
                for _ in range(count()):
                    raw = take()
                    if raw in ("M", "S"):
                        atoms.append(ANY if raw == "M" else ONE)
                    elif raw[:1] == "L" and len(x := _text(raw[1:], offset)) == 1:
                        atoms.append((x,))
                    else:
                        raise bad("malformed LIKE atom")
                return Leaf((0, k), name, tuple(atoms))
            if name == "IN":
                n = count()
                if n == 0:
                    raise bad("CHECK IN predicates require at least one item")
                return Leaf((0, k), name, tuple(decoded_cell(take(), c, offset) for _ in range(n)))
            return Leaf((0, k), name, decoded_cell(take(), c, offset, False))

        program = node(None)
        if at != len(fields):
            raise bad("CHECK program is not a canonical complete expression")
        return replace(t, checks=(*t.checks, program))

"""The text pattern that prefilters stored records, as EXPLAIN REGEX shows it. Execution never uses it."""

from __future__ import annotations

from typing import Any

from .. import limits as L
from ..functions.predicates import ANY, ONE
from ..schema import INTEGER, TEXT, Column, Leaf, Node, Table
from ..sources.codec import cell, escaped
from .analyzer import ResolvedSelect

UNIT = r"(?:%[0-9A-F]{6}|[^%|;~])"
_META = set("\\.+*?()|[]{}^$#&-~")


def escape(text: str) -> str:
    return "".join("\\" + c if c in _META else c for c in text)


def cell_pattern(c: Column, null: bool = True) -> str:
    body = {TEXT: f"T{UNIT}*", INTEGER: "I(?:0|-?[1-9][0-9]*)"}.get(c.type, "B[01]")
    return f"(?:N|{body})" if null and c.nullable else body


def pushed(where: Any, source: int) -> tuple[list[Leaf], bool]:
    """Leaves of one source that the pattern can test, and whether they are all of WHERE."""
    parts = where.children if isinstance(where, Node) and where.op == "AND" else () if where is None else (where,)
    good = [p for p in parts if isinstance(p, Leaf) and p.op in ("=", "!=", "LIKE", "IS NULL", "IS NOT NULL")]
    return [p for p in good if p.column[0] == source], len(good) == len(parts)


def row_pattern(t: Table, leaves: list[Leaf]) -> str:
    out, n = [rf"~R\|{escape(t.name)}\|"], len(t.columns)
    for leaf in leaves:
        i = leaf.column[1]
        c, edge = t.columns[i], ";" if i + 1 == n else r"\|"
        out.append("(?=" + "".join(cell_pattern(x) + r"\|" for x in t.columns[:i]))
        if leaf.op == "=":
            out.append(escape(cell(leaf.value, c)))
        elif leaf.op == "!=":
            out.append(f"(?!{escape(cell(leaf.value, c))}{edge}){cell_pattern(c, False)}")
        elif leaf.op == "LIKE":
            atoms = [a for k, a in enumerate(leaf.value) if a != ANY or k == 0 or leaf.value[k - 1] != ANY]
            out.append("T" + "".join(UNIT + "*" if a == ANY else UNIT if a == ONE else escape(escaped(a[0])) for a in atoms))
        else:
            out.append("N" if leaf.op == "IS NULL" else cell_pattern(c, False))
        out.append(edge + ")")
    return "".join(out) + r"\|".join(cell_pattern(c) for c in t.columns) + ";"


def scan_pattern(s: ResolvedSelect, limits: L.Limits) -> tuple[str, bool]:
    """The pattern, and whether it alone decides: one source, nothing left to test."""
    parts = [row_pattern(t, pushed(s.where, k)[0]) for k, t in enumerate(s.sources)]
    pattern = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    L.check(len(pattern.encode()), limits.max_pattern_bytes, L.PATTERN_BYTES)
    return pattern, len(parts) == 1 and pushed(s.where, 0)[1]

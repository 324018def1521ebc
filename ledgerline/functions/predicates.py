"""Three-valued predicates. Spark's NULL is the dialect's UNKNOWN, so columns need no wrapping."""

from __future__ import annotations

import datetime
import functools
import operator
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch
from ..schema import Leaf, Node

ANY, ONE = "any", "one"
_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def like_atoms(pattern: str) -> tuple[str | tuple[str], ...]:
    """ANY, ONE, or a literal character in a tuple; a backslash escapes only %, _ and itself."""
    atoms: list[Any] = []
    chars = iter(pattern)
    for c in chars:
        if c == "\\":
            c = next(chars, None)
            if c is None:
                raise TypeMismatch("LIKE pattern ends with an incomplete escape")
            if c not in "%_\\":
                raise TypeMismatch(f"LIKE pattern contains unsupported escape \\{c}")
            atoms.append((c,))
        else:
            atoms.append(ANY if c == "%" else ONE if c == "_" else (c,))
    return tuple(atoms)


def like_text(atoms: tuple) -> str:
    return "".join("%" if a == ANY else "_" if a == ONE else "\\" + a[0] if a[0] in "%_\\" else a[0] for a in atoms)


def leaves(expression: Any) -> list[Leaf]:
    stack, out = [expression], []
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            stack += reversed(x.children)
        elif x is not None:
            out.append(x)
    return out


def to_column(expression: Any, column: Callable[[tuple[int, int]], Column]) -> Column:
    """AND and OR become balanced trees, so Catalyst's recursion stays shallow."""
    if isinstance(expression, Node):
        parts = [to_column(c, column) for c in expression.children]
        join = operator.and_ if expression.op == "AND" else operator.or_
        while len(parts) > 1:
            parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]
    c, op, value = column(expression.column), expression.op, expression.value
    if op in _COMPARE:
        return _COMPARE[op](c, F.lit(value))
    if op == "LIKE":
        return c.like(like_text(value))
    if op == "IN":
        known = [v for v in value if v is not None]
        if not known:
            return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(None).cast("boolean"))
        found = c.isin(known)
        return found if len(known) == len(value) else F.when(found, F.lit(True))
    return c.isNull() if op == "IS NULL" else c.isNotNull()


#: How a stored column of another type is read as one of the dialect's.
CENTS, WHOLE, DATE, MICROS = "cents", "whole", "date", "micros"
_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\Z")


def implied(expression: Any, column: Callable[[tuple[int, int]], Column], raw: Callable[[tuple[int, int]], tuple | None]) -> Column | None:
    """A predicate on stored columns that is TRUE wherever `expression` is, or None. A scan can skip by it what `expression`, stated on
    columns that are made from them, would reject one by one. raw: the stored column, its type and its unit, or None."""
    if isinstance(expression, Node):
        parts = [implied(c, column, raw) for c in expression.children]
        if expression.op == "OR" and None in [p if p is None else True for p in parts]:
            return None
        parts = [p for p in parts if p is not None]
        return functools.reduce(operator.and_ if expression.op == "AND" else operator.or_, parts) if parts else None
    found = raw(expression.column)
    if found is None:
        return to_column(expression, column)
    x, kind, unit = found
    op, value = expression.op, expression.value
    if op == "IS NULL":
        return x.isNull()
    if op not in ("=", "<", "<=", ">", ">=", "IN"):
        return x.isNotNull()
    values = [v for v in value if v is not None] if op == "IN" else [value]
    if not values:
        return None
    low, high = (min(values) if op not in ("<", "<=") else None), (max(values) if op not in (">", ">=") else None)
    return _between(x, kind, unit, low, high)


def _between(x: Column, kind: T.DataType, unit: str, low: Any, high: Any) -> Column | None:
    """Stored values that can read as anything from low to high, ends included."""
    bounds: list[Column] = []
    if unit in (WHOLE, CENTS):
        # one unit more on either side is more than rounding or cutting off can move a value
        scale = 1 if unit == WHOLE else 100
        if not isinstance(kind, T.DoubleType) or any(v is not None and abs(v) >= 1 << 50 for v in (low, high)):
            return None
        bounds += [] if low is None else [x >= F.lit((low - 1) / scale)]
        bounds += [] if high is None else [x <= F.lit((high + 1) / scale)]
        return functools.reduce(operator.and_, bounds)
    if unit == MICROS:
        days = [None if v is None else v // 86_400_000_000 + d for v, d in ((low, -2), (high, 2))]
        if any(d is not None and abs(d) > 700_000 for d in days):
            return None
        first, last = (None if d is None else datetime.date(1970, 1, 1) + datetime.timedelta(d) for d in days)
    else:
        if any(v is not None and (not _DAY.match(v) or v < "0001-01-02" or v > "9999-12-30") for v in (low, high)):
            return None
        try:
            first, last = (None if v is None else datetime.date.fromisoformat(v) for v in (low, high))
        except ValueError:
            return None
        last = last and last + datetime.timedelta(1)
    day = lambda d: F.lit(d.isoformat()).cast(kind)
    bounds += [] if first is None else [x >= day(first)]
    bounds += [] if last is None else [x <= day(last)]
    # years that have more or fewer digits than four are in another order as text
    return functools.reduce(operator.and_, bounds) | (x < F.lit("0001-01-01").cast(kind)) | (x >= F.lit("9999-12-31").cast(kind))


@functools.lru_cache(256)
def _like_regex(atoms: tuple) -> re.Pattern[str]:
    return re.compile("".join(".*" if a == ANY else "." if a == ONE else re.escape(a[0]) for a in atoms) + r"\Z", re.S)


def truth(expression: Any, value_of: Callable[[tuple[int, int]], Any]) -> bool | None:
    """The same predicate on one row on the driver; None is UNKNOWN."""
    if isinstance(expression, Node):
        decided, unknown = expression.op == "OR", False
        for child in expression.children:
            t = truth(child, value_of)
            if t is decided:
                return decided
            unknown |= t is None
        return None if unknown else not decided
    v, op = value_of(expression.column), expression.op
    if op == "IS NULL":
        return v is None
    if op == "IS NOT NULL":
        return v is not None
    if v is None:
        return None
    if op == "LIKE":
        return _like_regex(expression.value).match(v) is not None
    if op == "IN":
        return True if any(x is not None and x == v for x in expression.value) else None if None in expression.value else False
    return _COMPARE[op](v, expression.value)

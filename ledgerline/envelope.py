"""Outcomes as JSON: the shape that a console in a browser takes. Integers are text, as 64 bits do not fit a JSON number there."""

from __future__ import annotations

import json
import re
from typing import Any

from .database import Database
from .errors import EngineError
from .results import Affected, Created, Explanation, Outcome, Rows, RowSet
from .sql import ast as A
from .sql.parser import parse


def value(v: Any) -> dict:
    if v is None:
        return {"type": "NULL", "value": None}
    if isinstance(v, bool):
        return {"type": "BOOLEAN", "value": v}
    return {"type": "INTEGER", "value": str(v)} if isinstance(v, int) else {"type": "TEXT", "value": v}


def columns(found: list) -> list[dict]:
    return [{"label": c.label, "table": c.table, "column": c.column, "type": c.type, "nullable": c.nullable} for c in found]


def row_set(rows: RowSet) -> dict:
    return {"columns": columns(rows.columns), "rows": [[value(v) for v in r] for r in rows.rows()]}


def scan(e: Explanation, blob: str) -> dict:
    """The pattern, and where it matches in the stored string, in UTF-8 bytes."""
    matches = [[len(blob[: m.start()].encode()), len(blob[: m.end()].encode())] for m in re.finditer(e.pattern, blob)]
    return {"pattern": e.pattern, "exact": e.pattern_is_exact, "sources": e.sources, "columns": columns(e.columns), "matches": matches}


def failure(e: EngineError, blob: str) -> dict:
    out = {"kind": e.kind, "message": str(e)}
    if hasattr(e, "span"):
        out["span"] = list(e.span)
    return {"ok": False, "blob": blob, "error": out}


def as_select(sql: str) -> str | None:
    """The SELECT that scans what an UPDATE or DELETE scans."""
    try:
        s = parse(sql)
    except EngineError:
        return None
    if not isinstance(s, (A.Update, A.Delete)):
        return None
    m = re.search(r"(?is)\bWHERE\b.*", re.sub(r"'(?:[^']|'')*'", lambda q: "\0" * len(q[0]), sql)) if s.where is not None else None
    return f"SELECT * FROM {s.table} {sql[m.start() :] if m else ''}".strip()


class Console:
    """exec, explain, load, dump and reset over one database; every reply carries the string as it stands afterwards."""

    def __init__(self, spark, limits=None):
        self.spark, self.limits = spark, limits
        self.db = Database(spark, limits)

    def dump(self) -> str:
        return self.db.as_str()

    def reset(self) -> None:
        self.db = Database(self.spark, self.limits)

    def _reply(self, payload: dict) -> str:
        return json.dumps({"ok": True, "blob": self.dump(), **payload})

    def load(self, blob: str) -> str:
        try:
            self.db = Database.from_string(self.spark, blob, self.limits)
        except EngineError as e:
            return json.dumps(failure(e, self.dump()))
        return self._reply({"kind": "loaded"})

    def explain(self, sql: str) -> str:
        try:
            return self._reply({"kind": "explain", "scan": scan(self.db.explain_select(sql), self.dump())})
        except EngineError as e:
            return json.dumps(failure(e, self.dump()))

    def exec(self, sql: str) -> str:
        before, mutation = self.dump(), None
        if select := as_select(sql):
            try:
                mutation = scan(self.db.explain_select(select), before)
            except EngineError:
                mutation = None
        try:
            out = self.db.execute(sql)
        except EngineError as e:
            return json.dumps(failure(e, self.dump()))
        return self._reply(self._payload(out, sql, mutation, before))

    def _payload(self, out: Outcome, sql: str, mutation: dict | None, before: str) -> dict:
        if isinstance(out, Rows):
            try:
                found = scan(self.db.explain_select(sql), self.dump())
            except EngineError:
                found = None
            return {"kind": "rows", "result": row_set(out.rows), "scan": found}
        if isinstance(out, Affected):
            return {"kind": "affected", "rows": out.count} | ({"scan": mutation, "blobBefore": before} if mutation else {})
        if isinstance(out, Created):
            return {"kind": "created", "table": out.table}
        return {"kind": "explain", "scan": scan(out.explanation, self.dump())}

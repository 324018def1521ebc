"""What statements give back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from . import limits as L
from .schema import TEXT


@dataclass(frozen=True)
class ResultColumn:
    label: str
    table: str
    column: str
    type: str
    nullable: bool


def logical_bytes(value: Any) -> int:
    return len(value.encode()) if isinstance(value, str) else 1 if value is None or isinstance(value, bool) else 8


@dataclass
class RowSet:
    """Columns with their origins, and rows. `dataframe` is the plan in result order as far as the statement or a limit asks
    for one; rows() adds the tables' own order, so it is always deterministic for managed tables."""

    columns: list[ResultColumn]
    plan: Callable[[bool], DataFrame] | None = None
    values: list[tuple] | None = None
    max_bytes: int = 32 * L.MIB
    _rows: list[tuple] | None = field(default=None, repr=False)

    @property
    def dataframe(self) -> DataFrame:
        """Columns p0, p1, ... by position; labels may repeat, so use named() for labels."""
        return self.plan(False)

    def named(self, *names: str) -> DataFrame:
        return self.dataframe.toDF(*(names or [c.label for c in self.columns]))

    def rows(self) -> list[tuple]:
        if self._rows is None:
            if self.values is not None:
                self._rows = self.values
            else:
                out, used = [], sum(len(c.label.encode()) for c in self.columns)
                L.check(used, self.max_bytes, L.QUERY_OUTPUT_BYTES)
                for row in self.plan(True).toLocalIterator():
                    used += sum(map(logical_bytes, row))
                    L.check(used, self.max_bytes, L.QUERY_OUTPUT_BYTES)
                    out.append(tuple(row))
                self._rows = out
        return self._rows


@dataclass(frozen=True)
class Outcome:
    is_mutation = False


@dataclass(frozen=True)
class Rows(Outcome):
    rows: RowSet


@dataclass(frozen=True)
class Affected(Outcome):
    count: int
    is_mutation = True


@dataclass(frozen=True)
class Created(Outcome):
    table: str
    is_mutation = True


@dataclass(frozen=True)
class Explanation:
    pattern: str
    pattern_is_exact: bool
    sources: list[str]
    columns: list[ResultColumn]
    spark_plan: str | None = None


@dataclass(frozen=True)
class Explain(Outcome):
    explanation: Explanation


def text_columns(origin: str, names: list[str]) -> list[ResultColumn]:
    return [ResultColumn(n, origin, n, TEXT, False) for n in names]

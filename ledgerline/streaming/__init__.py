"""The dialect's filters and projections on streams; it has no windows or state, and neither has this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..functions.predicates import to_column
from ..limits import Limits
from ..plans import analyzer
from ..schema import Catalog, Table
from ..sql import ast as A
from ..sql.parser import parse


def select_stream(t: Table, stream: DataFrame, sql: str, limits: Limits | None = None) -> DataFrame:
    """A SELECT from the one table `t` over a streaming DataFrame with its columns c0, c1, ...; order and pages need an end, and joins a second table, so they are rejected."""
    s = parse(sql)
    if not isinstance(s, A.Select) or s.joins or s.order or s.limit is not None or s.offset is not None:
        raise UnsupportedError("streams take SELECT with WHERE only", (0, len(sql.encode())))
    r = analyzer.select(Catalog({t.name: t}), s, limits or Limits())
    if r.where is not None:
        stream = stream.where(to_column(r.where, lambda at: F.col(f"c{at[1]}")))
    return stream.select([F.col(f"c{at[1]}").alias(f"p{i}") for i, at in enumerate(r.items)])

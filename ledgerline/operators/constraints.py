"""Constraints of whole tables, as aggregations and anti-joins: primary keys, then unique columns, checks, foreign keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError, EngineError, quoted
from ..functions.predicates import to_column, truth
from ..schema import RID, Catalog, Table
from ..sources.tables import Store, Version

Fail = Callable[[str, int | None], EngineError]


def constraint(message: str, rid: int | None = None) -> EngineError:
    return ConstraintError(message)


def duplicated(frame: DataFrame, column: str) -> int | None:
    """The least row number among second occurrences, or None. Partial aggregation keeps a hot value from meeting in one task; only
    where a value occurs twice are its rows looked at once more."""
    twice = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"), F.min(RID).alias("_first")).where("_n > 1")
    if twice.isEmpty():
        return None
    return frame.join(twice, column).where(F.col(RID) > F.col("_first")).agg(F.min(RID)).first()[0]


def validate(catalog: Catalog, frame_of: Callable[[Table], DataFrame], changed: Iterable[str], parents: Iterable[str], fail: Fail = constraint) -> None:
    """Checks the tables in `changed`, and foreign keys into the tables in `parents`. The state before was valid."""
    changed, parents = set(changed), set(parents)
    tables = [t for t in catalog.tables.values() if t.name in changed]
    for t in tables:
        if t.primary_key is not None:
            key = f"c{t.primary_key}"
            if not (null := frame_of(t).where(F.col(key).isNull())).isEmpty():
                raise fail(f"primary key for table {quoted(t.name)} is NULL", null.agg(F.min(RID)).first()[0])
            if (rid := duplicated(frame_of(t), key)) is not None:
                raise fail(f"duplicate primary key in table {quoted(t.name)}", rid)
        if t.auto_increment is not None:
            above = frame_of(t).where(F.col(f"c{t.auto_increment}") > F.lit(t.last)).agg(F.min(RID)).first()[0]
            if above is not None:
                raise fail(f"auto-increment high-water mark for table {quoted(t.name)} is below a stored key", above)
    for t in tables:
        for i in t.unique:
            if (rid := duplicated(frame_of(t), f"c{i}")) is not None:
                raise fail(f"duplicate UNIQUE value for table {quoted(t.name)} column {quoted(t.columns[i].name)}", rid)
    for t in tables:
        if t.checks:
            failed = F.lit(None).cast("int")
            for n in range(len(t.checks), 0, -1):
                good = F.coalesce(to_column(t.checks[n - 1], lambda at: F.col(f"c{at[1]}")), F.lit(True))
                failed = F.when(~good, F.lit(n)).otherwise(failed)
            first = frame_of(t).withColumn("_n", failed).where("_n IS NOT NULL").agg(F.min(F.struct(RID, "_n"))).first()[0]
            if first is not None:
                raise fail(f"CHECK constraint {first['_n']} failed for table {quoted(t.name)}", first[RID])
    for t in catalog.tables.values():
        for f in t.foreign_keys:
            if t.name in changed or f.table in parents:
                parent = catalog.tables[f.table]
                keys = frame_of(parent).select(F.col(f"c{parent.primary_key}").alias("_key"))
                child = frame_of(t).where(F.col(f"c{f.column}").isNotNull()).select(RID, F.col(f"c{f.column}").alias("_key"))
                orphan = child.join(keys, "_key", "left_anti").agg(F.min(RID)).first()[0]
                if orphan is not None:
                    raise fail(f"foreign key {quoted(t.name)}.{quoted(t.columns[f.column].name)} has no matching row in {quoted(f.table)}.{quoted(f.target)}", orphan)


def validate_row(catalog: Catalog, store: Store, versions: dict[str, Version], t: Table, row: list) -> None:
    """The same constraints for one row to be added: key lookups, no pass over the table."""
    v = versions[t.name]
    if t.primary_key is not None and store.has(t, v, t.primary_key, row[t.primary_key]):
        raise ConstraintError(f"duplicate primary key in table {quoted(t.name)}")
    for i in t.unique:
        if row[i] is not None and store.has(t, v, i, row[i]):
            raise ConstraintError(f"duplicate UNIQUE value for table {quoted(t.name)} column {quoted(t.columns[i].name)}")
    for n, check in enumerate(t.checks, 1):
        if truth(check, lambda at: row[at[1]]) is False:
            raise ConstraintError(f"CHECK constraint {n} failed for table {quoted(t.name)}")
    for f in t.foreign_keys:
        value = row[f.column]
        if value is None or f.table == t.name and row[t.primary_key] == value:
            continue
        parent = catalog.tables[f.table]
        if not store.has(parent, versions[f.table], parent.primary_key, value):
            raise ConstraintError(f"foreign key {quoted(t.name)}.{quoted(t.columns[f.column].name)} has no matching row in {quoted(f.table)}.{quoted(f.target)}")

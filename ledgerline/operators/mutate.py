"""UPDATE and DELETE with their referential actions, as a fix point of joins. Targets are frozen from the state before."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError, quoted
from ..functions.predicates import to_column
from ..schema import CASCADE, RESTRICT, RID, SET_NULL, Catalog, ForeignKey, Table
from ..sources.tables import Store

Frames = Callable[[Table], DataFrame]


def targets(t: Table, frame: DataFrame, where: Any) -> DataFrame:
    """Rows for which WHERE is TRUE."""
    return frame if where is None else frame.where(to_column(where, lambda at: F.col(f"c{at[1]}")))


def restricted(t: Table, f: ForeignKey) -> ConstraintError:
    return ConstraintError(f"foreign key {quoted(t.name)}.{quoted(t.columns[f.column].name)} restricts mutation of {quoted(f.table)}")


def delete(catalog: Catalog, store: Store, frame_of: Frames, t: Table, where: Any, large: bool) -> tuple[int, dict[str, DataFrame], set[str], dict[str, DataFrame]]:
    """The number of direct targets, the new rows of each table of which rows changed, the names of these, and of the tables that only
    lost rows these rows: every key that points at a lost row has had its action, so they need no further check."""
    direct = store.kept(targets(t, frame_of(t), where), large)
    count = direct.count()
    if count == 0:
        return 0, {}, set(), {}
    gone: dict[str, DataFrame] = {t.name: direct.select(RID)}
    lost: dict[str, DataFrame] = {t.name: direct}
    nulled: dict[str, dict[int, DataFrame]] = {}
    frontier = [(t, direct)]
    while frontier:
        parent, rows = frontier.pop(0)
        for child, f in catalog.inbound(parent.name):
            keys = rows.select(F.col(f"c{parent.primary_key}").alias("_key"))
            hit = frame_of(child).join(keys, F.col(f"c{f.column}") == F.col("_key"), "left_semi")
            if f.on_delete == RESTRICT:
                # only direct targets release the parent, not rows that go by a cascade
                held = hit.join(direct.select(RID), RID, "left_anti") if child.name == t.name else hit
                if not held.isEmpty():
                    raise restricted(child, f)
            elif f.on_delete == CASCADE:
                new = store.kept(hit.join(gone[child.name], RID, "left_anti") if child.name in gone else hit, large)
                if not new.isEmpty():
                    gone[child.name] = store.kept(gone[child.name].unionByName(new.select(RID)), large) if child.name in gone else new.select(RID)
                    lost[child.name] = lost[child.name].unionByName(new) if child.name in lost else new
                    frontier.append((child, new))
            elif f.on_delete == SET_NULL:
                marked = nulled.setdefault(child.name, {})
                now = hit.select(RID)
                marked[f.column] = store.kept(marked[f.column].unionByName(now).distinct() if f.column in marked else now, large)
    out: dict[str, DataFrame] = {}
    for name in nulled:
        frame = frame_of(catalog.tables[name])
        for column, rids in nulled.get(name, {}).items():
            frame = frame.join(rids.withColumn("_null", F.lit(True)), RID, "left").withColumn(f"c{column}", F.when(F.col("_null").isNull(), F.col(f"c{column}"))).drop("_null")
        out[name] = frame.join(gone[name], RID, "left_anti") if name in gone else frame
    return count, out, set(nulled), {name: rows for name, rows in lost.items() if name not in nulled}


def update(catalog: Catalog, store: Store, frame_of: Frames, t: Table, values: dict[int, Any], where: Any, large: bool) -> tuple[int, dict[str, DataFrame]]:
    """The number of matched rows, and the new rows of each touched table."""
    direct = store.kept(targets(t, frame_of(t), where), large)
    count = direct.count()
    if count == 0:
        return 0, {}
    # per table and column: row number, new value
    overlays: dict[tuple[str, int], DataFrame] = {}
    for i, value in values.items():
        kind = t.struct[i + 1].dataType
        overlays[t.name, i] = direct.select(RID, F.lit(value).cast(kind).alias("_new"))
    frontier: list[tuple[Table, DataFrame]] = []
    if t.primary_key in values and catalog.inbound(t.name):
        key = F.col(f"c{t.primary_key}")
        moved = direct.where(key != F.lit(values[t.primary_key])).select(key.alias("_old"), F.lit(values[t.primary_key]).cast(t.struct[t.primary_key + 1].dataType).alias("_new"))
        frontier.append((t, store.kept(moved, large)))
    while frontier:
        parent, moved = frontier.pop(0)
        if moved.isEmpty():
            continue
        for child, f in catalog.inbound(parent.name):
            at = (child.name, f.column)
            hit = frame_of(child).select(RID, F.col(f"c{f.column}").alias("_old")).join(moved, "_old")
            if f.on_update == RESTRICT:
                if at in overlays:
                    now = overlays[at].withColumnRenamed("_new", "_now").withColumn("_set", F.lit(True))
                    hit = hit.join(now, RID, "left").where(F.col("_set").isNull() | F.col("_now").eqNullSafe(F.col("_old")))
                if not hit.isEmpty():
                    raise restricted(child, f)
                continue
            hit = store.kept(hit.select(RID, "_old", "_new"), large)
            fresh = hit
            if at in overlays:
                now = overlays[at].withColumnRenamed("_new", "_now").withColumn("_set", F.lit(True))
                both = hit.join(now, RID, "left")
                clash = both.where(F.col("_set") & ~F.col("_now").eqNullSafe(F.col("_new"))).agg(F.min(RID)).first()[0]
                if clash is not None:
                    raise ConstraintError(f"conflicting cascaded updates target column {f.column} of the row numbered {clash}")
                fresh = both.where(F.col("_set").isNull()).select(RID, "_old", "_new")
                if fresh.isEmpty():
                    continue
                fresh = store.kept(fresh, large)
                overlays[at] = store.kept(overlays[at].unionByName(fresh.select(RID, "_new")), large)
            elif not hit.isEmpty():
                overlays[at] = hit.select(RID, "_new")
            if child.primary_key == f.column:
                frontier.append((child, fresh.where(F.col("_old") != F.col("_new")).select("_old", "_new")))
    out: dict[str, DataFrame] = {}
    for (name, column), rows in overlays.items():
        frame = out[name] if name in out else frame_of(catalog.tables[name])
        new = rows.withColumn("_set", F.lit(True))
        frame = frame.join(new, RID, "left").withColumn(f"c{column}", F.when(F.col("_set"), F.col("_new")).otherwise(F.col(f"c{column}"))).drop("_set", "_new")
        out[name] = frame
    return count, out

"""SELECT as one declarative plan: scans, equi-joins, filter, order, page, projection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import implied, leaves, to_column
from ..plans.analyzer import ResolvedSelect
from ..schema import RID, Node, Table
from ..sources.tables import Store

INT_MAX = (1 << 31) - 1


def plan(s: ResolvedSelect, frame_of: Callable[[Table], DataFrame], ordered: bool, raw: list[dict[int, tuple]] | None = None, store: Store | None = None) -> DataFrame:
    """Columns p0, p1, ... in projection order. Rows are in the statement's order where it has one or a page depends on it,
    and in source order if `ordered`; the source order of attached tables is not defined. `raw` has of each source the stored columns
    behind its own; `store` is given where rows are not all on the driver."""
    name = lambda at: f"s{at[0]}_{at[1]}"
    raw = raw or [{}] * len(s.sources)
    rids: list[str] = []
    frames = []
    for k, t in enumerate(s.sources):
        frame = frame_of(t)
        columns = [F.col(f"c{i}").alias(name((k, i))) for i in range(len(t.columns))]
        columns += [F.col(f"r{i}").alias(name((k, i)) + "_raw") for i in raw[k]]
        if RID in frame.columns:
            columns.append(F.col(RID).alias(f"s{k}_rid"))
            rids.append(f"s{k}_rid")
        frames.append(frame.select(columns))
    out = frames[0]
    for k, conditions in enumerate(s.joins, 1):
        # every ON condition goes into the join; Catalyst keeps the equalities as keys and the rest as filters
        out = out.join(frames[k], reduce(lambda a, b: a & b, (F.col(name(a)) == F.col(name(b)) for a, b in conditions)), "inner")
    if s.where is not None:
        stored = lambda at: (F.col(name(at) + "_raw"), *raw[at[0]][at[1]]) if at[1] in raw[at[0]] else None
        column = lambda at: F.col(name(at))
        for part in s.where.children if isinstance(s.where, Node) and s.where.op == "AND" else [s.where]:
            exact = to_column(part, column)
            if any(stored(leaf.column) for leaf in leaves(part)) and (wide := implied(part, column, stored)) is not None:
                # not as one condition, from which Catalyst would draw out what both have in common, so that neither reaches the scan
                exact = wide & (F.coalesce(exact, F.lit(False)) if isinstance(part, Node) else exact)
            out = out.where(exact)
    keys = [F.col(name(at)).asc_nulls_last() if up else F.col(name(at)).desc_nulls_first() for at, up in s.order]
    paged = s.limit is not None or bool(s.offset)
    keys += [F.col(r).asc() for r in rids] if keys or paged or ordered else []
    wanted = [F.col(name(at)).alias(f"p{i}") for i, at in enumerate(s.items)]
    if s.offset and store is not None and (s.limit is None or s.offset + s.limit > INT_MAX):
        return numbered(out, keys, wanted, s.offset, s.limit, store)
    return page(out.orderBy(*keys) if keys else out, s.limit, s.offset or 0).select(wanted)


def page(frame: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """LIMIT and OFFSET of any unsigned 64-bit size, though Spark takes 32-bit ones."""
    if limit == 0 or offset > INT_MAX:  # rows on the driver are fewer than that
        return frame.limit(0)
    if offset:
        frame = frame.offset(offset)
    return frame if limit is None or limit > INT_MAX - offset else frame.limit(limit)


def numbered(frame: DataFrame, keys: list, wanted: list, offset: int, limit: int | None, store: Store) -> DataFrame:
    """A page without an end that fits a top-k. The sorted range partitions are written once, one number of rows for each of them
    says where it begins, and rows are picked by their number: no task sees more than a partition."""
    frame = (frame.orderBy(*keys) if keys else frame).select(*wanted, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))
    rows = store.kept(frame, True)
    counts = sorted(rows.groupBy("_part").count().collect())
    if not counts:
        return rows.drop("_part", "_row")
    starts = [0, *accumulate(n for _, n in counts)]
    # a row for each partition
    first = frame.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "_part int, _start bigint")
    number = F.col("_start") + F.col("_row")
    wide = lambda n: F.lit(min(n, (1 << 63) - 1))
    out = rows.join(F.broadcast(first), "_part").where((number >= wide(offset)) & (number < wide(offset + limit if limit is not None else 1 << 63)))
    return out.orderBy("_part", "_row").drop("_part", "_row", "_start")

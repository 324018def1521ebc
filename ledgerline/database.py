"""A database: a catalog, one version of rows for each table, and statements that replace them all or not at all."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import limits as L
from . import metadata
from .errors import CorruptStorage, SchemaError, UnsupportedError, quoted
from .operators import constraints, mutate
from .operators.select import plan
from .plans import analyzer
from .plans.explain import scan_pattern
from .results import Affected, Created, Explain, Explanation, Outcome, Rows, RowSet
from .schema import RID, Catalog, Table
from .sources import codec
from .sources.tables import Store, Version, encoded_rows
from .sql import ast as A
from .sql.parser import parse


class Database:
    """Statements run one at a time. Rows keep their insertion order by a hidden number. The limit of a database's bytes holds at
    every size and for load() too, so it is to be raised where tables are loaded in bulk; attached tables do not count."""

    def __init__(self, spark: SparkSession, limits: L.Limits | None = None, path: str | None = None, store: Store | None = None):
        self.spark, self.limits, self.store = spark, limits or L.Limits(), store or Store(spark, path)
        self.catalog, self.versions, self.next_rid = Catalog(), {}, 0
        L.check(len(codec.encoded_metadata(self.catalog)), self.limits.max_database_bytes, L.DATABASE_BYTES)

    def __repr__(self) -> str:
        return f"Database(tables={len(self.catalog.tables)}, limits={self.limits})"

    def clone(self) -> Database:
        other = Database(self.spark, self.limits, store=self.store)
        other._swap(self)
        return other

    def _swap(self, other: Database) -> None:
        self.catalog, self.versions, self.next_rid = other.catalog.copy(), dict(other.versions), other.next_rid

    # -- one-string form

    @classmethod
    def from_string(cls, spark: SparkSession, text: str, limits: L.Limits | None = None) -> Database:
        """Reads and validates a whole encoded database; malformed records are errors at their byte offset."""
        limits = limits or L.Limits()
        L.check(len(text.encode()), limits.max_database_bytes, L.DATABASE_BYTES)
        read = codec.Decoder(text)
        db = cls(spark, limits)
        db.catalog = read.catalog
        rows: dict[str, list] = {name: [] for name in read.catalog.tables}
        for rid, (name, values) in enumerate(read.rows):
            rows[name].append((rid, values))
        for name, t in read.catalog.tables.items():
            db.versions[name] = db.store.on_driver(t, tuple(rows[name]))
        db.next_rid = len(read.rows)
        constraints.validate(db.catalog, db._frame, [n for n in rows if rows[n]], (), lambda m, rid: CorruptStorage(m, read.offsets[rid] if rid is not None else 0))
        return db

    def as_str(self) -> str:
        """The canonical string: metadata, then all rows of all managed tables in insertion order."""
        out = []
        for t in self.catalog.tables.values():
            v = self.versions[t.name]
            if v.attached:
                raise UnsupportedError(f"encoding the attached table {quoted(t.name)}", (0, 0))
            out += [(rid, codec.encoded_row(t, values)) for rid, values in v.delta]
            if v.base is not None:
                out += [(r[0], r[1]) for r in encoded_rows(t, v.base).toLocalIterator()]
        return codec.encoded_metadata(self.catalog) + "".join(r for _, r in sorted(out))

    def encoded_frame(self) -> DataFrame:
        """The rows' records with their numbers, as a plan: for databases that no driver holds as one string."""
        parts = [encoded_rows(t, self._frame(t)) for t in self.catalog.tables.values() if not self.versions[t.name].attached]
        if not parts:
            return self.spark.createDataFrame([], "rid bigint, record string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _size(self) -> int:
        """Bytes of the one-string form; every version knows those of its rows."""
        return len(codec.encoded_metadata(self.catalog).encode()) + sum(v.size for v in self.versions.values())

    def vacuum(self) -> int:
        """Deletes files that only earlier states of this database read. Plans made before and clones must not be used any more."""
        return self.store.vacuum(list(self.versions.values()))

    # -- attached data

    def attach(self, t: Table, frame: DataFrame, raw: dict[int, tuple] | None = None) -> None:
        """A read-only table over a DataFrame whose columns are c0, c1, ... of the table's types. With `raw`, the stored columns
        that some of these are made from are there as r0, r1, ..., so that filters can be stated on them."""
        if t.name in self.catalog.tables:
            raise SchemaError(f"table {quoted(t.name)} already exists")
        self.catalog.tables[t.name] = t
        self.versions[t.name] = Version(frame, attached=True, raw=raw or {})

    def load(self, t: Table, frame: DataFrame) -> None:
        """Makes a managed table from a DataFrame in bulk, with its constraints checked; row numbers follow partitions."""
        if t.name in self.catalog.tables:
            raise SchemaError(f"table {quoted(t.name)} already exists")
        start = self.next_rid
        rows = frame.select((F.monotonically_increasing_id() + start).alias(RID), *(f"c{i}" for i in range(len(t.columns))))
        version = self.store.written(t, rows)
        other = self.clone()
        other.catalog.tables[t.name], other.versions[t.name] = t, version
        other.catalog.upgraded()
        L.check(other._size(), self.limits.max_database_bytes, L.DATABASE_BYTES)
        constraints.validate(other.catalog, other._frame, [t.name], ())
        other.next_rid = (version.base.agg(F.max(RID)).first()[0] or 0) + 1
        self._swap(other)

    # -- statements

    def _frame(self, t: Table) -> DataFrame:
        return self.store.frame(t, self.versions[t.name])

    def _statement(self, sql: str) -> Any:
        L.check(len(sql.encode()), self.limits.max_sql_bytes, L.SQL_BYTES)
        return parse(sql)

    def execute(self, sql: str) -> Outcome:
        s = self._statement(sql)
        if isinstance(s, A.Select):
            return Rows(self._select(s))
        if isinstance(s, A.ExplainSelect):
            return Explain(self._explain(s.select))
        if isinstance(s, A.ShowTables):
            return Rows(metadata.show_tables(self.catalog))
        if isinstance(s, A.ShowCreate):
            return Rows(metadata.show_create(analyzer.table(self.catalog, s.table)))
        if isinstance(s, A.Describe):
            return Rows(metadata.describe(analyzer.table(self.catalog, s.table)))
        return self._mutate(s)

    def query(self, sql: str) -> RowSet:
        """The rows of a statement that has some."""
        out = self.execute(sql)
        if not isinstance(out, Rows):
            raise UnsupportedError("a statement without rows", (0, len(sql.encode())))
        return out.rows

    def execute_script(self, text: str) -> list[Outcome]:
        """Statements separated by semicolons outside quotes, one by one; the first error ends it."""
        return [self.execute(s) for s in split_statements(text)]

    def explain_select(self, sql: str) -> Explanation:
        s = self._statement(sql)
        if not isinstance(s, A.Select):
            raise UnsupportedError("explain_select expects a SELECT statement", (0, len(sql.encode())))
        return self._explain(s)

    def _explain(self, s: A.Select) -> Explanation:
        r = analyzer.select(self.catalog, s, self.limits)
        pattern, exact = scan_pattern(r, self.limits)
        return Explanation(pattern, exact, [t.name for t in r.sources], r.columns)

    def spark_plan(self, sql: str) -> str:
        """What Catalyst makes of a SELECT."""
        return self.query(sql).dataframe._jdf.queryExecution().toString()

    def _select(self, s: A.Select) -> RowSet:
        r = analyzer.select(self.catalog, s, self.limits)
        scan_pattern(r, self.limits)  # its size is limited whether or not it is shown
        if r.limit == 0:
            return RowSet(r.columns, lambda ordered: self.spark.createDataFrame([], _empty(r)), [], self.limits.max_query_output_bytes)
        versions = dict(self.versions)
        frame = lambda t: self.store.frame(t, versions[t.name])
        raw = [versions[t.name].raw for t in r.sources]
        on_driver = all(versions[t.name].base is None for t in r.sources)
        return RowSet(r.columns, lambda ordered: plan(r, frame, ordered, raw, None if on_driver else self.store), None, self.limits.max_query_output_bytes)

    def _mutate(self, s: Any) -> Outcome:
        """Builds the next state beside this one, validates it, then swaps; a failure leaves everything as it was."""
        new = self.clone()
        if isinstance(s, A.CreateTable):
            t = analyzer.create(self.catalog, s, self.limits)
            new.catalog.tables[t.name], new.versions[t.name] = t, Version()
            new.catalog.upgraded()
            out: Outcome = Created(t.name)
        else:
            t = analyzer.table(self.catalog, s.table)
            if self.versions[t.name].attached:
                raise UnsupportedError(f"changing the attached table `{t.name}`", (0, 0))
            out = new._insert(t, s) if isinstance(s, A.Insert) else new._change(t, s)
        L.check(new._size(), self.limits.max_database_bytes, L.DATABASE_BYTES)
        self._swap(new)
        return out

    def _insert(self, t: Table, s: A.Insert) -> Affected:
        row, advanced = analyzer.insert(t, s)
        constraints.validate_row(self.catalog, self.store, self.versions, t, row)
        self.catalog.tables[t.name] = advanced
        self.versions[t.name] = self.store.appended(t, self.versions[t.name], self.next_rid, tuple(row))
        self.next_rid += 1
        return Affected(1)

    def _change(self, t: Table, s: A.Update | A.Delete) -> Affected:
        where = analyzer.where((t,), s.where, self.limits) if isinstance(s, A.Delete) else None
        large = any(v.base is not None and not v.attached for v in self.versions.values())
        lost: dict[str, DataFrame] = {}
        if isinstance(s, A.Update):
            values = analyzer.assignments(t, s)
            where = analyzer.where((t,), s.where, self.limits)
            count, touched = mutate.update(self.catalog, self.store, self._frame, t, values, where, large)
            check = set(touched)
        else:
            values = {}
            count, touched, check, lost = mutate.delete(self.catalog, self.store, self._frame, t, where, large)
        if not count:
            return Affected(0)
        for name in [*touched, *lost]:
            table, v = self.catalog.tables[name], self.versions[name]
            if name in lost and v.base is not None:
                self.versions[name] = self.store.without(table, v, lost[name])
            else:
                frame = touched[name] if name in touched else self._frame(table).join(lost[name].select(RID), RID, "left_anti")
                self.versions[name] = self.store.version(table, frame, v.base is not None)
        if isinstance(s, A.Update):
            for name in touched:
                table = self.catalog.tables[name]
                k = table.auto_increment
                if k is not None and (name != t.name or k in values):
                    top = self._frame(table).agg(F.max(f"c{k}")).first()[0]
                    self.catalog.tables[name] = table.advanced(top if top is not None else 0)
        constraints.validate(self.catalog, self._frame, check, check)
        return Affected(count)


def _empty(r: analyzer.ResolvedSelect):
    from pyspark.sql import types as T

    from .schema import SPARK_TYPES

    return T.StructType([T.StructField(f"p{i}", SPARK_TYPES[c.type]) for i, c in enumerate(r.columns)])


def split_statements(text: str) -> list[str]:
    out, part, quote = [], [], None
    for c in text:
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            out.append("".join(part))
            part = []
            continue
        part.append(c)
    return [s for s in (*out, "".join(part)) if s.strip()]


__all__ = ["Database", "encoded_rows", "split_statements"]

"""Versions of a table's rows: Parquet files, files of the numbers of deleted rows, and a short list of rows on the driver, so
single-row statements launch no job.

Files are only added: 5,000 rows from the driver become one more file, a DELETE one more file of row numbers. What a version no
longer needs stays, as plans that were handed out may read it, until vacuum() or the end of the driver."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RID, Table
from . import codec

#: Rows of a table that stay on the driver; beyond, they go to Parquet.
DELTA_ROWS = 5_000
#: So many files of appended rows, or of deleted row numbers, are written together as one.
MANY_FILES = 32


@dataclass(frozen=True)
class Version:
    """An immutable snapshot. `attached` bases are read-only and have no row numbers; `raw` says which of their columns c0, c1, ...
    are made from a column r0, r1, ... of another type, of what type and in which unit."""

    base: DataFrame | None = None
    delta: tuple[tuple[int, tuple], ...] = ()
    attached: bool = False
    #: bytes of the rows as records
    size: int = 0
    paths: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()
    raw: dict[int, tuple] = field(default_factory=dict, compare=False)
    #: Sets of key values on the driver, by column, made on demand.
    keys: dict[int, frozenset] = field(default_factory=dict, compare=False)

    def key_set(self, column: int) -> frozenset:
        if column not in self.keys:
            self.keys[column] = frozenset(v[column] for _, v in self.delta)
        return self.keys[column]


def encoded_rows(t: Table, frame: DataFrame) -> DataFrame:
    """rid, record: the rows as canonical records, in Spark expressions."""
    cells = []
    for i, c in enumerate(t.columns):
        x = F.col(f"c{i}")
        if c.type == "TEXT":
            # each character that must be escaped becomes % and six digits; % itself first
            text = F.expr(f"array_join(transform(filter(split(c{i}, ''), ch -> ch != ''), ch -> CASE WHEN ch RLIKE '{_sql(codec.ESCAPE_CLASS)}' THEN concat('%', lpad(hex(ascii(ch)), 6, '0')) ELSE ch END), '')")
            body = F.concat(F.lit("T"), F.when(x.rlike(codec.ESCAPE_CLASS), text).otherwise(x))
        elif c.type == "INTEGER":
            body = F.concat(F.lit("I"), x.cast("string"))
        else:
            body = F.when(x, F.lit("B1")).otherwise(F.lit("B0"))
        cells.append(F.when(x.isNull(), F.lit("N")).otherwise(body))
    return frame.select(F.col(RID).alias("rid"), F.concat(F.lit(f"~R|{t.name}|"), F.concat_ws("|", *cells), F.lit(";")).alias("record"))


def _sql(pattern: str) -> str:
    return "".join(f"\\\\u{ord(c):04x}" if ord(c) < 32 or ord(c) > 126 else c for c in pattern)


def _bytes(t: Table, rows) -> int:
    return sum(len(codec.encoded_row(t, values).encode()) for _, values in rows)


def _size(t: Table, frame: DataFrame) -> int:
    return encoded_rows(t, frame).agg(F.sum(F.octet_length("record"))).first()[0] or 0


class Store:
    """Writes files below one folder: the shared folder of a cluster, or a temporary one of a local session."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self._path = path

    @property
    def path(self) -> str:
        if self._path is None:
            root = self.spark.sparkContext.getConf().get("spark.checkpoint.dir")
            if root is None:
                if not self.spark.sparkContext.master.startswith("local"):
                    raise ValueError("give the database a path, or set spark.checkpoint.dir to a shared folder")
                root = tempfile.gettempdir()
            self._path = f"{root.rstrip('/')}/ledgerline-tables-{uuid.uuid4().hex}"
            atexit.register(self._at_exit)
        return self._path

    def _hadoop(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at_exit(self) -> None:
        try:
            at, fs = self._hadoop(self._path)
            fs.delete(at, True)
        except Exception:  # the session may have ended before the interpreter does
            pass

    def vacuum(self, versions: list[Version]) -> int:
        """Deletes what none of `versions` reads; returns how many folders went."""
        if self._path is None:
            return 0
        at, fs = self._hadoop(self._path)
        if not fs.exists(at):
            return 0
        used = {p.rsplit("/", 1)[-1] for v in versions for p in (*v.paths, *v.gone)}
        old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in used]
        for p in old:
            fs.delete(p, True)
        return len(old)

    def frame(self, t: Table, v: Version) -> DataFrame:
        if v.base is None or v.delta:
            delta = self.spark.createDataFrame([(rid, *values) for rid, values in v.delta], t.struct)
            return delta if v.base is None else v.base.unionByName(delta)
        return v.base

    def on_driver(self, t: Table, rows: tuple[tuple[int, tuple], ...]) -> Version:
        return Version(None, rows, size=_bytes(t, rows)) if len(rows) <= DELTA_ROWS else self.written(t, self.frame(t, Version(None, rows)))

    def version(self, t: Table, frame: DataFrame, large: bool = False) -> Version:
        """`frame` as a version without lineage: few rows come to the driver, those of a table known to be large are written."""
        if large:
            return self.written(t, frame)
        # of a table whose rows are all on the driver, so this launches no scan and is not worth a file
        return self.on_driver(t, tuple(sorted(((r[0], tuple(r[1:])) for r in frame.collect()), key=lambda r: r[0])))

    def _write(self, frame: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return path

    def _read(self, t: Table, paths: tuple[str, ...], gone: tuple[str, ...]) -> DataFrame:
        rows = self.spark.read.schema(t.struct).parquet(*paths)
        return rows.join(self.spark.read.schema(f"{RID} bigint").parquet(*gone), RID, "left_anti") if gone else rows

    def written(self, t: Table, frame: DataFrame) -> Version:
        paths = (self._write(frame.select([f.name for f in t.struct]), t.name),)
        base = self._read(t, paths, ())
        return Version(base, size=_size(t, base), paths=paths)

    def without(self, t: Table, v: Version, rows: DataFrame) -> Version:
        """`v` without `rows`, some of its own: their numbers become one more file, and no other row is written."""
        if v.delta:
            v = self._appended(t, v)
        gone = (*v.gone, self._write(rows.select(RID), f"{t.name}-gone"))
        size = v.size - _size(t, rows)
        if len(gone) > MANY_FILES:
            return self.written(t, self._read(t, v.paths, gone))
        return Version(self._read(t, v.paths, gone), size=size, paths=v.paths, gone=gone)

    def kept(self, frame: DataFrame, large: bool) -> DataFrame:
        """An intermediate result without lineage, computed once: on the driver if the tables it comes from are, else written."""
        if not large:
            return self.spark.createDataFrame([tuple(r) for r in frame.collect()], frame.schema)
        return self.spark.read.schema(frame.schema).parquet(self._write(frame, "step"))

    def _appended(self, t: Table, v: Version) -> Version:
        """The driver's rows as one more file."""
        new = self._write(self.frame(t, Version(None, v.delta)).coalesce(1), t.name)
        paths = (*v.paths, new)
        if len(paths) > MANY_FILES:
            return self.written(t, self._read(t, paths, v.gone))
        return Version(self._read(t, paths, v.gone), size=v.size, paths=paths, gone=v.gone)

    def appended(self, t: Table, v: Version, rid: int, values: tuple) -> Version:
        more = Version(v.base, (*v.delta, (rid, values)), size=v.size + _bytes(t, ((rid, values),)), paths=v.paths, gone=v.gone)
        return more if len(more.delta) <= DELTA_ROWS else self._appended(t, more)

    def has(self, t: Table, v: Version, column: int, value: Any) -> bool:
        """Whether a column holds a value: a look at the driver's rows, then one pushed-down filter on the files."""
        if value in v.key_set(column):
            return True
        return v.base is not None and not v.base.where(F.col(f"c{column}") == F.lit(value)).isEmpty()


__all__ = ["DELTA_ROWS", "RID", "Store", "Version", "encoded_rows"]

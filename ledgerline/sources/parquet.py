"""Parquet tables attached to the dialect's three types; each column's mapping is fixed by its type and a stated unit."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import CENTS, DATE, MICROS, WHOLE
from ..schema import BOOLEAN, INTEGER, TEXT, Column, Table


def mapped(column: str, kind: T.DataType, unit: str | None) -> tuple[str, SparkColumn] | None:
    x = F.col(column)
    if isinstance(kind, T.StringType):
        return TEXT, x
    if isinstance(kind, T.BooleanType):
        return BOOLEAN, x
    if isinstance(kind, T.LongType):
        return INTEGER, x  # as it is, so filters reach the scan
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER, x.cast("bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return INTEGER, x.cast("bigint") if unit == WHOLE else F.round(x * 100).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return (INTEGER, F.unix_micros(x.cast("timestamp"))) if unit == MICROS else (TEXT, F.date_format(x, "yyyy-MM-dd"))
    return None


def attach_parquet(db, name: str, path: str, units: dict[str, str] | None = None) -> Table:
    """Attaches the files at `path`; columns of other types (arrays, maps, structs) are left out. The stored columns stay beside those
    that are made from them, so filters reach the scan; a scan reads them only where a filter names them."""
    raw = db.spark.read.parquet(path)
    columns, cells, stored = [], [], {}
    for f in raw.schema.fields:
        unit = (units or {}).get(f.name)
        found = mapped(f.name, f.dataType, unit)
        if found:
            i = len(columns)
            cells.append(found[1].alias(f"c{i}"))
            if not isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegralType)):
                cells.append(F.col(f.name).alias(f"r{i}"))
                stored[i] = (f.dataType, WHOLE if unit == WHOLE else CENTS if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else MICROS if unit == MICROS else DATE)
            columns.append(Column(f.name.lower(), found[0]))
    t = Table(name, tuple(columns))
    db.attach(t, raw.select(cells), stored)
    return t

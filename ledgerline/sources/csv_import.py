"""CSV files as tables: names normalised, types inferred in one aggregate, blanks NULL."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..metadata import literal
from ..schema import BOOLEAN, INTEGER, SPARK_TYPES, TEXT, Column, Table

NAME = re.compile(r"[a-z_][a-z0-9_]*\Z")
INT = re.compile(r"[+-]?[0-9]+\Z")


@dataclass(frozen=True)
class Imported:
    table: str
    columns: list[tuple[str, str]]
    rows: int
    skipped: int


def normalised(raw: str, fallback: str) -> str:
    name = re.sub(r"[^a-z0-9_]+", "_", raw.strip().lower()).strip("_")
    return name if NAME.match(name) else fallback


def names(header: list[str]) -> list[str]:
    out: list[str] = []
    for i, raw in enumerate(header, 1):
        name = normalised(raw, f"column_{i}")
        while name in out:
            name = f"{name}_{i}"
        out.append(name)
    return out


def separator(text: str) -> str:
    return "\t" if "\t" in text and "," not in text else ","


def records(text: str, delimiter: str = ",") -> list[list[str]]:
    """Quoted fields with doubled quotes, any line ends; empty lines are no records."""
    rows, row, field, quoted, dirty, i = [], [], [], False, False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c != '"':
                field.append(c)
            elif text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            else:
                quoted = False
        elif c == '"':
            quoted = dirty = True
        elif c == delimiter or c in "\r\n":
            row.append("".join(field))
            field, dirty = [], False
            if c != delimiter:
                i += c == "\r" and text[i + 1 : i + 2] == "\n"
                rows.append(row)
                row = []
        else:
            field.append(c)
        i += 1
    if field or dirty or row:
        rows.append([*row, "".join(field)])
    return [r for r in rows if len(r) > 1 or r[0] != ""]


def inferred(values: list[str]) -> str:
    present = [v for v in values if v]
    if not present:
        return TEXT
    if all(v.lower() in ("true", "false") for v in present):
        return BOOLEAN
    return INTEGER if all(INT.match(v) and -(1 << 63) <= int(v) < 1 << 63 for v in present) else TEXT


def statements(text: str, file_name: str, row_limit: int = 500) -> tuple[Imported, list[str]]:
    """The small importer: SQL that recreates the file, at most `row_limit` rows of it, and how many it left out."""
    rows = records(text, separator(text))
    if len(rows) < 2:
        raise ValueError("the file needs a header row and at least one data row")
    table, columns = normalised(re.sub(r"\.[^.]+$", "", file_name), "imported"), names(rows[0])
    cells = [[(r[i] if i < len(r) else "").strip() for i in range(len(columns))] for r in rows[1:]]
    kinds = [inferred([r[i] for r in cells]) for i in range(len(columns))]
    value = lambda v, k: None if v == "" else int(v) if k == INTEGER else v.lower() == "true" if k == BOOLEAN else v
    out = [f"CREATE TABLE {table} ({', '.join(f'{n} {k}' for n, k in zip(columns, kinds, strict=True))})"]
    out += [f"INSERT INTO {table} VALUES ({', '.join(literal(value(v, k)) for v, k in zip(r, kinds, strict=True))})" for r in cells[:row_limit]]
    kept = min(len(cells), row_limit)
    return Imported(table, list(zip(columns, kinds, strict=True)), kept, len(cells) - kept), out


def load_csv(db, path: str, table: str | None = None) -> Imported:
    """The bulk importer: Spark reads the file, one aggregate infers all types, and every row is kept, unlike in the small one, which
    follows the console it stands for in taking `row_limit` rows."""
    spark = db.spark
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    delimiter = separator(first[0][0] if first else "")
    # a quoted line end leaves lines with an odd number of quotes; only then can't a file be split between tasks
    across = lines.agg(F.max(F.expr("(length(value) - length(replace(value, '\"', ''))) % 2"))).first()[0] == 1
    raw = spark.read.option("header", True).option("sep", delimiter).option("multiLine", across).option("quote", '"').option("escape", '"').csv(path)
    columns = names(raw.columns)
    raw = raw.toDF(*(f"r{i}" for i in range(len(columns))))
    cell = [F.coalesce(F.trim(f"r{i}"), F.lit("")) for i in range(len(columns))]
    text = raw.select([c.alias(f"r{i}") for i, c in enumerate(cell)])
    wholes = [F.expr(f"r{i} RLIKE '^[+-]?[0-9]+$' AND try_cast(r{i} AS BIGINT) IS NOT NULL") for i in range(len(columns))]
    tests = []
    for i, whole in enumerate(wholes):
        x, some = F.col(f"r{i}"), F.col(f"r{i}") != ""
        tests += [F.max(some).alias(f"any{i}"), F.min(F.when(some, F.lower(x).isin("true", "false"))).alias(f"bool{i}"), F.min(F.when(some, whole)).alias(f"int{i}")]
    found = text.agg(F.count(F.lit(1)).alias("n"), *tests).first()
    kinds = [TEXT if not found[f"any{i}"] else BOOLEAN if found[f"bool{i}"] else INTEGER if found[f"int{i}"] else TEXT for i in range(len(columns))]
    typed = text.select([F.when(F.col(f"r{i}") != "", F.lower(f"r{i}") == "true" if k == BOOLEAN else F.col(f"r{i}").try_cast(SPARK_TYPES[k])).alias(f"c{i}") for i, k in enumerate(kinds)])
    name = table or normalised(re.sub(r"\.[^.]+$", "", PurePath(path).name), "imported")
    db.load(Table(name, tuple(Column(n, k) for n, k in zip(columns, kinds, strict=True))), typed)
    return Imported(name, list(zip(columns, kinds, strict=True)), found["n"], 0)


def preview(frame: DataFrame, n: int = 10) -> list[tuple]:
    """The first rows, as the importer shows them."""
    return [tuple(r) for r in frame.limit(n).collect()]

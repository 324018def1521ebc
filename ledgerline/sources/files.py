"""Databases in native files: created once, validated on loading, replaced as a whole after each mutation."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from ..results import Outcome

EMPTY = "V2;"


def create(path: str | Path) -> None:
    """Writes an empty database; an existing file is an error."""
    with open(path, "x", encoding="utf-8", newline="") as f:
        f.write(EMPTY)
        f.flush()
        os.fsync(f.fileno())


def load(spark: SparkSession, path: str | Path, limits=None):
    from ..database import Database

    return Database.from_string(spark, Path(path).read_bytes().decode(), limits)


def save(text: str, path: str | Path) -> None:
    """A temporary file in the same folder, synced, then renamed over the old one."""
    path = Path(path)
    handle, temp = tempfile.mkstemp(dir=path.parent or ".", prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def execute(db, path: str | Path, sql: str) -> Outcome:
    """Runs a statement on a copy; a mutation reaches the file before it reaches `db`, and reads never rewrite the file."""
    copy = db.clone()
    out = copy.execute(sql)
    if out.is_mutation:
        save(copy.as_str(), path)
        db._swap(copy)
    return out

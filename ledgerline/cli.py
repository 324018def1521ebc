"""init, shell, exec and dump on a database file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .metadata import TABLES
from .results import Affected, Created, Explanation, Outcome, Rows, RowSet
from .sources import files


def session() -> SparkSession:
    builder = SparkSession.builder.appName("ledgerline").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def complete(text: str) -> bool:
    """Whether a semicolon outside a string ends the text."""
    inside, ended, i = False, False, 0
    while i < len(text):
        c = text[i]
        if c == "'":
            if inside and text[i + 1 : i + 2] == "'":
                i += 1
            else:
                inside = not inside
            ended = False
        elif not inside and c == ";":
            ended = True
        elif not c.isspace():
            ended = False
        i += 1
    return ended and not inside


def headers(rows: RowSet) -> list[str]:
    """Labels, with the table before those that stand for different columns."""
    origins: dict[str, set] = {}
    for c in rows.columns:
        origins.setdefault(c.label, set()).add((c.table, c.column))
    return [f"{c.table}.{c.column}" if len(origins[c.label]) > 1 else c.label for c in rows.columns]


def rendered(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int) else v.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def table(rows: RowSet) -> str:
    body, head = [[rendered(v) for v in r] for r in rows.rows()], headers(rows)
    widths = [max(map(len, column)) for column in zip(head, *body, strict=True)]
    edge = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {c}{' ' * (w - len(c))} " for c, w in zip(r, widths, strict=True)) + "|"
    n = len(body)
    return "\n".join([edge, line(head), edge, *map(line, body), edge, f"{n} row{'' if n == 1 else 's'}"])


def explained(e: Explanation) -> str:
    return f"regex: {e.pattern}\nrows: {'exact' if e.pattern_is_exact else 'prefilter (the plan filters further)'}"


def shown(out: Outcome) -> str:
    if isinstance(out, Rows):
        rows = out.rows
        if [(c.label, c.table) for c in rows.columns] == [("table_name", TABLES), ("create_statement", TABLES)] and len(rows.rows()) == 1:
            return rows.rows()[0][1]
        return table(rows)
    if isinstance(out, Affected):
        return f"affected {out.count} row{'' if out.count == 1 else 's'}"
    return f"created table {out.table}" if isinstance(out, Created) else explained(out.explanation)


def shell(spark: SparkSession, path: str, source=None, sink=None, errors=None) -> int:
    source, sink, errors = source or sys.stdin, sink or sys.stdout, errors or sys.stderr
    db, statement = files.load(spark, path), ""
    interactive = source.isatty()
    while True:
        if interactive:
            print("         > " if statement else "ledgerline> ", end="", file=sink, flush=True)
        line = source.readline()
        if not line:
            if statement.strip():
                print("error: incomplete SQL statement at end of input (expected `;`)", file=errors)
                return 1
            return 0
        if not statement:
            if line.strip() == ".quit":
                return 0
            if line.strip() == ".dump":
                print(db.as_str(), file=sink)
                continue
            if not line.strip():
                continue
        statement += line
        if complete(statement):
            try:
                print(shown(files.execute(db, path, statement)), file=sink)
            except EngineError as e:
                print(f"error: {e}", file=errors)
            statement = ""


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "shell", "exec", "dump"):
        command = commands.add_parser(name)
        command.add_argument("file")
        if name == "exec":
            command.add_argument("sql", nargs=argparse.REMAINDER)
    a = parser.parse_args(arguments)
    try:
        if a.command == "init":
            files.create(a.file)
            return 0
        if a.command == "shell":
            return shell(session(), a.file)
        if a.command == "dump":
            print(files.load(session(), a.file).as_str())
            return 0
        sql = " ".join(a.sql) if a.sql else sys.stdin.read()
        print(shown(files.execute(files.load(session(), a.file), a.file, sql)))
        return 0
    except (EngineError, OSError, UnicodeDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

"""The registered queries of the engine, one for each operator, and SQL that gives the same rows."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .database import Database
from .errors import EngineError
from .limits import Limits
from .schema import Column, ForeignKey, Table
from .sources.csv_import import load_csv, statements
from .sources.parquet import WHOLE, attach_parquet

#: For tables of any size.
BULK = Limits(max_database_bytes=1 << 62)
UNITS = {"lineitem": {"l_quantity": WHOLE}, "events": {"ts": "micros"}}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Views of the files as the attached tables have them.
VIEWS = {
    "region": "SELECT CAST(r_regionkey AS BIGINT) r_regionkey, r_name FROM region",
    "nation": "SELECT CAST(n_nationkey AS BIGINT) n_nationkey, n_name, CAST(n_regionkey AS BIGINT) n_regionkey FROM nation",
    "customer": "SELECT CAST(c_custkey AS BIGINT) c_custkey, c_name, CAST(c_nationkey AS BIGINT) c_nationkey, CAST(ROUND(c_acctbal * 100) AS BIGINT) c_acctbal, c_mktsegment FROM customer",
    "orders": "SELECT CAST(o_orderkey AS BIGINT) o_orderkey, CAST(o_custkey AS BIGINT) o_custkey, o_orderstatus, CAST(ROUND(o_totalprice * 100) AS BIGINT) o_totalprice, strftime(o_orderdate, '%Y-%m-%d') o_orderdate, o_orderpriority FROM orders",
}


def _database(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    db = Database(spark)
    for t in tables:
        attach_parquet(db, t, f"{sf_dir}/{t}.parquet", UNITS.get(t))
    return db


def on_files(name: str, sql: str, oracle: str | None, *tables: str, labels: tuple[str, ...] = ()) -> None:
    """A SELECT over attached files. `oracle` is SQL over the files themselves."""
    QUERIES[name] = lambda spark, sf_dir: _database(spark, sf_dir, *tables).query(sql).named(*labels)
    if oracle is not None:
        ORACLES[name] = oracle


def in_memory(name: str, script: list[str], sql: str, oracle: str | None, labels: tuple[str, ...] = ()) -> None:
    """Statements on an empty database, then a SELECT; a statement after ! must fail and change nothing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark)
        for s in script:
            if not s.startswith("!"):
                db.execute(s)
                continue
            before = db.as_str()
            try:
                db.execute(s[1:])
            except EngineError:
                if db.as_str() != before:
                    raise AssertionError(f"a failed statement changed the database: {s}") from None
            else:
                raise AssertionError(f"no error: {s}")
        rows = db.query(sql)
        if rows.values is None:
            return rows.named(*labels)
        kinds = {"TEXT": "string", "INTEGER": "bigint", "BOOLEAN": "boolean"}
        names = labels or [c.label for c in rows.columns]
        return spark.createDataFrame(rows.rows(), ", ".join(f"`{n}` {kinds[c.type]}" for n, c in zip(names, rows.columns, strict=True)))

    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


# -- scans and projections
LINEITEM = "CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"
on_files("scan_star", "SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region", "region")
on_files("project_dup", "SELECT n_name, n_regionkey, n_name FROM nation", "SELECT n_name AS a, CAST(n_regionkey AS BIGINT) AS b, n_name AS c FROM nation", "nation", labels=("a", "b", "c"))
on_files("qualified_star", "SELECT nation.*, region.r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
# -- predicates
on_files("filter_eq_text", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders WHERE o_orderstatus = 'F'", "orders")
on_files("filter_eq_int", "SELECT n_name FROM nation WHERE n_regionkey = 3", "SELECT n_name FROM nation WHERE n_regionkey = 3", "nation")
on_files("filter_ne", "SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING'", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'", "customer")
for op, sign in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    on_files(f"filter_{op}", f"SELECT p_partkey, p_size FROM part WHERE p_size {sign} 25", f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size {sign} 25", "part")
on_files("filter_date_order", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01'", "orders")
for kind, pattern, column in (("prefix", "red%", "p_name"), ("suffix", "%bolt", "p_name"), ("infix", "%ed%", "p_name"), ("underscore", "Brand#_", "p_brand")):
    on_files(f"like_{kind}", f"SELECT p_partkey, {column} FROM part WHERE {column} LIKE '{pattern}'", f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {column} FROM part WHERE {column} LIKE '{pattern}' ESCAPE '\\'", "part")
on_files("in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey FROM part WHERE p_size IN (1, 5, 9)", "part")
on_files("in_text", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer")
on_files("and_or_precedence", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag = 'R' OR l_returnflag = 'A' AND l_quantity < 10", f"SELECT {LINEITEM}, l_returnflag, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem WHERE l_returnflag = 'R' OR l_returnflag = 'A' AND l_quantity < 10", "lineitem")
on_files("parentheses", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') AND l_quantity < 10", f"SELECT {LINEITEM}, l_returnflag, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') AND l_quantity < 10", "lineitem")
TRUTH = ["CREATE TABLE t (id INTEGER PRIMARY KEY, a BOOLEAN, b BOOLEAN)", *(f"INSERT INTO t VALUES ({3 * i + j}, {a}, {b})" for i, a in enumerate(("TRUE", "FALSE", "NULL")) for j, b in enumerate(("TRUE", "FALSE", "NULL")))]
TRUTH_VALUES = "(VALUES " + ", ".join(f"({3 * i + j}, {a}::BOOLEAN, {b}::BOOLEAN)" for i, a in enumerate(("TRUE", "FALSE", "NULL")) for j, b in enumerate(("TRUE", "FALSE", "NULL"))) + ") t(id, a, b)"
for name, condition in (("where_3vl", "a = TRUE AND b != FALSE OR a IS NULL AND b = FALSE"), ("filter_bool_eq", "a = FALSE"), ("filter_bool_order", "a < TRUE AND b >= FALSE"), ("is_null", "a IS NULL"), ("is_not_null", "b IS NOT NULL")):
    in_memory(name, TRUTH, f"SELECT * FROM t WHERE {condition}", f"SELECT CAST(id AS BIGINT) AS id, a, b FROM {TRUTH_VALUES} WHERE {condition}")
USERS = ["CREATE TABLE users (id INTEGER PRIMARY KEY, email TEXT, age INTEGER)", "INSERT INTO users VALUES (1, 'a%b@x', 30)", "INSERT INTO users VALUES (2, NULL, 20)", "INSERT INTO users VALUES (3, 'a_b@y', NULL)", "INSERT INTO users VALUES (4, 'ab@z', 30)"]
USER_VALUES = "(VALUES (1, 'a%b@x', 30), (2, NULL, 20), (3, 'a_b@y', NULL), (4, 'ab@z', 30)) u(id, email, age)"
USER_COLUMNS = "CAST(id AS BIGINT) AS id, email, CAST(age AS BIGINT) AS age"
in_memory("like_escape", USERS, r"SELECT * FROM users WHERE email LIKE 'a\%b%' OR email LIKE 'a\_%'", rf"SELECT {USER_COLUMNS} FROM {USER_VALUES} WHERE email LIKE 'a\%b%' ESCAPE '\' OR email LIKE 'a\_%' ESCAPE '\'")
in_memory("in_with_null", USERS, "SELECT * FROM users WHERE age IN (30, NULL)", f"SELECT {USER_COLUMNS} FROM {USER_VALUES} WHERE age IN (30, NULL)")
# -- joins
on_files("join_inner", "SELECT c_custkey, n_name FROM customer INNER JOIN nation ON customer.c_nationkey = nation.n_nationkey", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
on_files("join_multi_condition", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(s_suppkey AS BIGINT) AS s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey", "customer", "supplier")
on_files("join_chain3", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "orders", "customer", "nation")
CHAIN = "FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE r_name = 'ASIA' AND o_orderstatus = 'F'"
on_files("join_chain6", f"SELECT l_orderkey, l_linenumber, n_name, p_name {CHAIN}", f"SELECT {LINEITEM}, n_name, p_name {CHAIN}", "region", "nation", "customer", "orders", "lineitem", "part")
PAIRS = ["CREATE TABLE l (id INTEGER, k INTEGER)", "CREATE TABLE r (k INTEGER, name TEXT)", *(f"INSERT INTO l VALUES ({i}, {k})" for i, k in enumerate((1, 1, 2, "NULL"))), *(f"INSERT INTO r VALUES ({k}, '{n}')" for k, n in ((1, "x"), (1, "y"), ("NULL", "z"), (3, "w")))]
in_memory("join_many_to_many", PAIRS, "SELECT l.id, r.name FROM l JOIN r ON l.k = r.k", values("id, name", "(0::BIGINT, 'x')", "(0, 'y')", "(1, 'x')", "(1, 'y')"))
in_memory("join_null_keys", PAIRS, "SELECT l.id, r.name FROM l JOIN r ON l.k = r.k WHERE l.k IS NULL", "SELECT 0::BIGINT AS id, '' AS name WHERE false")
on_files("join_local_residual", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)", "orders", "customer")
on_files("join_cross_residual", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' OR c_mktsegment = 'BUILDING'", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' OR c_mktsegment = 'BUILDING'", "orders", "customer")
# -- order and pages
on_files("order_multi", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM nation", "nation")
on_files("order_hidden_key", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10", "SELECT c_name FROM customer ORDER BY ROUND(c_acctbal * 100) DESC, c_custkey LIMIT 10", "customer")
in_memory("order_nulls_asc", USERS, "SELECT id, age FROM users ORDER BY age ASC LIMIT 3", f"SELECT CAST(id AS BIGINT) AS id, CAST(age AS BIGINT) AS age FROM {USER_VALUES} ORDER BY age ASC NULLS LAST, id LIMIT 3")
in_memory("order_nulls_desc", USERS, "SELECT id, age FROM users ORDER BY age DESC LIMIT 2", f"SELECT CAST(id AS BIGINT) AS id, CAST(age AS BIGINT) AS age FROM {USER_VALUES} ORDER BY age DESC NULLS FIRST, id LIMIT 2")
TOP = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS o_totalprice FROM orders"
BY = "ORDER BY o_totalprice DESC, o_orderkey"
for name, tail in (("topk", "LIMIT 10"), ("topk_offset", "LIMIT 10 OFFSET 7"), ("offset_only", "OFFSET 14000"), ("limit_zero", "LIMIT 0"), ("offset_past_end", "LIMIT 5 OFFSET 99999999"), ("limit_u64_max", "LIMIT 18446744073709551615"), ("offset_u64_max", "OFFSET 18446744073709551615")):
    plain = {"limit_u64_max": "", "offset_u64_max": "LIMIT 0"}.get(name, tail)
    on_files(name, f"SELECT o_orderkey, o_totalprice FROM orders {BY} {tail}", f"SELECT * FROM ({TOP}) {BY} {plain}", "orders")
# -- INSERT, UPDATE, DELETE
in_memory("insert_positional", ["CREATE TABLE t (a INTEGER, b TEXT, c BOOLEAN)", "INSERT INTO t VALUES (-9223372036854775808, 'it''s', TRUE)", "INSERT INTO t VALUES (NULL, NULL, NULL)"], "SELECT * FROM t", values("a, b, c", "(-9223372036854775807::BIGINT - 1, 'it''s', TRUE)", "(NULL, NULL, NULL)"))
in_memory("insert_named_default", ["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT DEFAULT 'x', c BOOLEAN)", "INSERT INTO t (c, a) VALUES (TRUE, 1)", "INSERT INTO t (a, b) VALUES (2, NULL)"], "SELECT * FROM t", values("a, b, c", "(1::BIGINT, 'x', TRUE)", "(2, NULL, NULL)"))
in_memory("autoincrement", ["CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, b TEXT)", "INSERT INTO t (b) VALUES ('a')", "INSERT INTO t VALUES (10, 'b')", "INSERT INTO t VALUES (5, 'c')", "INSERT INTO t VALUES (NULL, 'd')"], "SELECT * FROM t", values("id, b", "(1::BIGINT, 'a')", "(10, 'b')", "(5, 'c')", "(11, 'd')"))
in_memory("update_where", [*USERS, "UPDATE users SET age = 31, email = NULL WHERE age = 30"], "SELECT * FROM users", values("id, email, age", "(1::BIGINT, NULL, 31::BIGINT)", "(2, NULL, 20)", "(3, 'a_b@y', NULL)", "(4, NULL, 31)"))
in_memory("update_all", [*USERS, "UPDATE users SET age = 1"], "SELECT id, age FROM users", values("id, age", "(1::BIGINT, 1::BIGINT)", "(2, 1)", "(3, 1)", "(4, 1)"))
in_memory("delete_where", [*USERS, "DELETE FROM users WHERE age = 30"], "SELECT id FROM users", values("id", "(2::BIGINT)", "(3)"))
in_memory("delete_all", [*USERS, "DELETE FROM users"], "SELECT id FROM users", "SELECT 0::BIGINT AS id WHERE false")


def family(action: str) -> list[str]:
    return ["CREATE TABLE p (id INTEGER PRIMARY KEY)", f"CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) {action})", *(f"INSERT INTO p VALUES ({i})" for i in (1, 2)), *(f"INSERT INTO c VALUES ({i}, {p})" for i, p in ((10, 1), (11, 2), (12, 1), (13, "NULL")))]


in_memory("delete_cascade", [*family("ON DELETE CASCADE"), "DELETE FROM p WHERE id = 1"], "SELECT * FROM c", values("id, p", "(11::BIGINT, 2::BIGINT)", "(13, NULL)"))
in_memory("delete_set_null", [*family("ON DELETE SET NULL"), "DELETE FROM p WHERE id = 1"], "SELECT * FROM c", values("id, p", "(10::BIGINT, NULL::BIGINT)", "(11, 2)", "(12, NULL)", "(13, NULL)"))
in_memory("update_cascade", [*family("ON UPDATE CASCADE"), "UPDATE p SET id = 9 WHERE id = 1"], "SELECT * FROM c", values("id, p", "(10::BIGINT, 9::BIGINT)", "(11, 2)", "(12, 9)", "(13, NULL)"))
in_memory("cascade_cycle", ["CREATE TABLE n (id INTEGER PRIMARY KEY, up INTEGER REFERENCES n(id) ON DELETE CASCADE)", "INSERT INTO n VALUES (1, 1)", "INSERT INTO n VALUES (2, 1)", "INSERT INTO n VALUES (3, 2)", "INSERT INTO n VALUES (4, NULL)", "UPDATE n SET up = 3 WHERE id = 1", "DELETE FROM n WHERE id = 2"], "SELECT * FROM n", values("id, up", "(4::BIGINT, NULL::BIGINT)"))
in_memory("restrict_blocks", [*family(""), "!DELETE FROM p WHERE id = 1", "!UPDATE p SET id = 5 WHERE id = 1"], "SELECT * FROM p", values("id", "(1::BIGINT)", "(2)"))
in_memory("unique_blocks", ["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT UNIQUE)", "INSERT INTO t VALUES (1, 'x')", "!INSERT INTO t VALUES (2, 'x')", "!INSERT INTO t VALUES (1, 'y')", "INSERT INTO t VALUES (2, NULL)", "INSERT INTO t VALUES (3, NULL)", "!UPDATE t SET b = 'x'"], "SELECT * FROM t", values("a, b", "(1::BIGINT, 'x')", "(2, NULL)", "(3, NULL)"))
in_memory("check_blocks", ["CREATE TABLE t (a INTEGER CHECK (a > 0 AND a < 10), b TEXT)", "INSERT INTO t VALUES (5, 'x')", "INSERT INTO t VALUES (NULL, 'y')", "!INSERT INTO t VALUES (10, 'z')", "!UPDATE t SET a = 0 WHERE b = 'x'"], "SELECT * FROM t", values("a, b", "(5::BIGINT, 'x')", "(NULL, 'y')"))
in_memory("fk_blocks", [*family("ON DELETE CASCADE"), "!INSERT INTO c VALUES (20, 7)", "!UPDATE c SET p = 8 WHERE id = 10"], "SELECT * FROM c", values("id, p", "(10::BIGINT, 1::BIGINT)", "(11, 2)", "(12, 1)", "(13, NULL)"))


def delete_cascade_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and lines as managed tables; one DELETE takes a nation's customers and all that hangs on them."""
    source = _database(spark, sf_dir, "customer", "orders", "lineitem")
    db = Database(spark, BULK)
    keys = {"customer": (("c_custkey", "c_nationkey"), ()), "orders": (("o_orderkey", "o_custkey"), ((1, "customer"),)), "lineitem": (("l_orderkey", "l_linenumber", "l_quantity"), ((0, "orders"),))}
    for name, (columns, foreign) in keys.items():
        rows = source.query(f"SELECT {', '.join(columns)} FROM {name}").dataframe
        fks = tuple(ForeignKey(i, parent, keys[parent][0][0], "CASCADE") for i, parent in foreign)
        primary = None if name == "lineitem" else 0
        t = Table(name, tuple(Column(c, "INTEGER", i != primary) for i, c in enumerate(columns)), primary, (), fks)
        db.load(t, rows.toDF(*(f"c{i}" for i in range(len(columns)))))
    db.execute("DELETE FROM customer WHERE c_nationkey = 3")
    return db.query("SELECT * FROM lineitem").named()


QUERIES["attach_then_delete_cascade"] = delete_cascade_at_scale
ORACLES["attach_then_delete_cascade"] = f"SELECT {LINEITEM}, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3"
# -- metadata, formats, surfaces
in_memory("show_tables", [*family(""), "CREATE TABLE a (x TEXT)"], "SHOW TABLES", values("table_name", "('p')", "('c')", "('a')"))
in_memory("describe", ["CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, b TEXT UNIQUE DEFAULT 'it''s', c BOOLEAN NOT NULL)"], "DESCRIBE t", values('column_name, data_type, nullable, primary_key, "unique", default_value, auto_increment', "('id', 'INTEGER', FALSE, TRUE, TRUE, NULL, TRUE)", "('b', 'TEXT', TRUE, FALSE, TRUE, '''it''''s''', FALSE)", "('c', 'BOOLEAN', FALSE, FALSE, FALSE, NULL, FALSE)"))
in_memory("show_create", [*family("ON DELETE CASCADE"), 'CREATE TABLE t (id INTEGER PRIMARY KEY, "order" TEXT, CHECK (id > 0 AND "order" IS NOT NULL))'], "SHOW CREATE TABLE t", values("table_name, create_statement", """('t', 'CREATE TABLE t (id INTEGER NOT NULL PRIMARY KEY, "order" TEXT, CHECK ((id > 0 AND "order" IS NOT NULL)))')"""))


def explain_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.execute("CREATE TABLE t (a INTEGER NOT NULL, b TEXT)")
    e = db.explain_select("SELECT a FROM t WHERE b LIKE 'x%' AND a != 3")
    return spark.createDataFrame([(e.pattern, e.pattern_is_exact)], "pattern string, exact boolean")


QUERIES["explain_pattern"] = explain_pattern
ORACLES["explain_pattern"] = r"SELECT '~R\|t\|(?=I(?:0|-?[1-9][0-9]*)\|Tx(?:%[0-9A-F]{6}|[^%|;~])*;)(?=(?!I3\|)I(?:0|-?[1-9][0-9]*)\|)I(?:0|-?[1-9][0-9]*)\|(?:N|T(?:%[0-9A-F]{6}|[^%|;~])*);' AS pattern, TRUE AS exact"


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    for s in [*USERS, "INSERT INTO users VALUES (5, '~|;%\n', -1)"]:
        db.execute(s)
    again = Database.from_string(spark, db.as_str())
    if again.as_str() != db.as_str():
        raise AssertionError("the string changed on its way")
    return again.query("SELECT * FROM users").named()


QUERIES["codec_roundtrip"] = codec_roundtrip
ORACLES["codec_roundtrip"] = f"SELECT {USER_COLUMNS} FROM {USER_VALUES} UNION ALL SELECT 5, '~|;%' || chr(10), -1"


def encode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a canonical record, by Spark expressions."""
    source = _database(spark, sf_dir, "orders")
    t = source.catalog.tables["orders"]
    db = Database(spark, BULK)
    db.load(t, source.versions["orders"].base)
    return db.encoded_frame().select("record")


QUERIES["encode_orders"] = encode_orders
ORACLES["encode_orders"] = f"SELECT '~R|orders|I' || o_orderkey || '|I' || o_custkey || '|T' || o_orderstatus || '|I' || o_totalprice || '|T' || o_orderdate || '|T' || o_orderpriority || ';' AS record FROM ({VIEWS['orders']})"


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small importer, from a text."""
    db = Database(spark)
    found, script = statements('Id,Full Name,ok\n1,"A, ""B""",true\n2,,FALSE\n', "My File.csv")
    for s in script:
        db.execute(s)
    return db.query(f"SELECT * FROM {found.table}").named()


QUERIES["csv_import"] = csv_import
ORACLES["csv_import"] = values("id, full_name, ok", """(1::BIGINT, 'A, "B"', TRUE)""", "(2, NULL, FALSE)")


def csv_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk importer, from files that Spark writes and reads."""
    from .sources.tables import Store

    root = f"{Store(spark).path}/orders.csv"
    source = _database(spark, sf_dir, "orders")
    source.query("SELECT * FROM orders").named().write.mode("overwrite").option("header", True).csv(root)
    db = Database(spark, BULK)
    load_csv(db, root, "orders")
    return db.query("SELECT * FROM orders").named()


QUERIES["csv_bulk"] = csv_bulk
ORACLES["csv_bulk"] = VIEWS["orders"]


def file_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database file, created, changed and read again; it is the driver's alone."""
    from .sources import files

    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "db"
        files.create(path)
        db = files.load(spark, path)
        for s in USERS:
            files.execute(db, path, s)
        return files.load(spark, path).query("SELECT * FROM users").named()


QUERIES["file_replace"] = file_replace
ORACLES["file_replace"] = f"SELECT {USER_COLUMNS} FROM {USER_VALUES}"
# -- errors: each statement with the class, wording and span of its error, after which nothing has changed
def rejected(name: str, script: list[str], cases: list[tuple[str, str, str, tuple[int, int] | None]], limits: Limits | None = None) -> None:
    """Statements that must fail on the database that `script` makes; a row for each with what it failed by."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, limits)
        for statement in script:
            db.execute(statement)
        before, rows = db.as_str(), []
        for n, (statement, *_) in enumerate(cases):
            try:
                db.execute(statement)
                rows.append((n, "none", "no error", None, None))
            except EngineError as e:
                span = getattr(e, "span", (None, None))
                rows.append((n, e.kind, e.message, *span))
            if db.as_str() != before:
                rows.append((n, "changed", "the database changed", None, None))
        return spark.createDataFrame(rows, "n int, kind string, message string, span_start bigint, span_end bigint")

    QUERIES[name] = run
    text = lambda v: "'" + v.replace("'", "''") + "'"
    number = lambda v: "NULL::BIGINT" if v is None else f"{v}::BIGINT"
    ORACLES[name] = values("n, kind, message, span_start, span_end", *(f"({n}, {text(kind)}, {text(message)}, {number(span and span[0])}, {number(span and span[1])})" for n, (_, kind, message, span) in enumerate(cases)))


def computed(name: str, run: Query, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


FAMILY = ["CREATE TABLE a (id INTEGER PRIMARY KEY, t TEXT)", "CREATE TABLE b (id INTEGER, a INTEGER REFERENCES a(id), s TEXT NOT NULL)", "INSERT INTO a VALUES (1, 'x')"]
rejected("errors_join_types", FAMILY, [("SELECT * FROM a JOIN b ON a.id = b.s", "type", 'JOIN columns "a"."id" and "b"."s" have different types', None), ("SELECT * FROM a JOIN b ON a.t = b.a", "type", 'JOIN columns "a"."t" and "b"."a" have different types', None)])
rejected("errors_sources", FAMILY, [("SELECT * FROM a JOIN b ON a.id = b.a JOIN c ON c.id = a.id", "resource_limit", "JOIN sources", None), ("SELECT * FROM a JOIN a ON a.id = a.id", "schema", 'table "a" appears more than once in a SELECT', None), ("SELECT * FROM b JOIN zz ON a.id = b.a", "schema", 'unknown table "zz"', None)], Limits(max_join_sources=2))
rejected("errors_tail", FAMILY, [
    ("SELECT * FROM a LIMIT 1 ORDER BY id", "parse", "ORDER BY must precede LIMIT and OFFSET", (24, 29)),
    ("SELECT * FROM a OFFSET 1 LIMIT 1", "parse", "LIMIT must precede OFFSET", (25, 30)),
    ("SELECT * FROM a LIMIT 1 LIMIT 2", "parse", "duplicate LIMIT clause", (24, 29)),
    ("SELECT * FROM a LIMIT -1", "parse", "LIMIT requires an unsigned integer", (22, 24)),
])
rejected("errors_predicate_budget", FAMILY, [("SELECT * FROM a WHERE id = 1 AND id = 2 OR id = 3", "resource_limit", "WHERE predicates", None), ("SELECT * FROM a WHERE nope IN (1, 2, 3)", "resource_limit", "WHERE predicates", None), ("SELECT * FROM a WHERE nope = 1", "schema", 'unknown column "nope" in table "a"', None)], Limits(max_predicates=2))
rejected("errors_check_budget", [], [("CREATE TABLE t (a INTEGER CHECK (a > 0), CHECK (a < 9 OR a = 20))", "resource_limit", "CHECK predicates", None)], Limits(max_predicates=2))
rejected("errors_not_null", FAMILY, [("INSERT INTO b VALUES (1, 1, NULL)", "type", 'column "s" is NOT NULL', None), ("INSERT INTO a (t) VALUES ('q')", "type", 'column "id" is NOT NULL', None), ("CREATE TABLE u (x TEXT NOT NULL NOT NULL)", "schema", 'duplicate NOT NULL declaration for column "x"', None), ("UPDATE a SET id = NULL", "type", 'column "id" is NOT NULL', None)])
rejected("errors_values", FAMILY, [("INSERT INTO a VALUES (1)", "type", 'table "a" expects 2 values, got 1', None), ("INSERT INTO a (id, id) VALUES (1, 2)", "schema", 'duplicate INSERT column "id"', None), ("INSERT INTO a (id) VALUES (1, 2)", "type", "INSERT names 1 columns but supplies 2 values", None), ("UPDATE a SET t = 'x', t = 'y'", "schema", 'duplicate UPDATE assignment for column "t"', None), ("INSERT INTO a VALUES ('1', 'x')", "type", 'column "id" expects INTEGER, got TEXT', None)])
rejected("errors_lexer", FAMILY, [
    ("SELECT * FROM a -- all", "unsupported", "SQL comments", (16, 22)),
    ("SELECT 'é FROM a", "parse", "unterminated string literal", (7, 17)),
    ("SELECT ? FROM a", "parse", "unexpected character '?'", (7, 8)),
    ("SELECT * FROM a WHERE id = 1x", "parse", "malformed numeric token", (27, 29)),
    ('SELECT "q FROM a', "parse", "unterminated quoted identifier", (7, 16)),
])
rejected("errors_parser", FAMILY, [("", "parse", "expected a SQL statement", (0, 0)), ("42", "parse", "expected a SQL statement", (0, 2)), ("MERGE INTO a", "unsupported", "statement `MERGE`", (0, 5))])
rejected("errors_order", FAMILY, [("SELECT * FROM a ORDER BY 1", "unsupported", "ORDER BY ordinals", (25, 26)), ("SELECT * FROM a ORDER BY id NULLS FIRST", "unsupported", "ORDER BY NULLS FIRST/LAST", (28, 33)), ("SELECT * FROM a ORDER BY id COLLATE x", "unsupported", "ORDER BY COLLATE", (28, 35))])
rejected("errors_trailing", FAMILY, [("SELECT * FROM a u", "unsupported", "trailing SQL syntax", (16, 17)), ("DELETE FROM a ORDER BY id", "unsupported", "ORDER BY", (14, 19)), ("UPDATE a SET t = 'x' LIMIT 1", "unsupported", "LIMIT", (21, 26)), ("SELECT * FROM a GROUP BY id", "unsupported", "GROUP BY", (16, 21)), ("SELECT * FROM a LEFT JOIN b ON a.id = b.a", "unsupported", "outer joins", (16, 20))])
rejected("errors_precedence", FAMILY, [("SELECT nope FROM a WHERE 'x", "parse", "unterminated string literal", (25, 27)), ("UPDATE a SET id < 1", "unsupported", "ordered comparisons", (16, 17))])
rejected("limit_sql_bytes", [], [("SELECT * FROM a WHERE id = 1", "resource_limit", "SQL bytes", None)], Limits(max_sql_bytes=20))
rejected("limit_pattern_bytes", ["CREATE TABLE t (a TEXT)"], [("SELECT * FROM t WHERE a = 'xxxxxxxxxxxxxxxxxxxx'", "resource_limit", "generated regex bytes", None)], Limits(max_pattern_bytes=60))
rejected("limit_output_bytes", ["CREATE TABLE t (abc TEXT)"], [("SELECT abc, abc, abc, abc FROM t", "resource_limit", "query output bytes", None)], Limits(max_query_output_bytes=10))
rejected("limit_database_bytes", ["CREATE TABLE t (a TEXT)", "INSERT INTO t VALUES ('0123456789')"], [("INSERT INTO t VALUES ('0123456789')", "resource_limit", "database bytes", None), ("UPDATE t SET a = '0123456789012345678901234567890123456789'", "resource_limit", "database bytes", None)], Limits(max_database_bytes=40))


def result_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, origin, type and nullability of every output column, those of a statement without rows included."""
    db = Database(spark)
    for s in FAMILY:
        db.execute(s)
    found = db.query("SELECT b.s, a.*, b.s FROM a JOIN b ON a.id = b.a LIMIT 0").columns
    return spark.createDataFrame([(n, c.label, c.table, c.column, c.type, c.nullable) for n, c in enumerate(found)], 'n int, label string, "table" string, "column" string, type string, nullable boolean'.replace('"', "`"))


computed("result_metadata", result_metadata, values('n, label, "table", "column", type, nullable', "(0, 's', 'b', 's', 'TEXT', FALSE)", "(1, 'id', 'a', 'id', 'INTEGER', FALSE)", "(2, 't', 'a', 't', 'TEXT', TRUE)", "(3, 's', 'b', 's', 'TEXT', FALSE)"))


def format_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of the string: the first of the newer features changes it, and nothing changes it back."""
    rows = []
    for n, feature in enumerate(("", "DEFAULT 'x'", "UNIQUE", "CHECK (a != 'q')", "PRIMARY KEY UNIQUE")):
        db = Database(spark)
        db.execute(f"CREATE TABLE t (a TEXT {feature})")
        db.execute("CREATE TABLE later (b TEXT)")
        rows.append((n, db.as_str()[:3]))
    return spark.createDataFrame(rows, "n int, header string")


computed("format_upgrade", format_upgrade, values("n, header", "(0, 'V2;')", "(1, 'V3;')", "(2, 'V3;')", "(3, 'V3;')", "(4, 'V2;')"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An UPDATE moves a sequence if it matches a row, and a cascade moves the child's."""
    db = Database(spark)
    for s in (
        "CREATE TABLE p (id INTEGER PRIMARY KEY AUTOINCREMENT, x TEXT)", "CREATE TABLE c (id INTEGER PRIMARY KEY AUTOINCREMENT REFERENCES p(id) ON UPDATE CASCADE, y TEXT)",
        "INSERT INTO p (x) VALUES ('a')", "INSERT INTO c (id) VALUES (1)", "UPDATE p SET id = 900 WHERE id = 77", "UPDATE p SET id = 40 WHERE id = 1", "INSERT INTO p (x) VALUES ('b')", "UPDATE c SET y = 'z'", "INSERT INTO p (id) VALUES (50)", "UPDATE c SET id = 50", "INSERT INTO p (x) VALUES ('d')", "INSERT INTO c (y) VALUES ('w')",
    ):
        db.execute(s)
    return spark.createDataFrame([(t, *r) for t in "pc" for r in db.query(f"SELECT * FROM {t}").rows()], "t string, id bigint, x string")


computed("sequence_on_update", sequences, values("t, id, x", "('p', 40::BIGINT, 'a')", "('p', 41, 'b')", "('p', 50, NULL)", "('p', 51, 'd')", "('c', 50, 'z')", "('c', 51, 'w')"))
in_memory("statement_snapshot", ["CREATE TABLE n (id INTEGER PRIMARY KEY, up INTEGER REFERENCES n(id) ON DELETE SET NULL, v INTEGER)", "INSERT INTO n VALUES (1, NULL, 1)", "INSERT INTO n VALUES (2, 1, 1)", "INSERT INTO n VALUES (3, 2, 2)", "UPDATE n SET v = 2, up = NULL WHERE v = 1", "DELETE FROM n WHERE up IS NULL"], "SELECT * FROM n", values("id, up, v", "(3::BIGINT, NULL::BIGINT, 2::BIGINT)"))


def corrupt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of the first record that breaks a constraint: of three equal keys the second is the fault."""
    rows = []
    for n, (columns, cells) in enumerate((("a INTEGER PRIMARY KEY", ("I1", "I1", "I1")), ("a TEXT UNIQUE", ("Tx", "Ty", "Tx", "Tx")))):
        db = Database(spark)
        db.execute(f"CREATE TABLE t ({columns})")
        head = db.as_str()
        try:
            Database.from_string(spark, head + "".join(f"~R|t|{c};" for c in cells))
        except EngineError as e:
            rows.append((n, e.kind, (e.offset - len(head)) // len(f"~R|t|{cells[0]};"), (e.offset - len(head)) % len(f"~R|t|{cells[0]};")))
    return spark.createDataFrame(rows, "n int, kind string, record bigint, rest bigint")


computed("corrupt_offset", corrupt_rows, values("n, kind, record, rest", "(0, 'corrupt_storage', 1::BIGINT, 0::BIGINT)", "(1, 'corrupt_storage', 2, 0)"))


def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the JSON console: a table, a row, a mutation with its scan, an error with its span, a string loaded or refused."""
    import json

    from .envelope import Console

    c = Console(spark)
    replies = [c.exec("CREATE TABLE t (a INTEGER, b TEXT)"), c.exec("INSERT INTO t VALUES (9007199254740993, 'x')"), c.exec("SELECT * FROM t WHERE b = 'x'"), c.exec("UPDATE t SET b = 'y' WHERE a = 1"), c.exec("SELEC"), c.load("V9;"), c.load("V2;"), c.explain("SELECT a FROM t")]
    rows = []
    for n, text in enumerate(replies):
        r = json.loads(text)
        cells = r.get("result", {}).get("rows", [])
        rows.append((n, r["ok"], r.get("kind"), r.get("error", {}).get("kind"), json.dumps(cells, separators=(",", ":")), len(r["scan"]["matches"]) if r.get("scan") else None))
    return spark.createDataFrame(rows, "n int, ok boolean, kind string, error string, cells string, matches int")


computed("json_console", console, values("n, ok, kind, error, cells, matches", "(0, TRUE, 'created', NULL, '[]', NULL::INTEGER)", "(1, TRUE, 'affected', NULL, '[]', NULL)", """(2, TRUE, 'rows', NULL, '[[{"type":"INTEGER","value":"9007199254740993"},{"type":"TEXT","value":"x"}]]', 1)""", "(3, TRUE, 'affected', NULL, '[]', 0)", "(4, FALSE, NULL, 'unsupported', '[]', NULL)", "(5, FALSE, NULL, 'corrupt_storage', '[]', NULL)", "(6, TRUE, 'loaded', NULL, '[]', NULL)", "(7, FALSE, NULL, 'schema', '[]', NULL)"))


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line and the shell print, a row for each line."""
    import contextlib
    import io

    from . import cli

    path = str(Path(tempfile.mkdtemp()) / "db")
    out, err = io.StringIO(), io.StringIO()
    try:
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            codes = [cli.main(["init", path]), cli.main(["init", path])]
            text = "CREATE TABLE t (a INTEGER,\nb TEXT);\nINSERT INTO t VALUES (1, 'x;\ty');\nSELECT * FROM t;\nSELEC;\nSHOW CREATE TABLE t;\nEXPLAIN REGEX SELECT a FROM t;\n.dump\n.quit\n"
            codes.append(cli.shell(spark, path, io.StringIO(text), out, err))
            codes.append(cli.shell(spark, path, io.StringIO("SELECT 1"), out, err))
    finally:
        shutil.rmtree(Path(path).parent)
    lines = [("out", x) for x in out.getvalue().splitlines()] + [("err", x if not x.startswith("error: [Errno") else "error: exists") for x in err.getvalue().splitlines()] + [("code", str(c)) for c in codes]
    return spark.createDataFrame([(n, *x) for n, x in enumerate(lines)], "n int, stream string, line string")


PRINTED = [("out", x) for x in ("created table t", "affected 1 row", "+---+-------+", "| a | b     |", "+---+-------+", "| 1 | x;\\ty |", "+---+-------+", "1 row", "CREATE TABLE t (a INTEGER, b TEXT)", r"regex: ~R\|t\|(?:N|I(?:0|-?[1-9][0-9]*))\|(?:N|T(?:%[0-9A-F]{6}|[^%|;~])*);", "rows: exact")]
ERRORS = [("err", x) for x in ("error: exists", "error: unsupported SQL feature at bytes 0..5: statement `SELEC`", "error: incomplete SQL statement at end of input (expected `;`)")]
DUMPED = ("out", "V2;~S|t|a:I:?|b:T:?;~R|t|I1|Tx%00003B%000009y;")
computed("command_line", command_line, values("n, stream, line", *(f"({n}, '{k}', '{x}')" for n, (k, x) in enumerate([*PRINTED, DUMPED, *ERRORS, *(("code", c) for c in "0101")]))))


def error_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of error as it is printed."""
    from . import errors as E

    found = [E.ParseError("m", (1, 2)), E.UnsupportedError("m", (1, 2)), *(c("m") for c in (E.SchemaError, E.TypeMismatch, E.ConstraintError)), E.CorruptStorage("m", 7), E.RegexCompile("m"), E.RegexRuntime("m"), E.ResourceLimit("m", 3), E.AllocationError("m"), E.CapacityError("m")]
    return spark.createDataFrame([(e.kind, str(e)) for e in found], "kind string, text string")


computed("error_formats", error_formats, values("kind, text", "('parse', 'SQL parse error at bytes 1..2: m')", "('unsupported', 'unsupported SQL feature at bytes 1..2: m')", "('schema', 'schema error: m')", "('type', 'type error: m')", "('constraint', 'constraint violation: m')", "('corrupt_storage', 'corrupt database at byte 7: m')", "('regex_compile', 'generated regex could not be compiled: m')", "('regex_runtime', 'regex execution failed: m')", "('resource_limit', 'resource limit exceeded for m (limit: 3)')", "('allocation', 'allocation failed while m')", "('capacity', 'capacity exceeded while m')"))


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demonstration's tables after all of its statements, those included that must fail."""
    from .presets import PRESETS, seeded

    db = seeded(spark)
    for topic, _, script in PRESETS:
        for statement in script:
            try:
                db.execute(statement)
            except EngineError:
                if topic != "rules":
                    raise
    return db.query("SELECT users.id, users.handle, posts.subject, posts.likes FROM posts JOIN users ON posts.author = users.id").named()


computed("demo_presets", demo, values("id, handle, subject, likes", "(70::BIGINT, 'tomas', 'A short walk', 27::BIGINT)", "(3, 'yuki', 'Paper cranes', 8)"))
FLAGSHIP = "SELECT orders.o_orderkey, lineitem.l_linenumber, lineitem.l_partkey FROM orders JOIN lineitem ON orders.o_orderkey = lineitem.l_orderkey WHERE orders.o_orderstatus = 'F' AND lineitem.l_returnflag LIKE 'R%' ORDER BY o_orderkey DESC, l_linenumber, l_partkey LIMIT 20"
on_files("flagship", FLAGSHIP, "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag LIKE 'R%' ORDER BY o_orderkey DESC, l_linenumber, l_partkey LIMIT 20", "orders", "lineitem")

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

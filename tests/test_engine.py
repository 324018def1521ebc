import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline import Database, Limits
from ledgerline.errors import ConstraintError, EngineError, ResourceLimit, SchemaError, TypeMismatch
from ledgerline.functions.predicates import truth
from ledgerline.plans import analyzer
from ledgerline.sql.parser import parse


def run(db, *statements):
    for s in statements:
        out = db.execute(s)
    return out


def fails(db, sql, kind, message=""):
    before = db.as_str()
    with pytest.raises(kind, match=message):
        db.execute(sql)
    assert db.as_str() == before


def ids(db, sql):
    return [r[0] for r in db.query(sql).rows()]


# -- reading


def test_three_valued_pairs(db):
    run(db, "CREATE TABLE truth_pairs (id INTEGER NOT NULL, l BOOLEAN, r BOOLEAN)")
    for i, (a, b) in enumerate(itertools.product(("TRUE", "FALSE", "NULL"), repeat=2)):
        run(db, f"INSERT INTO truth_pairs VALUES ({i}, {a}, {b})")
    assert ids(db, "SELECT id FROM truth_pairs WHERE l = TRUE AND r = TRUE") == [0]
    assert ids(db, "SELECT id FROM truth_pairs WHERE l = TRUE OR r = TRUE") == [0, 1, 2, 3, 6]
    assert ids(db, "SELECT id FROM truth_pairs WHERE l != TRUE OR r IS NULL") == [2, 3, 4, 5, 8]
    assert ids(db, "SELECT id FROM truth_pairs WHERE l IN (TRUE, NULL)") == [0, 1, 2]
    assert ids(db, "SELECT id FROM truth_pairs WHERE l IN (NULL)") == []


def test_like(db):
    run(db, "CREATE TABLE p (v TEXT)")
    values = ["ab", "acb", "a💾b", "aéb", "aéb", "a_b", "a%b", "a\\b", "Ab", "a\nb"]
    for v in values:
        run(db, f"INSERT INTO p VALUES ('{v}')")
    run(db, "INSERT INTO p VALUES (NULL)")
    cases = {"a_b": [v for v in values if len(v) == 3 and v[0] == "a"], "a%b": [v for v in values if v[0] == "a"], r"a\_b": ["a_b"], r"a\%b": ["a%b"], r"a\\b": ["a\\b"], "%": values, "": [], "_b": ["ab", "Ab"]}
    for pattern, want in cases.items():
        assert [r[0] for r in db.query(f"SELECT v FROM p WHERE v LIKE '{pattern}'").rows()] == want, pattern
    fails(db, r"SELECT v FROM p WHERE v LIKE 'a\b'", TypeMismatch, "unsupported escape")
    fails(db, "SELECT v FROM p WHERE v LIKE 'a\\'", TypeMismatch, "incomplete escape")


def test_order_and_pages(db):
    run(db, "CREATE TABLE records (id INTEGER NOT NULL, n INTEGER, flag BOOLEAN, name TEXT)")
    for row in ("1, 2, TRUE, 'é'", "2, NULL, FALSE, '💾'", "3, -1, NULL, 'é'", "4, 2, FALSE, NULL", "5, 2, FALSE, 'a'"):
        run(db, f"INSERT INTO records VALUES ({row})")
    assert ids(db, "SELECT id FROM records ORDER BY n") == [3, 1, 4, 5, 2]
    assert ids(db, "SELECT id FROM records ORDER BY n DESC") == [2, 1, 4, 5, 3]
    assert ids(db, "SELECT id FROM records ORDER BY name") == [5, 1, 3, 2, 4]
    assert ids(db, "SELECT id FROM records ORDER BY flag DESC, id DESC") == [3, 1, 5, 4, 2]
    assert ids(db, "SELECT id FROM records LIMIT 2 OFFSET 1") == [2, 3]
    assert ids(db, "SELECT id FROM records LIMIT 18446744073709551615 OFFSET 0001") == [2, 3, 4, 5]
    assert ids(db, "SELECT id FROM records OFFSET 9999999999") == [] and ids(db, "SELECT id FROM records LIMIT 0") == []
    fails(db, "SELECT id FROM records ORDER BY x LIMIT 0", SchemaError, "unknown column")
    rows = db.query("SELECT id, name FROM records LIMIT 0")
    assert [(c.label, c.table, c.type, c.nullable) for c in rows.columns] == [("id", "records", "INTEGER", False), ("name", "records", "TEXT", True)]


def test_joins(db):
    run(db, "CREATE TABLE l (k INTEGER, m TEXT NOT NULL)", "CREATE TABLE r (k INTEGER, m TEXT NOT NULL)", "CREATE TABLE x (m TEXT)")
    for k, m in ((1, "a"), ("NULL", "b"), (1, "c"), (2, "d")):
        run(db, f"INSERT INTO l VALUES ({k}, '{m}')", f"INSERT INTO r VALUES ({k}, '{m.upper()}')")
    # many to many in nested-loop order; NULL never matches
    assert db.query("SELECT l.m, r.m FROM l JOIN r ON l.k = r.k").rows() == [("a", "A"), ("a", "C"), ("c", "A"), ("c", "C"), ("d", "D")]
    assert db.query("SELECT * FROM l JOIN r ON r.k = l.k WHERE l.m = 'a' OR r.m = 'D'").rows() == [(1, "a", 1, "A"), (1, "a", 1, "C"), (2, "d", 2, "D")]
    fails(db, "SELECT m FROM l JOIN r ON l.k = r.k", SchemaError, "ambiguous column")
    fails(db, "SELECT * FROM l JOIN l ON l.k = l.k", SchemaError, "more than once")
    fails(db, "SELECT * FROM l JOIN r ON l.k = l.k", SchemaError, "must connect")
    fails(db, "SELECT * FROM l JOIN x ON l.k = x.m", TypeMismatch, "different types")
    fails(db, "SELECT q.* FROM l", SchemaError, "unknown table qualifier")
    # the projection is resolved before joins, joins before WHERE
    fails(db, "SELECT nope FROM l JOIN x ON l.k = x.m WHERE z = 1", SchemaError, "unknown column")


def test_types_are_strict(db):
    run(db, "CREATE TABLE t (a INTEGER, b TEXT, c BOOLEAN NOT NULL)")
    for sql, message in (("SELECT * FROM t WHERE a = '1'", "expects INTEGER, got TEXT"), ("SELECT * FROM t WHERE b = NULL", "IS NULL"), ("SELECT * FROM t WHERE a < NULL", "IS NULL"), ("SELECT * FROM t WHERE a LIKE '1'", "LIKE requires"), ("SELECT * FROM t WHERE a IN (1, TRUE)", "got BOOLEAN"), ("INSERT INTO t VALUES (1, 'x')", "expects 3 values"), ("INSERT INTO t VALUES (1, 'x', NULL)", "NOT NULL"), ("UPDATE t SET a = 'x'", "got TEXT")):
        fails(db, sql, TypeMismatch, message)


# -- DDL

BAD_DDL = [
    "CREATE TABLE t (a TEXT)", "CREATE TABLE u (a TEXT, A TEXT)", "CREATE TABLE u (PRIMARY KEY (a))", "CREATE TABLE u (a TEXT NOT NULL NOT NULL)", "CREATE TABLE u (a TEXT PRIMARY KEY PRIMARY KEY)",
    "CREATE TABLE u (a TEXT PRIMARY KEY, b TEXT PRIMARY KEY)", "CREATE TABLE u (a TEXT UNIQUE, UNIQUE (a))", "CREATE TABLE u (a TEXT, UNIQUE (z))", "CREATE TABLE u (a TEXT DEFAULT NULL NOT NULL)", "CREATE TABLE u (a TEXT DEFAULT 'x' DEFAULT 'y')",
    "CREATE TABLE u (a TEXT AUTOINCREMENT PRIMARY KEY)", "CREATE TABLE u (a INTEGER AUTOINCREMENT)", "CREATE TABLE u (a INTEGER PRIMARY KEY AUTOINCREMENT DEFAULT 1)", "CREATE TABLE u (a INTEGER REFERENCES nope(id))",
    "CREATE TABLE u (a TEXT REFERENCES t(id))", "CREATE TABLE u (a INTEGER REFERENCES t(b))", "CREATE TABLE u (a INTEGER NOT NULL REFERENCES t(id) ON DELETE SET NULL)", "CREATE TABLE u (a INTEGER REFERENCES t(id) REFERENCES t(id))",
    "CREATE TABLE u (a TEXT CHECK (z = 1))", "CREATE TABLE u (a TEXT CHECK (u.a = 'x'))",
]


def test_bad_ddl(db):
    run(db, "CREATE TABLE t (id INTEGER PRIMARY KEY, b TEXT)")
    for sql in BAD_DDL:
        fails(db, sql, SchemaError)
    fails(db, "CREATE TABLE u (a TEXT CHECK (a = 1))", TypeMismatch)
    fails(db, "CREATE TABLE u (a INTEGER DEFAULT 'x')", TypeMismatch)


def test_metadata(db):
    run(db, "CREATE TABLE zebra (id INTEGER)", "CREATE TABLE alpha (id INTEGER PRIMARY KEY, UNIQUE (id))", 'CREATE TABLE "select" ("from" TEXT)')
    assert ids(db, "SHOW TABLES") == ["zebra", "alpha", "select"]
    statement = "CREATE TABLE widgets (id INTEGER NOT NULL PRIMARY KEY AUTOINCREMENT, \"order\" TEXT NOT NULL UNIQUE DEFAULT 'it''s', z INTEGER REFERENCES alpha(id) ON DELETE SET NULL ON UPDATE CASCADE, CHECK ((\"order\" LIKE 'a\\%_%' AND (z IN (1, NULL) OR z IS NULL))))"
    run(db, statement)
    assert db.query("SHOW CREATE TABLE widgets").rows() == [("widgets", statement)]
    other = Database(db.spark)
    for (name,) in db.query("SHOW TABLES").rows():
        other.execute(db.query(f'SHOW CREATE TABLE "{name}"').rows()[0][1])
    assert other.as_str() == db.as_str()


# -- constraints and sequences


def test_defaults_and_sequences(db):
    run(db, "CREATE TABLE s (id INTEGER PRIMARY KEY AUTO_INCREMENT, a TEXT DEFAULT 'x', b TEXT DEFAULT NULL)", "INSERT INTO s (a) VALUES ('y')", "INSERT INTO s VALUES (-5, NULL, NULL)", "INSERT INTO s (id) VALUES (NULL)")
    assert db.query("SELECT * FROM s").rows() == [(1, "y", None), (-5, None, None), (2, "x", None)]
    run(db, "UPDATE s SET id = 100 WHERE id = 1", "UPDATE s SET id = 500 WHERE id = 77", "INSERT INTO s (a) VALUES ('z')")
    assert ids(db, "SELECT id FROM s") == [100, -5, 2, 101]
    run(db, "INSERT INTO s (id) VALUES (9223372036854775807)")
    fails(db, "INSERT INTO s (a) VALUES ('q')", ConstraintError, "exhausted")
    fails(db, "INSERT INTO s (a, a) VALUES ('q', 'r')", SchemaError, "duplicate INSERT column")


def test_checks_in_declaration_order(db):
    run(db, "CREATE TABLE c (v INTEGER CHECK (v > 0), CHECK (v < 10), CHECK (v > 0))", "INSERT INTO c VALUES (NULL)", "INSERT INTO c VALUES (5)")
    fails(db, "INSERT INTO c VALUES (0)", ConstraintError, "CHECK constraint 1 failed")
    fails(db, "INSERT INTO c VALUES (10)", ConstraintError, "CHECK constraint 2 failed")
    fails(db, "UPDATE c SET v = 11", ConstraintError, "CHECK constraint 2 failed")


# -- referential actions


def test_delete_cascade_in_a_diamond_and_counts(db):
    run(db, "CREATE TABLE roots (id INTEGER PRIMARY KEY)", "CREATE TABLE lefts (id INTEGER PRIMARY KEY, r INTEGER REFERENCES roots(id) ON DELETE CASCADE)", "CREATE TABLE rights (id INTEGER PRIMARY KEY, r INTEGER REFERENCES roots(id) ON DELETE CASCADE)")
    run(db, "CREATE TABLE leaves (id INTEGER PRIMARY KEY, l INTEGER REFERENCES lefts(id) ON DELETE CASCADE, r INTEGER REFERENCES rights(id) ON DELETE SET NULL)")
    run(db, "INSERT INTO roots VALUES (1)", "INSERT INTO roots VALUES (2)", "INSERT INTO lefts VALUES (10, 1)", "INSERT INTO rights VALUES (20, 1)", "INSERT INTO rights VALUES (21, 2)", "INSERT INTO leaves VALUES (100, 10, 20)", "INSERT INTO leaves VALUES (101, NULL, 20)", "INSERT INTO leaves VALUES (102, NULL, 21)")
    # the count is of direct rows; a later delete wins over SET NULL
    assert run(db, "DELETE FROM roots WHERE id = 1").count == 1
    assert db.query("SELECT * FROM leaves").rows() == [(101, None, None), (102, None, 21)] and ids(db, "SELECT id FROM rights") == [21]


def test_late_restrict_rolls_everything_back(db):
    run(db, "CREATE TABLE roots (id INTEGER PRIMARY KEY)", "CREATE TABLE branches (id INTEGER PRIMARY KEY, r INTEGER REFERENCES roots(id) ON DELETE CASCADE)", "CREATE TABLE blockers (id INTEGER PRIMARY KEY, b INTEGER REFERENCES branches(id))")
    run(db, "INSERT INTO roots VALUES (1)", "INSERT INTO branches VALUES (10, 1)", "INSERT INTO blockers VALUES (100, 10)")
    fails(db, "DELETE FROM roots", ConstraintError, 'foreign key "blockers"."b" restricts mutation of "branches"')


def test_restrict_is_released_by_the_statement_itself(db):
    run(db, "CREATE TABLE n (id INTEGER PRIMARY KEY, p INTEGER REFERENCES n(id))", "INSERT INTO n VALUES (1, NULL)", "INSERT INTO n VALUES (2, 1)", "UPDATE n SET p = 2 WHERE id = 1")
    fails(db, "DELETE FROM n WHERE id = 1", ConstraintError, "restricts")
    fails(db, "UPDATE n SET id = 9 WHERE id = 1", ConstraintError, "restricts")
    assert run(db, "DELETE FROM n").count == 2


def test_update_cascade_through_keys_and_sequences(db):
    run(db, "CREATE TABLE a (id INTEGER PRIMARY KEY AUTOINCREMENT)", "CREATE TABLE b (id INTEGER PRIMARY KEY AUTOINCREMENT REFERENCES a(id) ON UPDATE CASCADE)", "CREATE TABLE c (id INTEGER PRIMARY KEY, b INTEGER REFERENCES b(id) ON UPDATE CASCADE)")
    run(db, "INSERT INTO a VALUES (1)", "INSERT INTO b VALUES (1)", "INSERT INTO c VALUES (5, 1)", "UPDATE a SET id = 40 WHERE id = 1")
    assert ids(db, "SELECT id FROM b") == [40] and ids(db, "SELECT b FROM c") == [40]
    run(db, "INSERT INTO a VALUES (NULL)", "INSERT INTO b VALUES (NULL)")
    assert ids(db, "SELECT id FROM b") == [40, 41]


def test_direct_and_cascaded_changes_merge_or_conflict(db):
    run(db, "CREATE TABLE n (id INTEGER PRIMARY KEY, p INTEGER REFERENCES n(id) ON UPDATE CASCADE)", "INSERT INTO n VALUES (1, 1)", "INSERT INTO n VALUES (2, 1)")
    fails(db, "UPDATE n SET id = 7, p = 2 WHERE id = 1", ConstraintError, "conflicting cascaded updates")
    run(db, "UPDATE n SET id = 7, p = 7 WHERE id = 1")
    assert db.query("SELECT * FROM n").rows() == [(7, 7), (2, 7)]


# -- limits


def test_limits(spark):
    db = Database(spark, Limits(max_predicates=2, max_join_sources=1, max_sql_bytes=60, max_database_bytes=120))
    run(db, "CREATE TABLE t (a INTEGER)", "CREATE TABLE u (a INTEGER)")
    for sql, resource in (("SELECT * FROM t WHERE a = 1 OR a = 2 OR zzz = 3", "WHERE predicates"), ("SELECT * FROM t WHERE a IN (1, 2, 3)", "WHERE predicates"), ("SELECT * FROM t JOIN u ON t.a = u.a", "JOIN sources"), ("SELECT a FROM t WHERE a = 1" + " " * 60, "SQL bytes"), ("CREATE TABLE v (a INTEGER CHECK (a IN (1, 2, 3)))", "CHECK predicates")):
        with pytest.raises(ResourceLimit) as e:
            db.execute(sql)
        assert e.value.message == resource
    for i in range(6):
        try:
            db.execute(f"INSERT INTO t VALUES ({10**15 + i})")
        except ResourceLimit as e:
            assert e.message == "database bytes"
            break
    else:
        raise AssertionError("no limit")
    small = Database(spark, Limits(max_query_output_bytes=40))
    run(small, "CREATE TABLE t (a TEXT)", f"INSERT INTO t VALUES ('{'x' * 50}')")
    with pytest.raises(ResourceLimit, match="query output bytes"):
        small.query("SELECT * FROM t").rows()


# -- many rows


def test_rows_leave_the_driver(spark, monkeypatch):
    from ledgerline.sources import tables

    monkeypatch.setattr(tables, "DELTA_ROWS", 3)
    db = Database(spark)
    run(db, "CREATE TABLE p (id INTEGER PRIMARY KEY, v TEXT UNIQUE)", "CREATE TABLE c (p INTEGER REFERENCES p(id) ON DELETE CASCADE)")
    for i in range(6):
        run(db, f"INSERT INTO p VALUES ({i}, 'v;{i}')", f"INSERT INTO c VALUES ({i})")
    assert db.versions["p"].base is not None
    fails(db, "INSERT INTO p VALUES (2, 'n')", ConstraintError, "duplicate primary key")
    fails(db, "INSERT INTO p VALUES (9, 'v;1')", ConstraintError, "UNIQUE")
    fails(db, "INSERT INTO c VALUES (77)", ConstraintError, "no matching row")
    run(db, "DELETE FROM p WHERE id < 2", "UPDATE p SET v = 'w' WHERE id = 5")
    assert db.query("SELECT * FROM p").rows() == [(2, "v;2"), (3, "v;3"), (4, "v;4"), (5, "w")] and ids(db, "SELECT p FROM c") == [2, 3, 4, 5]
    assert Database.from_string(spark, db.as_str()).as_str() == db.as_str()


# -- model


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_predicates_equal_the_driver_evaluator(spark, data):
    text = st.sampled_from(["", "a", "b%", "é", "💾", "a\nb", "~|;", " "])
    rows = data.draw(st.lists(st.tuples(st.one_of(st.none(), text), st.integers(-2, 2), st.booleans()), max_size=8))
    db = Database(spark)
    db.execute("CREATE TABLE t (x TEXT, n INTEGER NOT NULL, f BOOLEAN NOT NULL)")
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    for r in rows:
        db.execute(f"INSERT INTO t VALUES ({', '.join(map(lit, r))})")
    leaf = st.one_of(st.tuples(st.just("x"), st.sampled_from(["=", "!=", "<", ">="]), text), st.tuples(st.just("n"), st.sampled_from(["=", "<=", ">"]), st.integers(-2, 2)), st.tuples(st.just("f"), st.sampled_from(["=", "<"]), st.booleans()))
    leaves = [f"{c} {o} {lit(v)}" for c, o, v in data.draw(st.lists(leaf, min_size=1, max_size=4))] + data.draw(st.lists(st.sampled_from(["x IS NULL", "x IS NOT NULL", "x LIKE '%a%'", "x LIKE '_'", "n IN (0, 1)", "x IN ('a', NULL)"]), max_size=2))
    where = leaves[0]
    for x in leaves[1:]:
        where = f"({where}) {data.draw(st.sampled_from(['AND', 'OR']))} {x}"
    resolved = analyzer.where((db.catalog.tables["t"],), parse(f"SELECT * FROM t WHERE {where}").where, db.limits)
    assert db.query(f"SELECT * FROM t WHERE {where}").rows() == [r for r in rows if truth(resolved, lambda at, r=r: r[at[1]]) is True]


def test_errors_are_of_the_engine(db):
    for sql in ("SELECT * FROM nope", "SELECT", "INSERT INTO nope VALUES (1)", "DESCRIBE nope", "SHOW CREATE TABLE nope", "UPDATE nope SET a = 1", "DELETE FROM nope"):
        with pytest.raises(EngineError):
            db.execute(sql)
    assert db.as_str() == "V2;"


# -- tables beyond the driver


@pytest.mark.parametrize("rows", [5, 5000])
def test_size_limit_holds_at_every_size(spark, monkeypatch, rows):
    from ledgerline.sources import tables

    monkeypatch.setattr(tables, "DELTA_ROWS", rows)
    db = Database(spark, Limits(max_database_bytes=300))
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    n = 0
    with pytest.raises(ResourceLimit):
        while True:
            db.execute(f"INSERT INTO t VALUES ({n}, 'x{n};')")
            n += 1
    text = db.as_str()
    assert n == 14 and db._size() == len(text.encode()) <= 300
    db.execute("DELETE FROM t WHERE a < 3")
    db.execute("UPDATE t SET b = 'yy' WHERE a = 4")
    assert db._size() == len(db.as_str().encode()) and ids(db, "SELECT a FROM t") == list(range(3, n))


def test_files_are_added_and_old_ones_go(spark, monkeypatch):
    from ledgerline.sources import tables

    monkeypatch.setattr(tables, "DELTA_ROWS", 2)
    monkeypatch.setattr(tables, "MANY_FILES", 3)
    db = Database(spark)
    run(db, "CREATE TABLE p (id INTEGER PRIMARY KEY)", "CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p(id) ON DELETE CASCADE)")
    for i in range(14):
        run(db, f"INSERT INTO p VALUES ({i})", f"INSERT INTO c VALUES ({100 + i}, {i})")
    for i in (0, 3, 5, 8, 9):
        assert db.execute(f"DELETE FROM p WHERE id = {i}").count == 1
        run(db, f"INSERT INTO p VALUES ({50 + i})")
    left = [i for i in range(14) if i not in (0, 3, 5, 8, 9)]
    for _ in range(2):
        assert ids(db, "SELECT id FROM p") == [*left, 50, 53, 55, 58, 59] and ids(db, "SELECT id FROM c") == [100 + i for i in left]
        assert ids(db, "SELECT id FROM p ORDER BY id DESC OFFSET 12") == [2, 1]
        assert db.vacuum() >= 0
    assert ids(db, "SELECT id FROM p ORDER BY id OFFSET 9") == [50, 53, 55, 58, 59] and ids(db, "SELECT id FROM p ORDER BY id LIMIT 2 OFFSET 9") == [50, 53]
    assert db._size() == len(db.as_str().encode()) and db.vacuum() > 0 and db.vacuum() == 0
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO c VALUES (1, 0)")


def test_filters_on_stored_columns_change_no_result(spark, tmp_path):
    import datetime
    import random

    from pyspark.sql import functions as F

    from ledgerline.sources.parquet import attach_parquet

    r = random.Random(4)
    day = lambda: datetime.datetime(1969, 12, 1) + datetime.timedelta(seconds=r.randrange(5_000_000))
    rows = [(i, r.choice([None, *(x / 100 for x in range(-350, 350, 7)), -0.995, 2.675]), r.choice([-1.5, -1.0, 0.99, 1.0, 7.2]), day(), day(), day().date()) for i in range(300)]
    rows += [(300, 1e9, 5.0, datetime.datetime(1, 1, 1, 5), datetime.datetime(9999, 12, 31, 23), datetime.date(9999, 12, 31))]
    spark.createDataFrame(rows, "i bigint, cents double, whole double, day timestamp_ntz, us timestamp_ntz, d date").write.parquet(str(tmp_path / "t"))
    db, plain = Database(spark), Database(spark)
    attach_parquet(db, "t", str(tmp_path / "t"), {"whole": "whole", "us": "micros"})
    v = db.versions["t"]
    plain.attach(db.catalog.tables["t"], v.base)
    values = {"cents": ["-100", "0", "268", "267", "13"], "whole": ["-1", "0", "1", "7"], "us": ["0", "86400000000", "-5", "1000000000000"], "day": ["'1970-01-01'", "'1969-12-15'", "'1970'", "'1970-13-01'"], "d": ["'1970-01-03'", "'9999-12-31'", "'x'"]}
    conditions = [f"{c} {op} {x}" for c, xs in values.items() for op in ("=", "!=", "<", "<=", ">", ">=") for x in xs]
    conditions += [f"{c} IN ({', '.join(xs)}, NULL)" for c, xs in values.items()] + [f"{c} IS NULL" for c in values] + ["day LIKE '1970%'"]
    for _ in range(40):
        a, b, c = r.choice(conditions), r.choice(conditions), r.choice(conditions)
        conditions.append(r.choice([f"{a} AND {b}", f"{a} OR {b}", f"({a} OR {b}) AND i < 200", f"{a} OR {b} AND {c}"]))
    some = [*r.sample(conditions[:-40], 40), *conditions[-40:]]
    pick = lambda d, c: d.query(f"SELECT i FROM t WHERE {c}").dataframe.agg(F.sort_array(F.collect_list("p0")).alias("x"))
    for k in range(0, len(some), 20):  # a job for many conditions
        got, want = (pick(d, some[k]) for d in (db, plain))
        for c in some[k + 1 : k + 20]:
            got, want = got.union(pick(db, c)), want.union(pick(plain, c))
        assert [x[0] for x in got.collect()] == [x[0] for x in want.collect()]

import io
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline import Database
from ledgerline.cli import complete, main, shell, table
from ledgerline.database import encoded_rows, split_statements
from ledgerline.envelope import Console
from ledgerline.errors import CorruptStorage, EngineError, UnsupportedError
from ledgerline.plans import explain
from ledgerline.sources import codec, csv_import, files
from ledgerline.streaming import select_stream

GOOD = [
    "V2;",
    r"V2;~S|people|id:I:!|note:T:?|active:B:!;~R|people|I-7|Tsemi%00003Bline%002028break|B1;",
    "V2;~S|users|id:I:!|name:T:?|active:B:?;~P|users|id;~A|users|id|I1;~R|users|I1|TAda|B1;",
    "V3;~S|v|value:I:?;~C|v|GT|0|I0;~C|v|LT|0|I10;~C|v|GT|0|I0;~R|v|N;~R|v|I5;",
    "V3;~S|p|id:I:!|s:T:!|b:T:?;~P|p|id;~A|p|id|I9;~D|p|s|Tx;~D|p|b|N;~U|p|s;~C|p|OR|2|AND|2|NE|1|T|ISNULL|2|LIKE|1|3|La|M|S;~S|c|p:I:?;~F|c|p|p|id|N|C;~R|p|I9|Tq|N;~R|c|I9;~R|p|I2|Tz|N;~R|c|N;",
    "V3;~S|c|t:T:?|f:B:?;~C|c|IN|0|2|Ta|N;~C|c|NOTNULL|0;~C|c|GE|1|B0;~C|c|EQ|0|Ta;~C|c|LE|0|Tz;~R|c|Ta|B1;",
]
BAD = [
    ("", 0), ("V4;", 0), ("V2;~S|t|a:I:?", 3), ("V2;~X|t;", 3), ("V2;~S|T|a:I:?;", 3), ("V2;~S|t;", 3), ("V2;~S|t|a:X:?;", 3), ("V2;~S|t|a:I:?|a:I:?;", 3), ("V2;~S|t|a:I:?;~S|t|a:I:?;", 14), ("V2;~R|t|I1;", 3),
    ("V2;~S|t|a:I:?;~R|t|I1|I2;", 14), ("V2;~S|t|a:I:?;~R|t|I01;", 19), ("V2;~S|t|a:I:?;~R|t|I9223372036854775808;", 19), ("V2;~S|t|a:I:!;~R|t|N;", 19), ("V2;~S|t|a:T:?;~R|t|Tx%00;", 21), ("V2;~S|t|a:T:?;~R|t|Tx%000041;", 21),
    ("V2;~S|t|a:T:?;~R|t|Tx%00D800;", 21), ("V2;~S|t|a:T:?;~R|t|T\n;", 20), ("V2;~S|t|a:B:?;~R|t|B2;", 19), ("V2;~S|t|a:I:!;~P|t|a;~R|t|I1;~R|t|I1;", 29), ("V2;~S|t|a:I:?;~P|t|a;", 14), ("V2;~S|t|a:I:?;~U|t|a;", 14),
    ("V2;~S|t|a:I:!;~P|t|a;~P|t|a;", 21), ("V3;~S|t|a:I:?;~C|t|AND|2|GT|0|I0;", 14), ("V3;~S|t|a:I:?;~C|t|GT|5|I0;", 14), ("V3;~S|t|a:I:?;~C|t|GT|0|I0;~R|t|I-1;", 27), ("V3;~S|t|a:I:?;~U|t|a;~R|t|I1;~R|t|I1;", 29),
    ("V2;~S|p|id:I:!;~P|p|id;~S|c|p:I:?;~F|c|p|p|id;~R|c|I1;", 46), ("V2;~S|t|id:I:!;~P|t|id;~A|t|id|I1;~R|t|I2;", 34),
]


@pytest.mark.parametrize("text", GOOD)
def test_good_strings_come_back(spark, text):
    assert Database.from_string(spark, text).as_str() == text


@pytest.mark.parametrize(("text", "offset"), BAD)
def test_corrupt_strings(spark, text, offset):
    with pytest.raises(CorruptStorage) as e:
        Database.from_string(spark, text)
    assert e.value.offset == offset


def test_version_is_sticky(db):
    db.execute("CREATE TABLE a (x INTEGER)")
    assert db.as_str().startswith("V2;")
    db.execute("CREATE TABLE b (x INTEGER DEFAULT 1)")
    assert db.as_str().startswith("V3;") and Database.from_string(db.spark, db.as_str()).catalog.version == 3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("%|;~\\'\0\n\r\t  é́💾.*[]()^$")), st.characters(exclude_categories=["Cs"]))))
def test_text_escapes(text):
    column = codec.Column("a", "TEXT")
    raw = codec.cell(text, column)
    assert codec.decoded_cell(raw, column, 0) == text and not set(raw[1:]) & set("|;~\n")


def test_rows_encode_in_spark(spark, db):
    db.execute("CREATE TABLE t (a TEXT, b INTEGER, c BOOLEAN)")
    for v in ("'%|;~'", "''", "NULL", "'\0\n  \x7f\x9f'", "'é💾́'"):
        db.execute(f"INSERT INTO t VALUES ({v}, -1, NULL)")
    t = db.catalog.tables["t"]
    rows = [r.record for r in encoded_rows(t, db._frame(t)).orderBy("rid").collect()]
    assert "V2;" + codec.encoded_table(t) + "".join(rows) == db.as_str()


# -- the pattern


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_pattern_finds_the_rows(spark, data):
    """Where the pattern is exact, its matches in the string are the rows of the SELECT."""
    db = Database(spark)
    db.execute("CREATE TABLE t (a TEXT, n INTEGER NOT NULL)")
    db.execute("CREATE TABLE tt (a TEXT, n INTEGER NOT NULL)")
    for v in ("'ab'", "'a;b'", "'.*'", "NULL", "'é'", "''"):
        for n in (0, -5):
            db.execute(f"INSERT INTO {data.draw(st.sampled_from(['t', 't', 'tt']))} VALUES ({v}, {n})")
    leaves = data.draw(st.lists(st.sampled_from(["a = 'ab'", "a != 'a;b'", "a LIKE 'a%'", "a LIKE '_'", "a IS NULL", "a IS NOT NULL", "n = -5", "n != 0", "a LIKE '%%.%'"]), min_size=1, max_size=3))
    sql = f"SELECT a, n FROM t WHERE {' AND '.join(leaves)}"
    e = db.explain_select(sql)
    assert e.pattern_is_exact and e.sources == ["t"]
    t = db.catalog.tables["t"]
    assert [m[0] for m in re.finditer(e.pattern, db.as_str())] == [codec.encoded_row(t, r) for r in db.query(sql).rows()]


def test_pattern_is_a_prefilter_otherwise(db):
    db.execute("CREATE TABLE t (a TEXT, n INTEGER)")
    db.execute("CREATE TABLE u (n INTEGER)")
    assert not db.explain_select("SELECT * FROM t WHERE n > 1").pattern_is_exact and not db.explain_select("SELECT * FROM t WHERE a = 'x' OR n = 1").pattern_is_exact
    e = db.explain_select("SELECT * FROM t JOIN u ON t.n = u.n WHERE u.n = 1")
    assert e.pattern.startswith("(?:~R\\|t\\|") and not e.pattern_is_exact and explain.escape("a.b") == r"a\.b"
    with pytest.raises(UnsupportedError):
        db.explain_select("SHOW TABLES")
    assert "Physical Plan" in db.spark_plan("SELECT * FROM u")


# -- files, command line, console


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "db")
    assert main(["init", path]) == 0 and main(["init", path]) == 1
    assert main(["exec", path, "CREATE", "TABLE", "t", "(a INTEGER, b TEXT)"]) == 0
    assert main(["exec", path, "INSERT INTO t VALUES (1, 'x\ny')"]) == 0
    before = (tmp_path / "db").read_bytes()
    assert main(["exec", path, "SELECT * FROM t"]) == 0 and main(["exec", path, "SELECT nope FROM t"]) == 1 and main(["dump", path]) == 0
    assert (tmp_path / "db").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["db"]
    out, err = capsys.readouterr()
    assert "created table t\naffected 1 row\n+---+------+\n| a | b    |\n+---+------+\n| 1 | x\\ny |\n+---+------+\n1 row\n" in out and before.decode() in out and 'error: schema error: unknown column "nope" in table "t"' in err


def test_shell(spark, tmp_path):
    path = str(tmp_path / "db")
    files.create(path)
    out, err = io.StringIO(), io.StringIO()
    text = "CREATE TABLE t (a TEXT);\n\nINSERT INTO t\nVALUES ('x;y');\nSELECT z FROM t;\nSHOW CREATE TABLE t;\n.dump\n.quit\nSELECT"
    assert shell(spark, path, io.StringIO(text), out, err) == 0
    assert "CREATE TABLE t (a TEXT)\nV2;~S|t|a:T:?;~R|t|Tx%00003By;\n" in out.getvalue() and "unknown column" in err.getvalue()
    assert shell(spark, path, io.StringIO("SELECT"), out, err) == 1 and "incomplete SQL statement" in err.getvalue()
    assert complete("a; ") and not complete("';'") and not complete("a") and complete("'x'';';")


def test_headers_are_told_apart(db):
    for s in ("CREATE TABLE a (id INTEGER)", "CREATE TABLE b (id INTEGER)", "INSERT INTO a VALUES (1)", "INSERT INTO b VALUES (1)"):
        db.execute(s)
    assert table(db.query("SELECT * FROM a JOIN b ON a.id = b.id")).splitlines()[1] == "| a.id | b.id |"
    assert table(db.query("SELECT id, id FROM a")).splitlines()[1] == "| id | id |"


def test_console(spark):
    c = Console(spark)
    send = lambda sql: json.loads(c.exec(sql))
    assert send("CREATE TABLE t (a INTEGER, b TEXT)")["kind"] == "created" and send("INSERT INTO t VALUES (9007199254740993, 'é')")["rows"] == 1
    rows = send("SELECT a FROM t WHERE b = 'é'")
    assert rows["result"]["rows"] == [[{"type": "INTEGER", "value": "9007199254740993"}]] and rows["scan"]["exact"] and len(rows["scan"]["matches"]) == 1
    changed = send("UPDATE t SET a = 1 WHERE b = 'é'")
    assert changed["rows"] == 1 and "9007199254740993" in changed["blobBefore"] and "|I1|" in changed["blob"] and changed["scan"]["sources"] == ["t"]
    bad = send("SELECT 1 FROM t")
    assert not bad["ok"] and bad["error"]["kind"] == "parse" and bad["error"]["span"] == [7, 8]
    blob = c.dump()
    assert not json.loads(c.load("V9;"))["ok"] and c.dump() == blob
    assert json.loads(c.explain("SELECT * FROM t"))["kind"] == "explain" and send("SHOW TABLES")["scan"] is None
    c.reset()
    assert c.dump() == "V2;" and json.loads(c.load(blob))["kind"] == "loaded" and c.dump() == blob


def test_scripts(db):
    assert split_statements("a; b ';' ; \"c;\" ;; ") == ["a", " b ';' ", ' "c;" ']
    assert len(db.execute_script("CREATE TABLE t (a TEXT); INSERT INTO t VALUES (';');")) == 2
    with pytest.raises(EngineError):
        db.execute_script("INSERT INTO t VALUES ('x'); nonsense; INSERT INTO t VALUES ('y')")
    assert [r[0] for r in db.query("SELECT a FROM t").rows()] == [";", "x"]


def test_csv(spark, db, tmp_path):
    text = 'Id;x,"Full ""Name""",,Id;x\r\n1,"a\nb",true,+7\n2,,FALSE,-9\n\n3,c\n'
    found, script = csv_import.statements(text, "Sales 2024.csv", row_limit=2)
    assert (found.table, found.rows, found.skipped) == ("sales_2024", 2, 1)
    assert found.columns == [("id_x", "INTEGER"), ("full_name", "TEXT"), ("column_3", "BOOLEAN"), ("id_x_4", "INTEGER")]
    for s in script:
        db.execute(s)
    assert db.query("SELECT * FROM sales_2024").rows() == [(1, "a\nb", True, 7), (2, None, False, -9)]
    assert csv_import.separator("a\tb") == "\t" and csv_import.inferred(["", ""]) == "TEXT" and csv_import.inferred(["9223372036854775808"]) == "TEXT"
    with pytest.raises(ValueError, match="header"):
        csv_import.statements("a,b\n", "x.csv")
    path = tmp_path / "big.csv"
    path.write_text("A b,flag,n\n" + "".join(f"{i},{'true' if i % 2 else ''},x{i}\n" for i in range(700)))
    found = csv_import.load_csv(db, str(path))
    assert (found.table, found.rows, found.skipped, found.columns) == ("big", 700, 0, [("a_b", "INTEGER"), ("flag", "BOOLEAN"), ("n", "TEXT")])
    assert db.query("SELECT a_b FROM big WHERE flag IS NULL AND a_b < 5").rows() == [(0,), (2,), (4,)]


def test_streams(spark, db, tmp_path):
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    t = db.catalog.tables["t"]
    spark.createDataFrame([(1, "x"), (2, None), (3, "xy")], "c0 bigint, c1 string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c0 bigint, c1 string").parquet(str(tmp_path / "in"))
    out = select_stream(t, stream, "SELECT a FROM t WHERE b LIKE 'x%'")
    q = out.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.sql("SELECT * FROM found").collect()) == [1, 3]
    with pytest.raises(UnsupportedError):
        select_stream(t, stream, "SELECT a FROM t ORDER BY a")

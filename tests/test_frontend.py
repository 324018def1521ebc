import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.errors import EngineError, ParseError, UnsupportedError
from ledgerline.sql import ast as A
from ledgerline.sql.lexer import lex
from ledgerline.sql.parser import parse

ERRORS = [
    ("", ParseError, "expected a SQL statement", (0, 0)),
    ("; SELECT", ParseError, "expected a SQL statement", (0, 1)),
    ("DROP TABLE t", UnsupportedError, "statement `DROP`", (0, 4)),
    ("SELECT * FROM t; SELECT", UnsupportedError, "multiple SQL statements", (17, 23)),
    ("SELECT 'é", ParseError, "unterminated string literal", (7, 10)),
    ('SELECT "a', ParseError, "unterminated quoted identifier", (7, 9)),
    ("SELECT * FROM t -- x", UnsupportedError, "SQL comments", (16, 20)),
    ("SELECT * FROM t WHERE a = 1x", ParseError, "malformed numeric token", (26, 28)),
    ("SELECT * FROM t WHERE a = 1.5", ParseError, "malformed numeric token", (26, 29)),
    ("SELECT é FROM t", ParseError, "unexpected character 'é'", (7, 9)),
    ("SELECT a + b FROM t", ParseError, "unexpected character '+'", (9, 10)),
    ("SELECT a < b FROM t", UnsupportedError, "ordered comparisons", (9, 10)),
    ("SELECT * FROM t WHERE a <> 1", UnsupportedError, "comparison operator `<>`", (24, 26)),
    ("SELECT * FROM t WHERE a ! 1", ParseError, "expected `=` after `!`", (24, 25)),
    ("SELECT * FROM t WHERE a == 1", ParseError, "malformed comparison operator `==`", (24, 26)),
    ("SELECT * FROM t WHERE a < = 1", ParseError, "expected a literal value", (26, 27)),
    ("SELECT * FROM t WHERE NOT a = 1", UnsupportedError, "unary NOT", (22, 25)),
    ("SELECT * FROM t WHERE 1 = 1", UnsupportedError, "literal-to-literal predicates", (22, 23)),
    ("SELECT * FROM t WHERE TRUE", UnsupportedError, "bare Boolean constants", (22, 26)),
    ("SELECT * FROM t WHERE a = b", UnsupportedError, "column-to-column WHERE predicates", (26, 27)),
    ("SELECT * FROM t WHERE a IN ()", UnsupportedError, "empty IN lists", (24, 26)),
    ("SELECT * FROM t WHERE a IN (SELECT b FROM c)", UnsupportedError, "subqueries in IN lists", (28, 34)),
    ("SELECT * FROM t WHERE a IN (1 + 2)", UnsupportedError, "expressions in IN lists", (30, 31)),
    ("SELECT * FROM t WHERE a IN (1 -2)", UnsupportedError, "expressions in IN lists", (30, 31)),
    ("SELECT * FROM t WHERE (a = 1", ParseError, "expected `)` to close WHERE expression", (28, 28)),
    ("SELECT * FROM t WHERE a = 1)", ParseError, "unmatched `)` in WHERE", (27, 28)),
    ("SELECT * FROM t WHERE", ParseError, "expected a predicate in WHERE", (21, 21)),
    ("SELECT * FROM t WHERE a BETWEEN 1 AND 2", ParseError, "expected `=`, `!=`, `<`, `<=`, `>`, `>=`, `LIKE`, `IS [NOT] NULL`, or `IN (...)`", (24, 31)),
    ("SELECT * FROM t WHERE a LIKE 1", ParseError, "LIKE expects a string literal", (29, 30)),
    ("SELECT * FROM t WHERE a = 9223372036854775808", ParseError, "INTEGER literal is outside the i64 range", (26, 45)),
    ("SELECT COUNT(a) FROM t", ParseError, "expected keyword FROM", (12, 13)),
    ("SELECT a AS b FROM t", ParseError, "expected keyword FROM", (9, 11)),
    ("SELECT select FROM t", ParseError, "reserved keyword `SELECT` cannot be used as an identifier", (7, 13)),
    ('SELECT "a b" FROM t', ParseError, "quoted identifiers must use the unquoted ASCII identifier grammar", (7, 12)),
    ("SELECT * FROM t u", UnsupportedError, "trailing SQL syntax", (16, 17)),
    ("SELECT * FROM t AS u", UnsupportedError, "aliases", (16, 18)),
    ("SELECT * FROM t LEFT JOIN u ON a = b", UnsupportedError, "outer joins", (16, 20)),
    ("SELECT * FROM t CROSS JOIN u", UnsupportedError, "cross joins", (16, 21)),
    ("SELECT * FROM t NATURAL JOIN u", UnsupportedError, "natural joins", (16, 23)),
    ("SELECT * FROM t GROUP BY a", UnsupportedError, "GROUP BY", (16, 21)),
    ("SELECT * FROM t UNION SELECT * FROM u", UnsupportedError, "trailing SQL syntax", (16, 21)),
    ("SELECT * FROM t ORDER BY 1", UnsupportedError, "ORDER BY ordinals", (25, 26)),
    ("SELECT * FROM t ORDER BY (a)", UnsupportedError, "ORDER BY expressions", (25, 26)),
    ("SELECT * FROM t ORDER BY a NULLS FIRST", UnsupportedError, "ORDER BY NULLS FIRST/LAST", (27, 32)),
    ("SELECT * FROM t ORDER BY a COLLATE x", UnsupportedError, "ORDER BY COLLATE", (27, 34)),
    ("SELECT * FROM t ORDER BY a b", ParseError, "expected `,` between ORDER BY terms", (27, 28)),
    ("SELECT * FROM t LIMIT -1", ParseError, "LIMIT requires an unsigned integer", (22, 24)),
    ("SELECT * FROM t LIMIT 18446744073709551616", ParseError, "LIMIT is outside the u64 range", (22, 42)),
    ("SELECT * FROM t LIMIT x", ParseError, "expected an unsigned integer after LIMIT", (22, 23)),
    ("SELECT * FROM t OFFSET 1 LIMIT 1", ParseError, "LIMIT must precede OFFSET", (25, 30)),
    ("SELECT * FROM t LIMIT 1 LIMIT 2", ParseError, "duplicate LIMIT clause", (24, 29)),
    ("SELECT * FROM t LIMIT 1 ORDER BY a", ParseError, "ORDER BY must precede LIMIT and OFFSET", (24, 29)),
    ("UPDATE t SET a = 1 LIMIT 1", UnsupportedError, "LIMIT", (19, 24)),
    ("DELETE FROM t ORDER BY a", UnsupportedError, "ORDER BY", (14, 19)),
    ("INSERT INTO t VALUES (1), (2)", UnsupportedError, "multi-row INSERT", (24, 25)),
    ("CREATE TABLE t (a DATE)", UnsupportedError, "column type `DATE`", (18, 22)),
    ("CREATE TABLE t (a 1)", ParseError, "expected TEXT, INTEGER, or BOOLEAN", (18, 19)),
    ("CREATE TABLE t (a TEXT, PRIMARY KEY (a, b))", UnsupportedError, "composite PRIMARY KEY constraints", (38, 39)),
    ("CREATE TABLE t (a TEXT REFERENCES p(a) ON DELETE CASCADE ON DELETE CASCADE)", ParseError, "duplicate ON DELETE clause", (57, 59)),
    ("CREATE TABLE t (a TEXT REFERENCES p(a) ON UPDATE SET NULL)", ParseError, "expected RESTRICT or CASCADE after ON UPDATE", (49, 52)),
    ("SHOW x", ParseError, "expected TABLES or CREATE TABLE after SHOW", (5, 6)),
    ("EXPLAIN REGEX DELETE FROM t", UnsupportedError, "EXPLAIN REGEX only supports SELECT", (14, 20)),
]


@pytest.mark.parametrize(("sql", "kind", "message", "span"), ERRORS, ids=[e[0][:40] or "empty" for e in ERRORS])
def test_errors(sql, kind, message, span):
    with pytest.raises(kind) as e:
        parse(sql)
    assert (e.value.message, e.value.span) == (message, span)


def test_lexical_errors_go_first():
    """A bad character later in the text is reported before the parser's own complaint, unless that claimed its token."""
    with pytest.raises(ParseError, match="unexpected character"):
        parse("SELECT * FROM WHERE é")
    with pytest.raises(UnsupportedError, match="ORDER BY ordinals"):
        parse("SELECT * FROM t ORDER BY 1 é")


def test_expressions_are_flat_and_bind_by_precedence():
    w = parse("SELECT * FROM t WHERE a = 1 OR (b = 2 OR c = 3) AND d = 4 AND (e = 5 AND f = 6)").where
    assert w.op == "OR" and len(w.children) == 2 and w.children[1].op == "AND" and len(w.children[1].children) == 4
    assert w.units == 6 and parse("SELECT * FROM t WHERE a IN (1, 2, NULL)").where.units == 3
    deep = parse("SELECT * FROM t WHERE " + "(" * 3000 + "a = 1" + ")" * 3000)
    assert isinstance(deep.where, A.Predicate)


def test_names_fold_and_contextual_words_are_names():
    s = parse('SELECT Inner.ON, "Order" FROM INNER JOIN key ON inner.a = KEY.b LIMIT 007 OFFSET 1;')
    assert s.table == "inner" and s.items == (A.Name("inner", "on"), A.Name(None, "order")) and (s.limit, s.offset) == (7, 1)
    assert parse("INSERT INTO t VALUES ('it''s\0\n', -0, TRUE, null)").values == ("it's\0\n", 0, True, None)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("SELECT FROM WHERE a=1'\"();,<>!-*é\n")), st.characters()), max_size=60))
def test_any_text_parses_or_fails_cleanly(sql):
    try:
        parse(sql)
    except EngineError as e:
        if hasattr(e, "span"):
            assert 0 <= e.span[0] <= e.span[1] <= len(sql.encode(errors="surrogatepass"))
    except UnicodeEncodeError:
        assert any("\ud800" <= c <= "\udfff" for c in sql)
    assert lex("a b")[1].span == (2, 3)

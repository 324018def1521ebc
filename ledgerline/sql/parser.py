"""Recursive descent over the tokens, and the precedence of lexical errors over syntax errors."""

from __future__ import annotations

import re
from typing import Any

from ..errors import EngineError, ParseError, Span, UnsupportedError
from ..schema import BOOLEAN, CASCADE, INTEGER, RESTRICT, SET_NULL, TEXT
from . import ast as A
from .lexer import ARITHMETIC, BAD, COMPARISONS, END, NUMBER, QUOTED, RESERVED, STRING, SYMBOL, WORD, Token, character, lex

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
TRAILING = {"OR": "OR predicates", "JOIN": "joins", "CROSS": "cross joins", "NATURAL": "natural joins", "ORDER": "ORDER BY", "GROUP": "GROUP BY", "LIMIT": "LIMIT", "OFFSET": "OFFSET", "AS": "aliases"} | dict.fromkeys(("LEFT", "RIGHT", "FULL", "OUTER"), "outer joins")
I64, U64 = (-(1 << 63), (1 << 63) - 1), (1 << 64) - 1
LITERAL_WORDS = {"TRUE": True, "FALSE": False, "NULL": None}


def parse(text: str) -> Any:
    """The one statement in `text`."""
    p = _Parser(lex(text))
    try:
        statement, error = p.statement(), None
    except EngineError as e:
        statement, error = None, e
    p.reject_lexical_errors()
    if error is not None:
        raise error
    return statement


def flattened(op: str, left: Any, right: Any) -> A.Group:
    sides = [c for x in (left, right) for c in (x.children if isinstance(x, A.Group) and x.op == op else (x,))]
    return A.Group(op, tuple(sides))


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0
        self.expressions: list[range] = []
        # tokens whose own error goes before a later lexical one
        self.claimed_in: int | None = None
        self.claimed: set[int] = set()

    # -- tokens

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    @property
    def span(self) -> Span:
        return self.token.span

    def word(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i].value if i < len(self.tokens) and self.tokens[i].kind == WORD else None

    def is_symbol(self, symbol: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and self.tokens[i].kind == SYMBOL and self.tokens[i].value == symbol

    def step(self) -> Token:
        token = self.token
        if token.kind != END:
            self.at += 1
        return token

    def take_word(self, word: str) -> bool:
        if self.word() == word:
            self.at += 1
            return True
        return False

    def take(self, symbol: str) -> bool:
        if self.is_symbol(symbol):
            self.at += 1
            return True
        return False

    def need_word(self, word: str) -> None:
        if not self.take_word(word):
            raise ParseError(f"expected keyword {word}", self.span)

    def need(self, symbol: str, message: str) -> None:
        if not self.take(symbol):
            raise ParseError(message, self.span)

    def ended(self) -> bool:
        return self.token.kind == END or self.is_symbol(";")

    # -- names and literals

    def identifier(self) -> str:
        t = self.token
        if t.kind == WORD:
            if t.value in RESERVED:
                raise ParseError(f"reserved keyword `{t.value}` cannot be used as an identifier", t.span)
        elif t.kind == QUOTED:
            if not IDENTIFIER.match(t.value):
                raise ParseError("quoted identifiers must use the unquoted ASCII identifier grammar", t.span)
        else:
            raise ParseError("expected an identifier", t.span)
        self.at += 1
        return t.value.lower()

    def name(self) -> A.Name:
        first = self.identifier()
        return A.Name(first, self.identifier()) if self.take(".") else A.Name(None, first)

    def literal(self) -> Any:
        t = self.token
        if t.kind == STRING:
            value = t.value
        elif t.kind == NUMBER:
            value = int(t.value)
            if not I64[0] <= value <= I64[1]:
                raise ParseError("INTEGER literal is outside the i64 range", t.span)
        elif t.kind == WORD and t.value in LITERAL_WORDS:
            value = LITERAL_WORDS[t.value]
        else:
            raise ParseError("expected a literal value", t.span)
        self.at += 1
        return value

    # -- statements

    def statement(self) -> Any:
        kinds = {"CREATE": self.create, "INSERT": self.insert, "SELECT": self.select, "UPDATE": self.update, "DELETE": self.delete, "SHOW": self.show, "DESCRIBE": self.describe, "EXPLAIN": self.explain}
        word = self.word()
        if word is None:
            raise ParseError("expected a SQL statement", self.span)
        if word not in kinds:
            raise UnsupportedError(f"statement `{word}`", self.span)
        out = kinds[word]()
        if self.take(";") and self.token.kind != END:
            raise UnsupportedError("multiple SQL statements", self.span)
        if self.token.kind != END:
            raise UnsupportedError(TRAILING.get(self.word() or "", "trailing SQL syntax"), self.span)
        return out

    def show(self) -> Any:
        self.at += 1
        if self.take_word("TABLES"):
            return A.ShowTables()
        if self.take_word("CREATE"):
            self.need_word("TABLE")
            return A.ShowCreate(self.identifier())
        raise ParseError("expected TABLES or CREATE TABLE after SHOW", self.span)

    def describe(self) -> A.Describe:
        self.at += 1
        return A.Describe(self.identifier())

    def explain(self) -> A.ExplainSelect:
        self.at += 1
        self.need_word("REGEX")
        if self.word() != "SELECT":
            raise UnsupportedError("EXPLAIN REGEX only supports SELECT", self.span)
        return A.ExplainSelect(self.select())

    def insert(self) -> A.Insert:
        self.at += 1
        self.need_word("INTO")
        table, columns = self.identifier(), None
        if self.take("("):
            columns = [self.identifier()]
            while self.take(","):
                columns.append(self.identifier())
            self.need(")", "expected `)` after column list")
        self.need_word("VALUES")
        self.need("(", "expected `(` after VALUES")
        values = [self.literal()]
        while self.take(","):
            values.append(self.literal())
        self.need(")", "expected `)` after VALUES")
        if self.is_symbol(","):
            raise UnsupportedError("multi-row INSERT", self.span)
        return A.Insert(table, None if columns is None else tuple(columns), tuple(values))

    def update(self) -> A.Update:
        self.at += 1
        table = self.identifier()
        self.need_word("SET")
        assignments = []
        while True:
            column = self.identifier()
            self.need("=", "expected `=` in assignment")
            assignments.append((column, self.literal()))
            if not self.take(","):
                break
        return A.Update(table, tuple(assignments), self.where())

    def delete(self) -> A.Delete:
        self.at += 1
        self.need_word("FROM")
        return A.Delete(self.identifier(), self.where())

    # -- CREATE TABLE

    def create(self) -> A.CreateTable:
        self.at += 1
        self.need_word("TABLE")
        table = self.identifier()
        self.need("(", "expected `(` after table name")
        elements = [self.element()]
        while self.take(","):
            elements.append(self.element())
        self.need(")", "expected `,` or `)`")
        return A.CreateTable(table, tuple(elements))

    def element(self) -> tuple:
        word, after = self.word(), self.word(1)
        if word == "PRIMARY" and after == "KEY":
            return ("primary_key", self.key_column("PRIMARY KEY", 2))
        if word == "FOREIGN" and after == "KEY":
            return ("foreign_key", self.key_column("FOREIGN KEY", 2), self.reference())
        if word == "UNIQUE" and self.is_symbol("(", 1):
            return ("unique", self.key_column("UNIQUE", 1))
        if word == "CHECK" and self.is_symbol("(", 1):
            return ("check", self.check())
        return self.column()

    def key_column(self, what: str, words: int) -> str:
        self.at += words
        self.need("(", f"expected `(` after {what}")
        name = self.identifier()
        self.single(what)
        self.need(")", f"expected `)` after {what} column")
        return name

    def single(self, what: str) -> None:
        if self.is_symbol(","):
            raise UnsupportedError(f"composite {what} constraints", self.span)

    def column(self) -> tuple:
        name, kind = self.identifier(), self.word()
        if kind not in (TEXT, INTEGER, BOOLEAN):
            raise UnsupportedError(f"column type `{kind}`", self.span) if kind else ParseError("expected TEXT, INTEGER, or BOOLEAN", self.span)
        self.at += 1
        modifiers: list[tuple] = []
        while True:
            word = self.word()
            if word == "NOT":
                self.at += 1
                self.need_word("NULL")
                modifiers.append(("not_null",))
            elif word == "PRIMARY" and self.word(1) == "KEY":
                self.at += 2
                modifiers.append(("primary_key",))
            elif word == "UNIQUE":
                self.at += 1
                modifiers.append(("unique",))
            elif word == "REFERENCES":
                modifiers.append(("references", self.reference()))
            elif word in ("AUTOINCREMENT", "AUTO_INCREMENT"):
                self.at += 1
                modifiers.append(("auto_increment",))
            elif word == "DEFAULT":
                self.at += 1
                modifiers.append(("default", self.literal()))
            elif word == "CHECK" and self.is_symbol("(", 1):
                modifiers.append(("check", self.check()))
            else:
                return ("column", name, kind, tuple(modifiers))

    def reference(self) -> A.Reference:
        self.need_word("REFERENCES")
        table = self.identifier()
        self.need("(", "expected `(` after referenced table")
        column = self.identifier()
        self.single("FOREIGN KEY")
        self.need(")", "expected `)` after referenced column")
        actions: dict[str, str] = {}
        while self.word() == "ON" and self.word(1) in ("DELETE", "UPDATE"):
            span, event = self.span, self.word(1)
            self.at += 2
            if event in actions:
                raise ParseError(f"duplicate ON {event} clause", span)
            if self.take_word("RESTRICT"):
                actions[event] = RESTRICT
            elif self.take_word("CASCADE"):
                actions[event] = CASCADE
            elif event == "DELETE" and self.take_word("SET"):
                self.need_word("NULL")
                actions[event] = SET_NULL
            else:
                raise ParseError("expected RESTRICT, CASCADE, or SET NULL after ON DELETE" if event == "DELETE" else "expected RESTRICT or CASCADE after ON UPDATE", self.span)
        return A.Reference(table, column, actions.get("DELETE", RESTRICT), actions.get("UPDATE", RESTRICT))

    def check(self) -> Any:
        self.need_word("CHECK")
        if not self.is_symbol("("):
            raise ParseError("expected `(` after CHECK", self.span)
        depth, i = 0, self.at
        while i < len(self.tokens) and self.tokens[i].kind != END:
            if self.tokens[i].kind == SYMBOL:
                depth += {"(": 1, ")": -1}.get(self.tokens[i].value, 0)
            i += 1
            if depth == 0:
                break
        self.expressions.append(range(self.at, i))
        return self.expression("CHECK")

    # -- SELECT

    def select(self) -> A.Select:
        self.need_word("SELECT")
        items: list[A.Name | A.Star] = []
        if self.take("*"):
            items.append(A.Star(None))
        else:
            items.append(self.item())
            while self.take(","):
                items.append(self.item())
        self.need_word("FROM")
        table = self.identifier()
        joins = []
        while True:
            if self.word() == "INNER" and self.word(1) == "JOIN":
                self.at += 2
            elif not self.take_word("JOIN"):
                break
            joined = self.identifier()
            if self.word() == "AS":
                raise UnsupportedError("aliases", self.span)
            self.need_word("ON")
            conditions = [self.condition()]
            while self.take_word("AND"):
                conditions.append(self.condition())
            joins.append(A.Join(joined, tuple(conditions)))
        where = self.where()
        order = self.order()
        limit, offset = self.pages()
        return A.Select(table, tuple(joins), tuple(items), where, order, limit, offset)

    def item(self) -> A.Name | A.Star:
        first = self.identifier()
        if not self.take("."):
            return A.Name(None, first)
        return A.Star(first) if self.take("*") else A.Name(first, self.identifier())

    def condition(self) -> tuple[A.Name, A.Name]:
        left = self.name()
        self.need("=", "expected `=` in JOIN condition")
        return left, self.name()

    def order(self) -> tuple[tuple[A.Name, bool], ...]:
        if not self.take_word("ORDER"):
            return ()
        self.need_word("BY")
        terms = [self.term()]
        while self.take(","):
            terms.append(self.term())
        if not (self.ended() or self.token.kind == BAD or self.word() in TRAILING):
            self.claimed.add(self.at)
            raise ParseError("expected `,` between ORDER BY terms", self.span)
        return tuple(terms)

    def _expression_span(self) -> Span | None:
        """Of what makes an ORDER BY term an expression, if it is one."""
        t = self.token
        if t.kind == SYMBOL and t.value in COMPARISONS:
            end = self.at + 1
            while self.tokens[end].kind == SYMBOL and self.tokens[end].value in COMPARISONS and self.tokens[end].span[0] == self.tokens[end - 1].span[1]:
                end += 1
            return t.span[0], self.tokens[end - 1].span[1]
        if t.kind == NUMBER and t.value.startswith("-"):
            return t.span[0], t.span[0] + 1
        if t.kind == ARITHMETIC or t.kind == SYMBOL and t.value in ("(", "*") or self.word() in ("AND", "BETWEEN", "IN", "IS", "LIKE", "NOT", "OR"):
            return t.span
        return None

    def unordered(self, feature: str, span: Span | None = None) -> UnsupportedError:
        self.claimed.add(self.at)
        return UnsupportedError(feature, span or self.span)

    def term(self) -> tuple[A.Name, bool]:
        if self.token.kind == NUMBER:
            raise self.unordered("ORDER BY ordinals")
        if self.token.kind != WORD and (span := self._expression_span()):
            raise self.unordered("ORDER BY expressions", span)
        name = self.name()
        ascending = self.take_word("ASC") or not self.take_word("DESC")
        if self.word() == "COLLATE":
            raise self.unordered("ORDER BY COLLATE")
        if self.word() == "NULLS":
            raise self.unordered("ORDER BY NULLS FIRST/LAST")
        if span := self._expression_span():
            raise self.unordered("ORDER BY expressions", span)
        return name, ascending

    def pages(self) -> tuple[int | None, int | None]:
        limit = self.unsigned("LIMIT") if self.take_word("LIMIT") else None
        offset = self.unsigned("OFFSET") if self.take_word("OFFSET") else None
        if limit is None and offset is None or self.ended():
            return limit, offset
        word = self.word()
        if word == "LIMIT":
            message = "LIMIT must precede OFFSET" if limit is None else "duplicate LIMIT clause"
        elif word == "OFFSET":
            message = "duplicate OFFSET clause"
        elif word == "ORDER":
            message = "ORDER BY must precede LIMIT and OFFSET"
        else:
            message = "no SQL syntax may follow OFFSET" if offset is not None else "expected OFFSET or the end of the SELECT statement"
        raise self.paging(message)

    def unsigned(self, clause: str) -> int:
        t = self.token
        if t.kind != NUMBER:
            raise self.paging(f"expected an unsigned integer after {clause}")
        if t.value.startswith("-"):
            raise self.paging(f"{clause} requires an unsigned integer")
        if int(t.value) > U64:
            raise self.paging(f"{clause} is outside the u64 range")
        self.at += 1
        return int(t.value)

    def paging(self, message: str) -> ParseError:
        t = self.token
        if t.kind not in (BAD, ARITHMETIC) and not (t.kind == SYMBOL and t.value in ("!", "<", ">")):
            self.claimed.add(self.at)
        return ParseError(message, t.span)

    # -- predicates

    def where(self) -> Any:
        if not self.take_word("WHERE"):
            return None
        depth, i = 0, self.at
        while self.tokens[i].kind != END and not (self.tokens[i].kind == SYMBOL and self.tokens[i].value == ";"):
            if depth == 0 and self.clause_starts(i):
                break
            if self.tokens[i].kind == SYMBOL:
                depth = max(0, depth + {"(": 1, ")": -1}.get(self.tokens[i].value, 0))
            i += 1
        self.expressions.append(range(self.at, i))
        return self.expression("WHERE")

    def clause_starts(self, i: int) -> bool:
        words = [t.value if t.kind == WORD else None for t in self.tokens[i : i + 3]]
        if words[0] in ("JOIN", "ORDER", "GROUP", "LIMIT", "AS"):
            return True
        if words[0] in ("LEFT", "RIGHT", "FULL"):
            return words[1:2] == ["JOIN"] or words[1:3] == ["OUTER", "JOIN"]
        return words[0] in ("OUTER", "CROSS", "NATURAL") and words[1:2] == ["JOIN"]

    def expression(self, context: str) -> Any:
        """Shunting yard: stacks instead of recursion, so nesting may be deep. CHECK ends with its own parenthesis."""
        strength, operators, values = {"OR": 1, "AND": 2}, [], []

        def reduce() -> None:
            op, right = operators.pop(), values.pop()
            values.append(flattened(op, values.pop(), right))

        operand, closed = True, False
        while True:
            t, word = self.token, self.word()
            if operand:
                if self.take("("):
                    operators.append("(")
                    continue
                if self.is_symbol(")"):
                    raise ParseError("expected a predicate before `)`", t.span)
                if self.ended():
                    raise ParseError(f"expected a predicate in {context}", t.span)
                if word == "NOT":
                    raise UnsupportedError("unary NOT", t.span)
                if t.kind in (STRING, NUMBER):
                    raise UnsupportedError("literal-to-literal predicates", t.span)
                if word in LITERAL_WORDS:
                    raise UnsupportedError("literal-to-literal predicates" if word == "NULL" else "bare Boolean constants", t.span)
                values.append(self.predicate(context))
                operand = False
                continue
            if closed:
                break
            if word in strength:
                while operators and operators[-1] != "(" and strength[operators[-1]] >= strength[word]:
                    reduce()
                operators.append(word)
                self.at += 1
                operand = True
                continue
            if self.is_symbol(")"):
                while operators and operators[-1] != "(":
                    reduce()
                if not operators:
                    raise ParseError(f"unmatched `)` in {context}", t.span)
                operators.pop()
                self.at += 1
                closed = context == "CHECK" and not operators
                continue
            if self.ended() or word in TRAILING:
                break
            raise ParseError(f"expected `AND`, `OR`, `)`, or the end of {context}", t.span)
        while operators:
            if operators[-1] == "(":
                raise ParseError(f"expected `)` to close {context} expression", self.span)
            reduce()
        return values.pop()

    def predicate(self, context: str) -> A.Predicate:
        column, t = self.name(), self.token
        if t.kind == SYMBOL and t.value in ("=", "!=", "<", ">"):
            self.at += 1
            op = t.value
            if op in "<>" and self.is_symbol("=") and self.span[0] == t.span[1]:
                self.at += 1
                op += "="
            return A.Predicate(column, op, self.compared(context))
        word = self.word()
        if word == "LIKE":
            self.at += 1
            if self.token.kind != STRING:
                raise ParseError("LIKE expects a string literal", self.span)
            return A.Predicate(column, "LIKE", self.step().value)
        if word == "IS":
            self.at += 1
            negated = self.take_word("NOT")
            self.need_word("NULL")
            return A.Predicate(column, "IS NOT NULL" if negated else "IS NULL")
        if word == "IN" and self.is_symbol("(", 1):
            keyword = self.span
            self.at += 2
            return A.Predicate(column, "IN", self.members(keyword))
        if context == "WHERE":
            raise ParseError("expected `=`, `!=`, `<`, `<=`, `>`, `>=`, `LIKE`, `IS [NOT] NULL`, or `IN (...)`", t.span)
        raise ParseError("expected a comparison, LIKE, IS [NOT] NULL, or IN", t.span)

    def compared(self, context: str) -> Any:
        t = self.token
        if t.kind == QUOTED or t.kind == WORD and t.value not in RESERVED:
            raise UnsupportedError(f"column-to-column {context} predicates", t.span)
        return self.literal()

    def members(self, keyword: Span) -> tuple[Any, ...]:
        if self.is_symbol(")"):
            raise UnsupportedError("empty IN lists", keyword)
        values = []
        while True:
            t = self.token
            if self.word() == "SELECT":
                self.claimed_in = self.at
                raise UnsupportedError("subqueries in IN lists", t.span)
            if t.kind == WORD and t.value not in LITERAL_WORDS or t.kind in (QUOTED, ARITHMETIC) or self.is_symbol("("):
                raise self.in_list()
            values.append(self.literal())
            if self.take(","):
                continue
            t = self.token
            if t.kind == ARITHMETIC or t.kind == SYMBOL and t.value in ("=", "!=", "<", ">", "*") or t.kind == NUMBER and t.value.startswith("-") or self.word() in ("AND", "OR", "IS", "LIKE", "IN", "BETWEEN", "NOT", "COLLATE"):
                raise self.in_list()
            break
        self.need(")", "expected `)` after IN list")
        return tuple(values)

    def in_list(self) -> UnsupportedError:
        self.claimed_in = self.at
        t = self.token
        span = (t.span[0], t.span[0] + 1) if t.kind == NUMBER and t.value.startswith("-") else t.span
        return UnsupportedError("expressions in IN lists", span)

    # -- lexical errors go before syntax errors that come later

    def reject_lexical_errors(self) -> None:
        i = 0
        while i < len(self.tokens) and i not in self.claimed:
            t = self.tokens[i]
            if t.kind == BAD:
                raise t.error()
            if t.kind == SYMBOL and t.value in COMPARISONS:
                if any(i in r for r in self.expressions):
                    k = i + 1
                    while k < len(self.tokens) and self.tokens[k].kind == SYMBOL and self.tokens[k].value in COMPARISONS and self.tokens[k].span[0] == self.tokens[k - 1].span[1]:
                        k += 1
                    op, span = "".join(x.value for x in self.tokens[i:k]), (t.span[0], self.tokens[k - 1].span[1])
                    if op not in ("=", "!=", "<", "<=", ">", ">="):
                        raise _comparison(op, span)
                    if self.claimed_in == i:
                        break
                    i = k
                    continue
                if t.value in ("<", ">"):
                    raise UnsupportedError("ordered comparisons", (t.span[0], t.span[0] + 1))
                if t.value == "!":
                    raise _comparison("!", t.span)
            if self.claimed_in == i:
                break
            if t.kind == ARITHMETIC:
                raise ParseError(f"unexpected character {character(t.value)}", t.span)
            i += 1


def _comparison(op: str, span: Span) -> EngineError:
    if op == "<>":
        return UnsupportedError("comparison operator `<>`", span)
    return ParseError("expected `=` after `!`" if op == "!" else f"malformed comparison operator `{op}`", span)

"""Tokens with UTF-8 byte spans. The first lexical error ends the list, as a token of its own."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from ..errors import EngineError, ParseError, Span, UnsupportedError

RESERVED = frozenset(
    "CREATE TABLE INSERT INTO VALUES SELECT FROM WHERE UPDATE SET DELETE EXPLAIN REGEX AND OR IS IN NOT NULL LIKE TEXT INTEGER BOOLEAN TRUE FALSE AS JOIN"
    " ORDER BY ASC DESC GROUP LIMIT OFFSET ALTER DROP DEFAULT UNIQUE CHECK CASCADE RESTRICT SHOW DESCRIBE TABLES".split()
)
WORD, STRING, NUMBER, QUOTED, SYMBOL, ARITHMETIC, BAD, END = "word", "string", "number", "quoted", "symbol", "arithmetic", "bad", "end"
_PARTS = re.compile(
    r"(?P<space>\s+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>-?[0-9]+)(?P<glue>[.A-Za-z0-9_]*)|'(?P<string>(?:[^']|'')*)(?P<close>')?"
    r'|"(?P<quoted>(?:[^"]|"")*)(?P<shut>")?|(?P<comment>--|/\*)|(?P<symbol>!=|[(),.*;<>=!])|(?P<arithmetic>[-+%|/])|(?P<other>.)',
    re.S,
)
COMPARISONS = ("!", "=", "!=", "<", ">")


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any
    span: Span

    def error(self) -> EngineError:
        return self.value(self.span)


def character(c: str) -> str:
    return "'" + {"'": "\\'", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(c, c if c.isprintable() else f"\\u{{{ord(c):x}}}") + "'"


def lex(text: str) -> list[Token]:
    out, at = [], 0
    for m in _PARTS.finditer(text):
        size = len(m[0].encode())
        start, at = at, at + size
        span = (start, at)
        kind = m.lastgroup
        if m["space"] is not None:
            continue
        bad = None
        if m["word"] is not None:
            out.append(Token(WORD, m[0].upper(), span))
        elif m["number"] is not None:
            if m["glue"]:
                bad = lambda s: ParseError("malformed numeric token", s)
            else:
                out.append(Token(NUMBER, m["number"], span))
        elif m["string"] is not None:
            if m["close"]:
                out.append(Token(STRING, m["string"].replace("''", "'"), span))
            else:
                bad, span = (lambda s: ParseError("unterminated string literal", s)), (start, len(text.encode()))
        elif m["quoted"] is not None:
            if m["shut"]:
                out.append(Token(QUOTED, m["quoted"].replace('""', '"'), span))
            else:
                bad, span = (lambda s: ParseError("unterminated quoted identifier", s)), (start, len(text.encode()))
        elif kind == "comment":
            bad, span = (lambda s: UnsupportedError("SQL comments", s)), (start, len(text.encode()))
        elif kind == "symbol":
            out.append(Token(SYMBOL, m[0], span))
        elif kind == "arithmetic":
            out.append(Token(ARITHMETIC, m[0], span))
        else:
            bad = lambda s, c=m[0]: ParseError(f"unexpected character {character(c)}", s)
        if bad:
            out.append(Token(BAD, bad, span))
            break
    n = len(text.encode())
    return [*out, Token(END, None, (n, n))]

"""Tokens of the dialect: case-sensitive identifiers, case-insensitive keywords, no comments, no quoted names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from skarn.errors import ParseError

_TOKEN = re.compile(
    r"""\s+|(?P<number>\d+(?:\.\d+)?)(?![A-Za-z_])|(?P<name>[A-Za-z0-9_]+)|(?P<string>'[^']*'|"[^"]*")"""
    r"""|(?P<symbol><=|>=|!=|[-+*/=<>(),;.\[\]{}:|])"""
)

# Fixed words of the grammar.
KEYWORDS = set(
    "SELECT FROM AS INNER LEFT RIGHT FULL JOIN ON WHERE GROUP BY ORDER ASC DESC LIMIT OFFSET CREATE TABLE UNIQUE INDEX SEQUENCE "
    "OWNED DATABASE DROP PRIMARY KEY NULLABLE INSERT INTO VALUES RETURNING UPDATE SET DELETE BEGIN TRANSACTION COMMIT ROLLBACK "
    "EXPLAIN SOURCE AND OR IS NOT NULL BETWEEN IN LIKE TRUE FALSE INTERVAL".split()
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, name, keyword, string, symbol, end
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            line = text.count("\n", 0, at) + 1
            raise ParseError(f"unexpected {text[at]!r} on line {line}")
        kind = m.lastgroup
        if kind == "string":
            out.append(Token("string", m[0][1:-1], at))
        elif kind == "name" and m[0].upper() in KEYWORDS:
            out.append(Token("keyword", m[0].upper(), at))
        elif kind:
            out.append(Token(kind, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]

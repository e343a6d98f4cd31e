"""Syntax trees. Expressions are frozen, so that equal ones compare equal."""

from __future__ import annotations

from dataclasses import dataclass

from skarn.types import Column


@dataclass(frozen=True)
class Literal:
    """``value``: str, int, float text (kept as written), bool or None; ``kind``: string, int, decimal, bool, null."""

    value: object
    kind: str


@dataclass(frozen=True)
class Interval:
    months: int
    days: int
    micros: int


@dataclass(frozen=True)
class Json:
    """A JSON literal, as JSON text."""

    text: str


@dataclass(frozen=True)
class Name:
    """Dotted names with subscripts: a column, a qualified column, or a path into a JSON column."""

    parts: tuple[str | int, ...]  # names; integers and "*" in brackets are wrapped in Index

    def __str__(self) -> str:
        return "".join(f"[{p.at}]" if isinstance(p, Index) else f".{p}" for p in self.parts).lstrip(".")


@dataclass(frozen=True)
class Index:
    at: int | str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    operand: object
    negated: bool


@dataclass(frozen=True)
class Between:
    operand: object
    low: object
    high: object


@dataclass(frozen=True)
class In:
    operand: object
    choices: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    unit: str | None = None  # of EXTRACT


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None

    @property
    def known_as(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    how: str
    table: Table
    on: object


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: Table
    joins: tuple[Join, ...] = ()
    where: object = None
    group: tuple = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[Column, ...]
    sql: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool
    sql: str


@dataclass(frozen=True)
class CreateSequence:
    name: str
    type: str
    table: str
    sql: str


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    returning: tuple[Item, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, object], ...]
    where: object
    returning: tuple[Item, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: object


@dataclass(frozen=True)
class Transaction:
    action: str  # BEGIN, COMMIT, ROLLBACK


@dataclass(frozen=True)
class Explain:
    statement: object


@dataclass(frozen=True)
class Source:
    path: str

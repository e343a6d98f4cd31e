"""Errors of the dialect. All are raised while a statement is analysed, before Spark runs it."""

from __future__ import annotations


class SqlError(Exception):
    """Any failure of a statement."""


class ParseError(SqlError):
    pass


class AnalysisError(SqlError):
    pass


class InvalidTable(AnalysisError):
    def __init__(self, name: str):
        super().__init__(f"no table named {name!r}")


class InvalidColumn(AnalysisError):
    def __init__(self, name: str, table: str | None = None):
        super().__init__(f"no column {name!r}" + (f" in table {table!r}" if table else ""))


class InvalidGroupBy(AnalysisError):
    def __init__(self, name: str):
        super().__init__(f"column {name!r} is neither grouped nor aggregated")


class TypeMismatch(AnalysisError):
    pass


class InvalidEnumVariant(AnalysisError):
    pass


class InvalidArguments(AnalysisError):
    def __init__(self, name: str, expected: str, got: int):
        super().__init__(f"{name} takes {expected} arguments, got {got}")


class ConstraintError(SqlError):
    pass


class DuplicatedKey(ConstraintError):
    pass


class NotNullViolation(ConstraintError):
    pass


class OutOfRange(ConstraintError):
    pass


class AlreadyExists(AnalysisError):
    pass


class TransactionError(SqlError):
    pass

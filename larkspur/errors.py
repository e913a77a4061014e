"""Typed failures. Values that a caller can correct raise QueryBuilderError; wrong calls raise QueryBuilderDefect."""

from __future__ import annotations


class QueryBuilderError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class UnresolvedParam(QueryBuilderError):
    def __init__(self, message: str):
        super().__init__("UnresolvedParam", message)


class InvalidLiteral(QueryBuilderError):
    def __init__(self, message: str):
        super().__init__("InvalidLiteral", message)


class InvalidArguments(QueryBuilderError):
    def __init__(self, message: str):
        super().__init__("InvalidArguments", message)


class QueryBuilderDefect(Exception):
    """A call that no value can make right: an ungrouped column, an aggregate in a filter, a clash of names."""


class RowDecodeError(Exception):
    def __init__(self, row_index: int, column: str, issue: str):
        super().__init__(f"row {row_index}, column {column}: {issue}")
        self.row_index, self.column, self.issue = row_index, column, issue


class CardinalityError(Exception):
    """run_one and run_option found another number of rows."""


class TenantScopeError(Exception):
    """A query that is not bound to one tenant where one is required."""


class ConstraintError(Exception):
    def __init__(self, kind: str, table: str, columns: tuple[str, ...]):
        super().__init__(f"{kind} violated on {table}({', '.join(columns)})")
        self.kind, self.table, self.columns = kind, table, columns


class ConflictError(Exception):
    """Another writer has moved the table's version meanwhile."""

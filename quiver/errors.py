"""Errors that queries raise before they run."""


class QueryError(Exception):
    pass


class QuerySyntaxError(QueryError):
    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} at line {line}, column {column}" if line else message)
        self.line, self.column = line, column


class AnalysisError(QueryError):
    """The text parses but can't mean anything on this graph."""


class CatalogError(QueryError):
    pass


class ConflictError(QueryError):
    """Another transaction committed first."""


class ConstraintError(QueryError):
    """A unique index or a graph type does not allow the change."""

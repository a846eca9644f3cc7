"""Typed errors."""


class PositError(Exception):
    """Base of all errors of this package."""


class ConfigError(PositError):
    """A setting is missing or wrong."""


class PersistenceError(PositError):
    """The store can't be read or written."""


class DataCorruption(PersistenceError):
    """The ledger and the posits disagree."""


class ParseError(PositError):
    """A script isn't in the language; carries line and column, from 1."""

    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


class ExecutionError(PositError):
    """A script asks for something that has no meaning with this data."""


class Cancelled(PositError):
    """The query was cancelled or took too long."""

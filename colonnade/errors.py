"""Errors of statements, with the status classes that drivers know."""

from __future__ import annotations


class StatementError(Exception):
    """A statement that can't run; `code` is its status class."""

    code = 0x0000


class SyntaxFailure(StatementError):
    code = 0x2000


class InvalidRequest(StatementError):
    code = 0x2200


class NotSupported(InvalidRequest):
    """Parsed, but outside what the engine does."""


class ConfigurationFailure(StatementError):
    code = 0x2300


class AlreadyExists(StatementError):
    code = 0x2400


FILTERING = (
    "Cannot execute this query as it might involve data filtering and thus may have unpredictable performance. "
    "If you want to execute this query despite the performance unpredictability, use ALLOW FILTERING"
)

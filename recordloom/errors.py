"""Errors of parsing, validating and committing records."""

from __future__ import annotations


class RecordError(Exception):
    """Base of this package's errors."""


class InvalidId(RecordError):
    pass


class EscapeError(RecordError):
    pass


class ParseError(RecordError):
    def __init__(self, line: int, message: str) -> None:
        super().__init__(f"line {line}: {message}")
        self.line, self.message = line, message


class DuplicateId(RecordError):
    pass


class MissingId(RecordError):
    pass


class EmptyRecord(RecordError):
    """A patch or upsert would leave a record without fields."""


class CommitConflict(RecordError):
    """Another commit touched the same records since the snapshot that this one is based on."""

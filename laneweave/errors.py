"""Errors with the exit codes of the command line."""

from __future__ import annotations


class LaneError(Exception):
    """Base of all errors; ``exit_code`` is what the command line ends with."""

    exit_code = 1

    def chain(self) -> str:
        """The message with those of its causes."""
        parts, error = [], self
        while error is not None:
            parts.append(str(error))
            error = error.__cause__
        return ": ".join(parts)


class ConfigError(LaneError):
    """Bad options or paths."""

    exit_code = 2


class RecordError(LaneError):
    """A record that can't be framed or doesn't hold together; ``ordinal`` counts from 1."""

    exit_code = 3

    def __init__(self, message: str, ordinal: int | None = None):
        super().__init__(message if ordinal is None else f"record {ordinal}: {message}")
        self.ordinal = ordinal


class TagError(RecordError):
    """A damaged auxiliary section, or a tag of an unfit type."""


class CigarError(RecordError):
    """Impossible CIGAR operations or lengths."""


class HeaderError(LaneError):
    exit_code = 3


class AnnotationError(LaneError):
    exit_code = 3


class IndexError_(LaneError):
    """A damaged or stale index."""

    exit_code = 3


class RoutingError(LaneError):
    """A record that a policy of ``error`` forbids."""

    exit_code = 3


class CardinalityError(LaneError):
    """More outputs than allowed."""

    exit_code = 4


class OutputError(LaneError):
    """An output can't be written, exists already, or two keys want one name."""

    exit_code = 4


class ManifestError(LaneError):
    """Counts that don't add up."""

    exit_code = 5


class Interrupted(LaneError):
    exit_code = 6

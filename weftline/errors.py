"""Exceptions of the engine."""

__all__ = ["WeftError", "ColumnNotFoundError", "ComputeError"]


class WeftError(Exception):
    """Base of all errors raised on purpose by this package."""


class ColumnNotFoundError(WeftError):
    """A named column does not exist in the frame it was looked up in."""


class ComputeError(WeftError):
    """The data does not meet a condition that a computation needs."""

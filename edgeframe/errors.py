"""Errors raised before a Spark job starts."""


class WaveError(Exception):
    """A request that can't be answered; the text is for the user."""


class UsageError(WaveError):
    """A malformed command line."""

"""Errors of this package."""


class KinthreadError(Exception):
    """Base of all."""


class InvalidConfigError(KinthreadError, ValueError):
    """A configuration is incomplete or names something unknown."""


class InvalidStoreError(KinthreadError):
    """A stored graph is absent or unreadable."""


class InvalidSchemaError(KinthreadError, ValueError):
    """A table lacks a column, or names one twice."""

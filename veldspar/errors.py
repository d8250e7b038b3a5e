"""Errors.  Definitions fail on the driver before any job; broken rules are rows, not exceptions."""


class VeldsparError(Exception):
    """Base of all errors."""


class SetupError(VeldsparError):
    """A definition can't be bound."""


class SetupNameError(SetupError):
    """A name isn't found or is ambiguous."""


class SetupTypeError(SetupError):
    """Types don't fit."""


class ApplyError(VeldsparError):
    """Input frames don't fit the definition."""


class LoadError(VeldsparError):
    """Serialized metadata can't be read."""

"""Errors of the engine."""


class FlowError(Exception):
    """Base of all errors raised on purpose."""


class FormulaError(FlowError):
    """A formula that can't be parsed or compiled."""


class UnsupportedError(FlowError):
    """An operation with no meaning or no implementation here."""


class ValidationError(FlowError):
    """A flow, node or step with missing or contradictory parameters."""

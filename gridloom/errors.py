"""Errors raised on the driver, from shapes alone, before any job runs."""


class GridError(ValueError):
    """Base of all errors of this package."""


class ShapeMismatchError(GridError):
    """Element counts or shapes do not fit."""


class BroadcastError(GridError):
    """Shapes cannot be broadcast together."""


class AxisError(GridError):
    """An axis is out of range."""


class IndexRangeError(GridError):
    """An index is out of range, of the wrong rank, or has step 0."""


class LinalgError(GridError):
    """Ranks or inner dimensions do not fit a product."""

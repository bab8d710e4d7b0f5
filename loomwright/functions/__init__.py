"""The library of feature patterns."""

from . import aggregates, rows, target  # noqa: F401  registers the patterns
from .registry import PATTERNS, Agg, Binding, Counts, Frame, Lag, Pattern, Quantile, Row, Sweep, Within

__all__ = ["PATTERNS", "Agg", "Binding", "Counts", "Frame", "Lag", "Pattern", "Quantile", "Row", "Sweep", "Within"]

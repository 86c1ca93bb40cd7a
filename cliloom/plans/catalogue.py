"""All queries but those of the training-data operators."""

from . import programs, relational, textual  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

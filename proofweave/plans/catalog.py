"""All registered queries and their equivalent SQL."""

from . import intake, ledger, reads  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

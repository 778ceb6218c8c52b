"""One query per operator over the driver's tables, with its SQL where SQL can say the same."""

from . import algebra, commits, explorer, reports, scalars, scans  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

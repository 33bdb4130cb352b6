"""Every registered query of the grid engine and its SQL oracle."""

from __future__ import annotations

from . import q_functions, q_log, q_match, q_programs, q_windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

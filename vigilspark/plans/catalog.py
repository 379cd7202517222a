"""Importing this module fills the registry."""

from . import analyst, detection, preparation  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

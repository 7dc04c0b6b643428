"""Registered queries over the driver's tables, each with its SQL counterpart where SQL can say it."""

from . import business, core, places, reshape, sketches, sources, spatial, streams, text, trends  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

"""The registered queries: importing the package gathers them."""

from tidemark.plans import admitting, controlling, lifecycle, logging, ranging, reading, storage, verifying, writing
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "admitting", "controlling", "lifecycle", "logging", "ranging", "reading", "storage",
    "verifying", "writing",
]

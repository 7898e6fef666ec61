"""All registered queries with their oracles."""

from . import generic, semantic, report  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

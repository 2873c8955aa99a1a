"""Every registered query of the library, by name, with its SQL twin."""

from . import contests, derived, documents, markup, participation, quality, scoring, serving  # noqa: F401  (they register their queries)
from .define import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All query modules, imported for their registrations."""

from checks import analysis, claims, listings, lookups, pages, patents, quality, retrieve, store, trace  # noqa: F401
from checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

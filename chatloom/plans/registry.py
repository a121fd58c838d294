"""All queries of the core and their SQL."""

from . import catalog, checks

QUERIES = catalog.QUERIES | checks.QUERIES
ORACLES = catalog.ORACLES | checks.ORACLES

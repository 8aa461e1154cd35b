"""The registered queries and, next to each, the SQL that must give the same rows."""

# ingest comes first: it names sub-queries that others use.
from registered import ingest, panels, growth, concentration, scenarios, composite, risk, figures  # noqa: F401
from registered.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

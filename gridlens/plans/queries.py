"""All registered queries; importing the modules fills the registry."""

from gridlens.plans import ingest_queries, load_queries, price_queries, rights_queries  # noqa: F401
from gridlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

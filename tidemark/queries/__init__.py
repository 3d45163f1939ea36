"""All registered queries; importing this package fills the registry."""

from tidemark.queries import cleaning, facts, ingest, link, panels, quality, scenarios, tables  # noqa: F401
from tidemark.queries.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]

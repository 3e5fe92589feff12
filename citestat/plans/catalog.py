"""All registered queries."""

from citestat.plans import (  # noqa: F401
    catalog_compare, catalog_counts, catalog_graph, catalog_link, catalog_refs, catalog_tables, catalog_text,
)
from citestat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries."""

from slidelake.plans import (  # noqa: F401
    catalog_analysis,
    catalog_annotations,
    catalog_planning,
    catalog_status,
    catalog_viewports,
)
from slidelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

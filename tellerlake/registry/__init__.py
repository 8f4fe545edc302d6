"""All registered queries."""

from . import etl, filters, joins, recommend, scalars, scans, stored, vectors  # noqa: F401
from .base import QUERIES, Context, Query

__all__ = ["QUERIES", "Context", "Query"]
